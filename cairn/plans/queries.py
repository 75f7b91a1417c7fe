"""Registered queries over the relational heap, each with the SQL that it equals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions import scalars as S
from cairn.operators import contents as C
from cairn.operators import graph as GR
from cairn.operators import growth as G
from cairn.operators import views as V
from cairn.rules import triage as T
from cairn.sources.relational import HEAP_SQL, relational_heap
from cairn.streaming import growth as ST

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, run: Query, sql: str | None = None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


def over_heap(name: str, view: Callable, sql: str) -> None:
    query(name, lambda spark, sf_dir: view(relational_heap(spark, sf_dir)), HEAP_SQL + sql)


LIVE = "d WHERE idom IS NOT NULL"
HIST = "SELECT class_name, loader, count(*) AS instances, CAST(sum(shallow) AS BIGINT) AS shallow, max(shallow) AS max_shallow, CAST(sum(retained) AS BIGINT) AS retained FROM d WHERE idom IS NOT NULL GROUP BY 1, 2"
TOTAL = "(SELECT sum(shallow) FROM d WHERE idom IS NOT NULL)"


def bp(part: str, whole: str = TOTAL) -> str:
    return f"CAST(({part}) * 10000 // ({whole}) AS BIGINT)"


over_heap("dominator_tree", lambda h: h.tree.select("obj_id", "class_name", "shallow", "idom", "depth", "retained"), "SELECT obj_id, class_name, shallow, idom, depth, retained FROM d")
over_heap("reachability", lambda h: V.reached(h.tree).select("obj_id"), f"SELECT obj_id FROM {LIVE}")
over_heap("heap_totals", lambda h: V.heap_totals(h.tree), f"SELECT count(*) FILTER (idom IS NOT NULL) AS reachable, CAST({TOTAL} AS BIGINT) AS reachable_shallow, count(*) FILTER (idom IS NULL) AS unreachable, CAST(sum(shallow) FILTER (idom IS NULL) AS BIGINT) AS unreachable_shallow, {bp('sum(shallow) FILTER (idom IS NULL)', 'sum(shallow)')} AS fragmentation_bp FROM d")
over_heap("heap_totals_with_loader", lambda h: V.with_system_loader(V.heap_totals(h.tree)).select("reachable", "reachable_shallow"), "SELECT count(*) + 1 AS reachable, CAST(sum(shallow) + 96 AS BIGINT) AS reachable_shallow FROM d WHERE idom IS NOT NULL")
over_heap("class_histogram", lambda h: V.class_histogram(h.tree), HIST)
over_heap("top_classes_by_retained", lambda h: V.class_histogram(h.tree).orderBy(V.F.desc("retained"), "class_name", "loader").limit(20), f"SELECT * FROM ({HIST}) ORDER BY retained DESC, class_name, loader LIMIT 20")
over_heap("composition", lambda h: V.composition(h.tree), "SELECT CASE kind WHEN 0 THEN 'Instances' ELSE 'Object arrays' END AS object_kind, idom IS NOT NULL AS reachable, count(*) AS objects, CAST(sum(shallow) AS BIGINT) AS shallow FROM d GROUP BY 1, 2")
over_heap("gc_roots_by_type", lambda h: V.roots_by_type(h.roots), "SELECT CASE r_regionkey % 3 WHEN 0 THEN 'Sticky Class' WHEN 1 THEN 'JNI Global' ELSE 'Thread' END AS root_type, count(*) AS roots FROM region GROUP BY 1")
over_heap("gc_roots_retained", lambda h: V.roots_retained(h.tree, h.roots), "SELECT CASE (obj_id - 1000000000000000000) % 3 WHEN 0 THEN 'Sticky Class' WHEN 1 THEN 'JNI Global' ELSE 'Thread' END AS root_type, count(*) AS roots, CAST(sum(retained) AS BIGINT) AS retained FROM d WHERE class_name = 'com.shop.geo.Region' GROUP BY 1")
over_heap("depth_histogram", lambda h: V.depth_histogram(h.tree), f"SELECT depth, count(*) AS objects FROM {LIVE} GROUP BY 1")
over_heap("depth_summary", lambda h: V.depth_summary(h.tree), f", h AS (SELECT depth, count(*) AS objects FROM {LIVE} GROUP BY 1), c AS (SELECT depth, objects, CAST(sum(objects) OVER (ORDER BY depth) AS BIGINT) AS cumulative, sum(objects) OVER () AS total FROM h) SELECT depth, objects, cumulative, {bp('cumulative', 'total')} AS cumulative_bp, (SELECT min(depth) FROM c WHERE cumulative * 2 >= total) AS median_depth, (SELECT min(depth) FROM c WHERE cumulative * 10 >= total * 9) AS p90_depth, (SELECT max(depth) FROM c) AS max_depth FROM c")
_TOPS = "t AS (SELECT *, row_number() OVER (ORDER BY retained DESC, obj_id) AS k FROM d WHERE idom = -1)"
over_heap("retention_concentration", lambda h: V.retention_concentration(h.tree), f", {_TOPS} SELECT " + ", ".join(f"{bp(f'(SELECT sum(retained) FROM t WHERE k <= {n})')} AS top{n}_bp" for n in (1, 10, 100)) + f", (SELECT count(*) FROM t WHERE retained * 100 >= {TOTAL}) AS one_percent_objects")
over_heap("loader_rollup", lambda h: V.loader_rollup(h.tree), f"SELECT loader, count(*) AS classes, CAST(sum(instances) AS BIGINT) AS instances, CAST(sum(shallow) AS BIGINT) AS shallow, CAST(sum(retained) AS BIGINT) AS retained FROM ({HIST}) GROUP BY 1 ORDER BY retained DESC, loader LIMIT 20")
over_heap("duplicate_classes", lambda h: V.duplicate_classes(h.tree), f"SELECT class_name, count(*) AS loaders, CAST(sum(instances) AS BIGINT) AS instances, CAST(sum(retained) AS BIGINT) AS retained, string_agg(loader, ',' ORDER BY retained DESC, instances DESC, loader) FILTER (k <= 8) AS shown FROM (SELECT *, row_number() OVER (PARTITION BY class_name ORDER BY retained DESC, instances DESC, loader) AS k FROM ({HIST})) GROUP BY 1 HAVING count(*) > 1 ORDER BY retained DESC, class_name LIMIT 20")
over_heap("top_components", lambda h: V.top_components(h.tree), f", g AS (SELECT loader, class_name, count(*) AS objects, CAST(sum(retained) AS BIGINT) AS retained FROM d WHERE idom = -1 GROUP BY 1, 2), c AS (SELECT loader, CAST(sum(retained) AS BIGINT) AS component_retained FROM g GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10) SELECT loader, class_name, objects, retained, component_retained, class_rank, {bp('component_retained')} AS component_bp FROM (SELECT g.*, component_retained, CAST(row_number() OVER (PARTITION BY loader ORDER BY retained DESC, class_name) AS INTEGER) AS class_rank FROM g JOIN c USING (loader)) WHERE class_rank <= 5")
over_heap("boxed_numbers", lambda h: V.boxed_numbers(h.tree), f"SELECT class_name, instances, shallow, {bp('shallow')} AS heap_bp, CAST(shallow // instances AS BIGINT) AS mean_size FROM ({HIST}) WHERE class_name = 'java.lang.Double'")
over_heap("header_overhead", lambda h: V.header_overhead(h.tree), f"SELECT class_name, loader, instances, shallow, instances * 12 AS header_bytes, {bp('instances * 12', 'shallow')} AS header_bp, CAST(shallow // instances AS BIGINT) AS mean_size FROM ({HIST}) WHERE instances * 120 >= shallow * 3 OR instances * 12 >= 1048576 ORDER BY header_bytes DESC, class_name, loader LIMIT 30")
over_heap("top_class_share", lambda h: V.top_class_share(h.tree), f"SELECT class_name, loader, retained, {bp('retained', '(SELECT sum(retained) FROM d WHERE idom = -1)')} AS share_bp FROM ({HIST}) ORDER BY retained DESC, class_name, loader LIMIT 1")
over_heap("unreachable_histogram", lambda h: V.unreachable_histogram(h.forest, h.tree), "SELECT class_name, loader, count(*) AS objects, CAST(sum(shallow) AS BIGINT) AS shallow, CAST(sum(shallow) AS BIGINT) AS retained FROM d WHERE idom IS NULL GROUP BY 1, 2")
over_heap("unreachable_forest", lambda h: h.forest.select("obj_id", "idom", "retained", "same_class"), ", p AS (SELECT p_partkey AS k, 5000000000000000000 + p_partkey AS obj_id, (p_partkey + 9) // 10 AS g FROM part) SELECT obj_id, CASE WHEN k % 10 = 1 OR k = 0 THEN -1 ELSE obj_id - 1 END AS idom, CAST(48 * count(*) OVER (PARTITION BY g ORDER BY k DESC) AS BIGINT) AS retained, k % 10 <> 1 AND k <> 0 AS same_class FROM p")
over_heap("garbage_roots", lambda h: V.garbage_roots(h.forest, h.tree), "SELECT CAST(5000000000000000000 + min(p_partkey) AS BIGINT) AS obj_id, 48 * count(*) AS retained, count(*) AS objects, 'com.shop.stock.Part' AS class_name FROM part GROUP BY (p_partkey + 9) // 10 ORDER BY retained DESC, obj_id LIMIT 10")
over_heap("arrays_by_size", lambda h: V.arrays_by_size(h.tree), "SELECT 'Object arrays' AS object_kind, CAST(CASE WHEN elements = 0 THEN 0 WHEN elements <= 1 THEN 1 WHEN elements <= 2 THEN 2 WHEN elements <= 4 THEN 4 WHEN elements <= 8 THEN 8 WHEN elements <= 16 THEN 16 ELSE 32 END AS BIGINT) AS length_to, count(*) AS objects, CAST(sum(shallow) AS BIGINT) AS shallow FROM d WHERE kind = 1 GROUP BY 2")
_P2 = "CAST(CASE WHEN {x} <= 1 THEN 1 ELSE 1::BIGINT << CAST(length(bin({x} - 1)) AS INTEGER) END AS BIGINT)"
over_heap("top_sizes", lambda h: V.top_sizes(h.tree), f"SELECT {_P2.format(x='retained')} AS retained_to, count(*) AS objects, CAST(sum(retained) AS BIGINT) AS retained FROM d WHERE idom = -1 GROUP BY 1")
over_heap("top_size_stats", lambda h: V.top_size_stats(h.tree), f", {_TOPS} SELECT (SELECT count(*) FROM t) AS n, (SELECT min(retained) FROM t) AS least, (SELECT max(retained) FROM t) AS largest, retained AS median, CAST((SELECT sum(retained) FROM t) AS BIGINT) AS total FROM t WHERE k = (SELECT count(*) // 2 + 1 FROM t)")
over_heap("biggest_objects", lambda h: V.biggest_objects(h.tree), f"SELECT obj_id, class_name, shallow, retained, {bp('retained')} AS heap_bp FROM d WHERE idom = -1 ORDER BY retained DESC, obj_id LIMIT 20")
over_heap("biggest_classes", lambda h: V.biggest_classes(h.tree), f"SELECT class_name, loader, count(*) AS objects, CAST(sum(retained) AS BIGINT) AS retained, {bp('sum(retained)')} AS heap_bp FROM d WHERE idom = -1 GROUP BY 1, 2 ORDER BY retained DESC, class_name, loader LIMIT 20")
over_heap("package_tree", lambda h: V.package_tree(h.tree), f", p AS (SELECT *, CASE WHEN class_name LIKE 'com.shop.%' THEN string_split(regexp_replace(class_name, '\\.[A-Za-z\\[\\]]*$', ''), '.') ELSE ['java', 'lang'] END AS parts FROM d WHERE idom = -1), e AS (SELECT shallow, retained, unnest([array_to_string(parts[1:i], '.') FOR i IN range(1, len(parts) + 1)]) AS package FROM p) SELECT package, count(*) AS objects, CAST(sum(shallow) AS BIGINT) AS shallow, CAST(sum(retained) AS BIGINT) AS retained FROM e GROUP BY 1 HAVING sum(retained) * 10000 >= {TOTAL} * 100")
over_heap("leak_suspects", lambda h: V.leak_suspects(h.tree), f", s AS (SELECT * FROM d WHERE idom = -1 AND retained * 100 >= {TOTAL} * 10), g AS (SELECT class_name, loader, count(*) AS objects, sum(shallow) AS shallow, sum(retained) AS retained FROM d WHERE idom = -1 GROUP BY 1, 2) SELECT 'single' AS suspect, obj_id, class_name, loader, 1::BIGINT AS objects, shallow, retained, {bp('retained')} AS heap_bp FROM s UNION ALL SELECT 'group', NULL, class_name, loader, objects, CAST(shallow AS BIGINT), CAST(retained AS BIGINT), {bp('retained')} FROM g WHERE retained * 100 >= {TOTAL} * 10 AND (class_name, loader) NOT IN (SELECT (class_name, loader) FROM s)")
over_heap("big_drops", lambda h: V.big_drops(h.tree), f", b AS (SELECT idom AS obj_id, max(retained) AS c FROM d WHERE idom >= 0 GROUP BY 1) SELECT obj_id, class_name, retained, CAST(coalesce(c, 0) AS BIGINT) AS child_retained, CAST(retained - coalesce(c, 0) AS BIGINT) AS drop FROM d LEFT JOIN b USING (obj_id) WHERE idom IS NOT NULL AND retained - coalesce(c, 0) > 0 AND (retained - coalesce(c, 0)) * 100 >= {TOTAL} ORDER BY drop DESC, obj_id LIMIT 25")
over_heap("immediate_dominators", lambda h: V.immediate_dominators(h.tree), ", b AS (SELECT idom, count(*) AS n, sum(shallow) AS s FROM d WHERE idom >= 0 GROUP BY 1) SELECT class_name, count(*) AS dominators, CAST(sum(shallow) AS BIGINT) AS dominators_shallow, CAST(sum(n) AS BIGINT) AS dominated, CAST(sum(s) AS BIGINT) AS dominated_shallow FROM b JOIN d ON d.obj_id = b.idom GROUP BY 1 ORDER BY dominated_shallow DESC, dominated DESC, class_name LIMIT 30")
over_heap("merged_root_paths", lambda h: V.merged_root_paths(h.tree), f", w AS (SELECT shallow, CASE class_name WHEN 'com.shop.geo.Region' THEN ['Region'] WHEN 'com.shop.geo.Nation' THEN ['Region', 'Nation'] WHEN 'com.shop.party.Customer' THEN ['Region', 'Nation', 'Customer'] WHEN 'com.shop.party.Supplier' THEN ['Region', 'Nation', 'Supplier'] WHEN 'java.lang.Double' THEN ['Region', 'Nation', 'Supplier', 'Double'] WHEN 'com.shop.sales.Order' THEN ['Region', 'Nation', 'Customer', 'Order'] ELSE CASE depth WHEN 1 THEN ['Items'] WHEN 2 THEN ['Region', 'Items'] ELSE ['Region', 'Nation', 'Items'] END END AS way FROM {LIVE}), e AS (SELECT shallow, unnest([array_to_string(list_transform(way[1:i], lambda x: CASE x WHEN 'Region' THEN 'com.shop.geo.Region' WHEN 'Nation' THEN 'com.shop.geo.Nation' WHEN 'Customer' THEN 'com.shop.party.Customer' WHEN 'Supplier' THEN 'com.shop.party.Supplier' WHEN 'Order' THEN 'com.shop.sales.Order' WHEN 'Double' THEN 'java.lang.Double' ELSE 'com.shop.sales.LineItem[]' END), ' > ') FOR i IN range(1, len(way) + 1)]) AS path FROM w) SELECT path, count(*) AS objects, CAST(sum(shallow) AS BIGINT) AS retained FROM e GROUP BY 1 ORDER BY retained DESC, path LIMIT 60")
over_heap("allocation_sites", lambda h: V.allocation_sites(h.tree), "SELECT alloc_serial, count(*) AS objects, CAST(sum(shallow) AS BIGINT) AS shallow, CAST(sum(coalesce(retained, 0)) AS BIGINT) AS retained FROM d WHERE alloc_serial <> 0 GROUP BY 1 ORDER BY objects DESC, retained DESC, alloc_serial LIMIT 50")
_HEAVY = """, t AS (SELECT sum(shallow) AS total FROM d WHERE idom IS NOT NULL),
c AS (SELECT idom AS obj_id, obj_id AS child, retained AS r, row_number() OVER (PARTITION BY idom ORDER BY retained DESC, obj_id) AS k FROM d WHERE idom >= 0),
h AS (SELECT c.obj_id, c.child FROM c JOIN d USING (obj_id) WHERE c.k = 1 AND c.r >= 0.7 * d.retained),
s AS (SELECT obj_id FROM d, t WHERE idom = -1 AND retained * 100 >= total * 10),
w AS (SELECT s.obj_id, coalesce(h4.child, h3.child, h2.child, h1.child, s.obj_id) AS point,
             (h1.child IS NOT NULL)::INT + (h2.child IS NOT NULL)::INT + (h3.child IS NOT NULL)::INT + (h4.child IS NOT NULL)::INT AS hops
      FROM s LEFT JOIN h h1 ON h1.obj_id = s.obj_id LEFT JOIN h h2 ON h2.obj_id = h1.child LEFT JOIN h h3 ON h3.obj_id = h2.child LEFT JOIN h h4 ON h4.obj_id = h3.child)
"""
over_heap("suspects_descent", lambda h: V.suspects_descent(h.tree), _HEAVY + "SELECT w.obj_id, point, hops, class_name AS point_class, retained AS point_retained FROM w JOIN d ON d.obj_id = point")
over_heap("heaviest_nodes", lambda h: V.heaviest_nodes(h.tree).drop("objects"), "SELECT obj_id, idom, depth, class_name, shallow, retained FROM d WHERE idom IS NOT NULL AND depth <= 20 ORDER BY retained DESC, depth, obj_id LIMIT 5000")
over_heap(
    "point_children",
    lambda h: V.point_children(h.tree, V.suspects_descent(h.tree)),
    _HEAVY
    + """SELECT point, k AS child_rank, d.obj_id, d.class_name, d.shallow, d.retained
FROM (SELECT DISTINCT point FROM w) JOIN c ON c.obj_id = point JOIN d ON d.obj_id = c.child WHERE k <= 50""",
)
_BEST = """, b AS (SELECT *, row_number() OVER (PARTITION BY class_name ORDER BY retained DESC, obj_id) AS k FROM d WHERE idom IS NOT NULL)
SELECT b.class_name AS of_class, concat_ws(' > ', d3.class_name, d2.class_name, d1.class_name, b.class_name) AS path
FROM b LEFT JOIN d d1 ON d1.obj_id = b.idom LEFT JOIN d d2 ON d2.obj_id = d1.idom LEFT JOIN d d3 ON d3.obj_id = d2.idom WHERE k = 1
"""
over_heap("root_path", lambda h: V.root_path(h.tree), _BEST)

# Contents: strings are the documents' texts, primitive arrays the embeddings, collections the conversations.
_FILES = lambda spark, sf_dir, name: spark.read.parquet(f"{sf_dir}/{name}.parquet")


def strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _FILES(spark, sf_dir, "documents").select(F.col("doc_id").alias("obj_id"), F.col("text").alias("value"))


def char_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    return strings(spark, sf_dir).select("obj_id", F.octet_length("value").cast("long").alias("used"), S.next_power_of_two(F.octet_length("value")).alias("capacity"))


def float_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _FILES(spark, sf_dir, "embeddings")
    flat = F.when(F.pmod("vec_id", F.lit(7)) == 0, F.transform("embedding", lambda x: F.pmod(F.col("label"), F.lit(3)).cast("float"))).otherwise(F.col("embedding"))
    return e.select(F.col("vec_id").alias("obj_id"), F.lit("float[]").alias("class_name"), flat.alias("items"), F.concat(F.lit("Label"), F.col("label").cast("string")).alias("owner"))


def collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _FILES(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("obj_id")).agg(F.count("*").alias("elements"))
    kind = F.element_at(F.array(*map(F.lit, ("List", "Map", "Set"))), (F.pmod("obj_id", F.lit(3)) + 1).cast("int"))
    return c.select("obj_id", kind.alias("kind"), "elements", (F.when(F.pmod("obj_id", F.lit(5)) == 0, 64).otherwise(8)).cast("long").alias("capacity"), (16 + 8 * F.col("elements")).cast("long").alias("shallow"))


_STR = "s AS (SELECT text AS value, count(*) AS n, octet_length(encode(text)) AS bytes FROM documents GROUP BY 1)"
query("duplicate_strings", lambda sp, d: C.duplicate_strings(strings(sp, d)), f"WITH {_STR} SELECT value, n AS copies, CAST(bytes AS BIGINT) AS bytes, CAST((n - 1) * bytes AS BIGINT) AS wasted FROM s WHERE n > 1 ORDER BY copies DESC, value LIMIT 25")
query("longest_strings", lambda sp, d: C.longest_strings(strings(sp, d)), f"WITH {_STR} SELECT value, n AS copies, CAST(bytes AS BIGINT) AS bytes FROM s ORDER BY bytes DESC, value LIMIT 25")
query("string_stats", lambda sp, d: C.string_stats(strings(sp, d)), f"WITH {_STR}, k AS (SELECT bytes, row_number() OVER (ORDER BY bytes) AS k FROM s) SELECT CAST(sum(n) AS BIGINT) AS strings, count(*) AS distinct_values, count(*) FILTER (n > 1) AS duplicated_values, CAST(sum((n - 1) * bytes) AS BIGINT) AS wasted, CAST(min(bytes) AS BIGINT) AS least, CAST(max(bytes) AS BIGINT) AS largest, CAST((SELECT bytes FROM k WHERE k = (SELECT count(*) // 2 + 1 FROM s)) AS BIGINT) AS median, CAST(sum(bytes) AS BIGINT) AS total FROM s")
query("string_lengths", lambda sp, d: C.string_lengths(strings(sp, d)), f"WITH {_STR} SELECT {_P2.format(x='bytes')} AS length_to, count(*) AS distinct_values FROM s GROUP BY 1")
_CHR = f"c AS (SELECT doc_id AS obj_id, CAST(octet_length(encode(text)) AS BIGINT) AS used, {_P2.format(x='octet_length(encode(text))')} AS capacity FROM documents), w AS (SELECT *, greatest(capacity - used, 0) AS wasted FROM c)"
query("char_array_waste", lambda sp, d: C.char_array_waste(char_arrays(sp, d)), f"WITH {_CHR} SELECT count(*) AS examined, count(*) FILTER (wasted > 0) AS wasteful, CAST(sum(wasted) AS BIGINT) AS wasted FROM w")
query("top_char_waste", lambda sp, d: C.top_char_waste(char_arrays(sp, d)), f"WITH {_CHR} SELECT obj_id, used, capacity, wasted FROM w ORDER BY wasted DESC, obj_id LIMIT 25")
_ARR = "a AS (SELECT vec_id AS obj_id, CASE WHEN vec_id % 7 = 0 THEN list_transform(embedding, lambda x: CAST(label % 3 AS FLOAT)) ELSE embedding END AS items, 'Label' || label AS owner FROM embeddings)"
query("duplicate_arrays", lambda sp, d: C.duplicate_arrays(float_arrays(sp, d)), f"WITH {_ARR}, g AS (SELECT items, count(*) AS n, len(items) * 4 AS bytes FROM a GROUP BY 1 HAVING count(*) > 1) SELECT 'float[]' AS class_name, count(*) AS \"groups\", CAST(sum(n) AS BIGINT) AS arrays, CAST(sum((n - 1) * bytes) AS BIGINT) AS wasted FROM g HAVING count(*) > 0")
query("constant_arrays", lambda sp, d: C.constant_arrays(float_arrays(sp, d)), f"WITH {_ARR}, c AS (SELECT len(items) AS length, CAST(items[1] AS DOUBLE) AS value, owner FROM a WHERE len(items) >= 2 AND list_min(items) = list_max(items)), o AS (SELECT length, value, owner, count(*) AS n, row_number() OVER (PARTITION BY length, value ORDER BY count(*) DESC, owner) AS k FROM c GROUP BY 1, 2, 3) SELECT 'float[]' AS class_name, CAST(length AS INTEGER) AS length, value, CAST(sum(n) AS BIGINT) AS objects, CAST(sum(n * length * 4) AS BIGINT) AS bytes, max(owner) FILTER (k = 1) AS main_owner FROM o GROUP BY 2, 3")
query("top_arrays", lambda sp, d: C.top_arrays(float_arrays(sp, d)), f"WITH {_ARR} SELECT 'float[]' AS class_name, count(*) AS arrays, CAST(sum(len(items) * 4) AS BIGINT) AS bytes, CAST(max(len(items)) AS INTEGER) AS longest FROM a")
_COL = "c AS (SELECT conv_id AS obj_id, ['List', 'Map', 'Set'][conv_id % 3 + 1] AS kind, count(*) AS elements, CAST(CASE WHEN conv_id % 5 = 0 THEN 64 ELSE 8 END AS BIGINT) AS capacity, 16 + 8 * count(*) AS shallow FROM conversations GROUP BY conv_id)"
_BKT = "CAST(CASE WHEN {b} >= 10000 THEN 10 WHEN {b} <= 0 THEN 0 ELSE ({b} - 1) // 1000 END AS INTEGER)"
query("collection_fill", lambda sp, d: C.fill_ratios(collections(sp, d)), f"WITH {_COL}, b AS (SELECT {_BKT.format(b='(elements * 10000 // capacity)')} AS bucket, count(*) AS objects, sum(shallow) AS shallow, sum(greatest(capacity - elements, 0) * 4) AS wasted FROM c GROUP BY 1) SELECT CAST(r.bucket AS INTEGER) AS bucket, coalesce(objects, 0) AS objects, CAST(coalesce(shallow, 0) AS BIGINT) AS shallow, CAST(coalesce(wasted, 0) AS BIGINT) AS wasted FROM range(11) r(bucket) LEFT JOIN b ON b.bucket = r.bucket")
query("map_collisions", lambda sp, d: C.fill_ratios(collections(sp, d).where("kind = 'Map'")).select("bucket", "objects", "shallow"), f"WITH {_COL}, b AS (SELECT {_BKT.format(b='(elements * 10000 // capacity)')} AS bucket, count(*) AS objects, sum(shallow) AS shallow FROM c WHERE kind = 'Map' GROUP BY 1) SELECT CAST(r.bucket AS INTEGER) AS bucket, coalesce(objects, 0) AS objects, CAST(coalesce(shallow, 0) AS BIGINT) AS shallow FROM range(11) r(bucket) LEFT JOIN b ON b.bucket = r.bucket")
query("collections_by_size", lambda sp, d: C.collections_by_size(collections(sp, d)), f"WITH {_COL} SELECT CASE WHEN elements = 0 THEN 0 ELSE {_P2.format(x='elements')} END AS elements_to, count(*) AS objects, CAST(sum(shallow) AS BIGINT) AS shallow FROM c GROUP BY 1")
query("collections_by_kind", lambda sp, d: C.collections_by_kind(collections(sp, d)), f"WITH {_COL} SELECT kind, count(*) AS objects, CAST(sum(elements) AS BIGINT) AS elements, CAST(sum(shallow) AS BIGINT) AS shallow, max(elements) AS largest FROM c GROUP BY 1")
_CON = "v AS (SELECT conv_id AS obj_id, role AS value_class, count(*) AS n FROM conversations GROUP BY 1, 2)"


def contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _FILES(spark, sf_dir, "conversations").select(F.col("conv_id").alias("obj_id"), F.col("role").alias("value_class"))


query("biggest_collections", lambda sp, d: C.biggest_collections(collections(sp, d), contents(sp, d)), f"WITH {_COL}, {_CON}, b AS (SELECT * FROM c ORDER BY elements DESC, obj_id LIMIT 25), r AS (SELECT obj_id, value_class, n, row_number() OVER (PARTITION BY obj_id ORDER BY n DESC, value_class) AS k FROM v) SELECT obj_id, kind, elements, string_agg(value_class || ':' || n, ',' ORDER BY k) AS types FROM b JOIN r USING (obj_id) WHERE k <= 4 GROUP BY 1, 2, 3")
query("collection_contents", lambda sp, d: C.collection_contents(collections(sp, d), contents(sp, d)), f"WITH {_COL}, {_CON}, s AS (SELECT kind, value_class, sum(n) AS n FROM c JOIN v USING (obj_id) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY n DESC, value_class) AS k FROM s) SELECT kind, CAST(sum(n) AS BIGINT) AS \"values\", (SELECT count(*) FROM c WHERE c.kind = r.kind) AS collections, string_agg(value_class || ':' || CAST(n AS BIGINT), ',' ORDER BY k) FILTER (k <= 5) AS types FROM r GROUP BY 1")


def held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as containers of orders, held by fields named after orders' status and priority."""
    o = _FILES(spark, sf_dir, "orders")
    # a sum of doubles depends on its order: that of the file, as in the SQL on one thread, however the file is split
    place = ["file_path", "row_index"][len(o.inputFiles()) < 2 :]
    upto = W.partitionBy("o_custkey").orderBy(*place).rowsBetween(W.unboundedPreceding, 0)
    sums = o.select("o_custkey", "o_totalprice", *[f"_metadata.{x}" for x in place]).select("o_custkey", F.count("*").over(upto).alias("k"), F.sum("o_totalprice").over(upto).alias("s"))
    size = sums.groupBy("o_custkey").agg(F.max("k").alias("elements"), F.floor(F.max_by("s", "k")).cast("long").alias("retained"))
    kind = F.when(F.pmod("o_custkey", F.lit(2)) == 0, "List").otherwise("Map")
    return o.select("o_custkey", F.col("o_orderpriority").alias("holder"), F.col("o_orderstatus").alias("field")).join(size, "o_custkey").select("holder", "field", F.col("o_custkey").alias("container"), "elements", "retained", kind.alias("kind"), F.concat(F.lit("T"), F.pmod("o_custkey", F.lit(3)).cast("string")).alias("type"))


_HELD = "z AS (SELECT o_custkey, count(*) AS elements, CAST(floor(sum(o_totalprice)) AS BIGINT) AS retained FROM orders GROUP BY 1), h AS (SELECT DISTINCT o_orderpriority AS holder, o_orderstatus AS field, o_custkey AS container, elements, retained, CASE WHEN o_custkey % 2 = 0 THEN 'List' ELSE 'Map' END AS kind, 'T' || o_custkey % 3 AS type FROM orders JOIN z USING (o_custkey))"
query("attribution_overall", lambda sp, d: C.attribution_overall(held(sp, d)), f"WITH {_HELD} SELECT holder, field, count(*) AS containers, CAST(sum(elements) AS BIGINT) AS elements, CASE WHEN count(DISTINCT kind) > 1 THEN 'mixed' ELSE min(kind) END AS kind FROM h GROUP BY 1, 2 ORDER BY elements DESC, holder, field LIMIT 25")
query("attribution_single", lambda sp, d: C.attribution_single(held(sp, d)), f"WITH {_HELD}, r AS (SELECT *, row_number() OVER (PARTITION BY holder, field ORDER BY elements DESC, retained DESC, container) AS k FROM h) SELECT holder, field, container, elements, retained FROM r WHERE k = 1 ORDER BY elements DESC, holder, field LIMIT 25")
query("fields_by_size", lambda sp, d: C.fields_by_size(held(sp, d)), f"WITH {_HELD}, t AS (SELECT holder, field, type, sum(retained) AS r FROM h GROUP BY 1, 2, 3), m AS (SELECT holder, field, CASE WHEN count(*) = 1 OR max(r) * 2 > sum(r) THEN arg_max(type, r) ELSE 'varies' END AS main_type FROM t GROUP BY 1, 2) SELECT holder, field, count(*) AS pointees, CAST(sum(retained) AS BIGINT) AS retained, any_value(main_type) AS main_type FROM h JOIN m USING (holder, field) GROUP BY 1, 2 ORDER BY retained DESC, pointees DESC, holder, field LIMIT 25")


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _FILES(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("kind"), F.concat(F.lit("Referent"), F.pmod("user_id", F.lit(30)).cast("string")).alias("class_name"), F.lit(24).cast("long").alias("shallow"), (F.col("value") > 50).alias("reachable"))


_REF = "r AS (SELECT event_type AS kind, 'Referent' || user_id % 30 AS class_name, value > 50 AS reachable FROM events)"
query("reference_histogram", lambda sp, d: C.reference_histogram(references(sp, d), cap=20), f"WITH {_REF}, g AS (SELECT kind, class_name, count(*) AS objects, row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, class_name) AS k FROM r GROUP BY 1, 2) SELECT kind, CASE WHEN k <= 20 THEN class_name ELSE '<other>' END AS class_name, CAST(sum(objects) AS BIGINT) AS objects, CAST(sum(objects * 24) AS BIGINT) AS shallow FROM g GROUP BY 1, 2")
query("only_weakly_retained", lambda sp, d: C.only_weakly_retained(references(sp, d)), f"WITH {_REF} SELECT kind, class_name, count(*) AS objects, CAST(24 * count(*) AS BIGINT) AS shallow FROM r WHERE NOT reachable GROUP BY 1, 2")


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly reports: an event type and user group is a class, its values the retained size."""
    e = _FILES(spark, sf_dir, "events")
    week = F.floor(F.unix_timestamp("ts") / 604800)
    rows = e.select(week.alias("w"), F.concat_ws(".", F.col("event_type"), F.pmod("user_id", F.lit(5)).cast("string")).alias("class_name"), F.floor("value").cast("long").alias("v"))
    return rows.groupBy("w", "class_name").agg(F.count("*").alias("instances"), F.sum("v").alias("retained")).where("NOT (w % 2 = 0 AND class_name LIKE '%.3')").withColumn("report", F.dense_rank().over(W.orderBy("w")) - 1).drop("w")


_REP = "e AS (SELECT CAST(floor(epoch(ts) / 604800) AS BIGINT) AS w, event_type || '.' || user_id % 5 AS class_name, CAST(floor(value) AS BIGINT) AS v FROM events), q AS (SELECT w, class_name, count(*) AS instances, CAST(sum(v) AS BIGINT) AS retained FROM e GROUP BY 1, 2 HAVING NOT (w % 2 = 0 AND class_name LIKE '%.3')), p AS (SELECT *, dense_rank() OVER (ORDER BY w) - 1 AS report FROM q), f AS (SELECT class_name, sum(retained) FILTER (report = 0) AS first_retained, sum(retained) FILTER (report = (SELECT max(report) FROM p)) AS last_retained, sum(instances) FILTER (report = 0) AS first_instances, sum(instances) FILTER (report = (SELECT max(report) FROM p)) AS last_instances FROM p GROUP BY 1)"
query("growth", lambda sp, d: G.growth(reports(sp, d)), f"WITH {_REP} SELECT class_name, CASE WHEN first_retained IS NULL AND last_retained IS NULL THEN 'passing' WHEN first_retained IS NULL THEN 'new' WHEN last_retained IS NULL THEN 'gone' ELSE 'kept' END AS state, CAST(coalesce(first_retained, 0) AS BIGINT) AS first_retained, CAST(coalesce(last_retained, 0) AS BIGINT) AS last_retained, CAST(coalesce(last_retained, 0) - coalesce(first_retained, 0) AS BIGINT) AS delta_retained, CAST(coalesce(last_instances, 0) - coalesce(first_instances, 0) AS BIGINT) AS delta_instances FROM f")
query("growth_series", lambda sp, d: G.series(reports(sp, d)), f"WITH {_REP} SELECT class_name, report, retained, CAST(retained - lag(retained) OVER (PARTITION BY class_name ORDER BY report) AS BIGINT) AS step FROM p")
query(
    "growth_histories",
    lambda sp, d: G.histories(reports(sp, d)).select("class_name", "state", "delta_retained", *[F.array_join(c, ",").alias(c) for c in ("retained", "instances")]),
    f"""WITH {_REP}, n AS (SELECT DISTINCT report FROM p), a AS (SELECT class_name, n.report,
  CAST(coalesce(p.retained, 0) AS BIGINT) AS r, coalesce(p.instances, 0) AS i, p.report IS NOT NULL AS there
  FROM (SELECT DISTINCT class_name FROM p) c CROSS JOIN n LEFT JOIN p USING (class_name, report))
SELECT class_name, CASE WHEN arg_min(there, report) AND arg_max(there, report) THEN 'kept' WHEN arg_min(there, report) THEN 'gone'
  WHEN arg_max(there, report) THEN 'new' ELSE 'passing' END AS state, CAST(arg_max(r, report) - arg_min(r, report) AS BIGINT) AS delta_retained,
  string_agg(r, ',' ORDER BY report) AS retained, string_agg(i, ',' ORDER BY report) AS instances FROM a GROUP BY 1""",
)
query(
    "heavy_class_changes",
    lambda sp, d: G.growth(G.heavy_classes(reports(sp, d), 5)).select("class_name", "state", "first_retained", "last_retained"),
    f"""WITH {_REP}, x AS (SELECT * FROM p QUALIFY retained * 100 >= 5 * sum(retained) OVER (PARTITION BY report)),
y AS (SELECT class_name, sum(retained) FILTER (report = 0) AS fr, sum(retained) FILTER (report = (SELECT max(report) FROM x)) AS lr FROM x GROUP BY 1)
SELECT class_name, CASE WHEN fr IS NULL AND lr IS NULL THEN 'passing' WHEN fr IS NULL THEN 'new' WHEN lr IS NULL THEN 'gone' ELSE 'kept' END AS state,
  CAST(coalesce(fr, 0) AS BIGINT) AS first_retained, CAST(coalesce(lr, 0) AS BIGINT) AS last_retained FROM y""",
)
_NEW_SQL = "SELECT class_name FROM p GROUP BY 1 HAVING count(*) FILTER (report = 0 AND class_name NOT LIKE '%.4') = 0 AND count(*) FILTER (report = (SELECT max(report) FROM p)) > 0"
query("new_classes", lambda sp, d: G.growth(reports(sp, d).where("NOT (report = 0 AND class_name LIKE '%.4')")).where("state = 'new'").select("class_name"), f"WITH {_REP} {_NEW_SQL}")


# Functions and joins on plain tables.
def _functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _FILES(spark, sf_dir, "part")
    n = F.col("p_size").cast("long")
    return p.select(
        "p_partkey", S.next_power_of_two(n).alias("power"), S.ratio_bucket(n * 200).alias("bucket"), S.basis_points(n, F.lit(50)).alias("bp"), S.align_up(n, 8).alias("aligned"),
        S.instance_size(n, F.lit(2)).alias("instance_size"), S.object_array_size(n).alias("array_size"), S.primitive_array_size(n, F.lit(2)).alias("chars_size"), S.class_object_size(n, F.lit(1)).alias("class_size"),
        S.saturated(n * 10**9).alias("saturated"), F.round(S.percent(n, F.lit(64)), 4).alias("pct"), S.at_least_header(F.lit(0), F.lit(0)).alias("header"),
    )


_AL = "CAST(({x} + {a} - 1) // {a} * {a} AS BIGINT)"
query("size_functions", _functions, f"SELECT p_partkey, {_P2.format(x='p_size')} AS power, {_BKT.format(b='(p_size * 200)')} AS bucket, CAST(p_size * 10000 // 50 AS BIGINT) AS bp, {_AL.format(x='p_size', a=8)} AS aligned, {_AL.format(x=_AL.format(x='12 + p_size + 8', a=4), a=8)} AS instance_size, {_AL.format(x='16 + 4 * p_size', a=8)} AS array_size, {_AL.format(x='16 + 2 * p_size', a=8)} AS chars_size, {_AL.format(x='p_size + 4', a=8)} AS class_size, least(p_size::BIGINT * 1000000000, 4294967295) AS saturated, round(p_size / 64.0 * 100, 4) AS pct, CAST(16 AS BIGINT) AS header FROM part")


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _FILES(spark, sf_dir, "pages")
    host = F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1)
    raw = F.concat(F.repeat(F.lit("["), F.pmod("page_id", F.lit(3)).cast("int")), F.when(F.pmod("page_id", F.lit(3)) > 0, F.concat(F.lit("L"), F.translate(host, ".", "/"), F.lit(";"))).otherwise(F.translate(host, ".", "/")))
    pretty = S.pretty_class_name(raw)
    return pages.select("page_id", pretty.alias("pretty"), S.package_path(pretty).alias("package"), F.size(S.package_prefixes(S.package_path(pretty))).alias("levels"), S.is_anonymous(F.concat(pretty, F.lit("$"), F.col("page_id").cast("string"))).alias("anonymous"), S.pointee_category(pretty).alias("category"), S.root_label(F.pmod("page_id", F.lit(9)).cast("int")).alias("label"), S.thread_state(F.pmod("page_id", F.lit(8)).cast("int")).alias("state"))


_LBL = "['System Class', 'JNI Global', 'JNI Local', 'Java Local', 'Native Stack', 'Sticky Class', 'Thread Block', 'Busy Monitor', 'Thread'][page_id % 9 + 1]"
query("name_functions", _names, f"WITH p AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages) SELECT page_id, host || repeat('[]', CAST(page_id % 3 AS INTEGER)) AS pretty, regexp_replace(host, '\\.[^.]*$', '') AS package, CAST(len(string_split(regexp_replace(host, '\\.[^.]*$', ''), '.')) AS INTEGER) AS levels, true AS anonymous, CASE WHEN page_id % 3 > 0 THEN 'array' ELSE 'object' END AS category, {_LBL} AS label, CASE page_id % 8 & 7 WHEN 0 THEN 'unknown' WHEN 1 THEN 'alive' WHEN 2 THEN 'terminated' WHEN 3 THEN 'alive, terminated' WHEN 4 THEN 'runnable' WHEN 5 THEN 'alive, runnable' WHEN 6 THEN 'terminated, runnable' ELSE 'alive, terminated, runnable' END AS state FROM p")


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _FILES(spark, sf_dir, "customer")
    shown = F.format_number(F.col("c_custkey") * 1234, 0)
    both = S.parsed_bytes(F.concat(shown, F.lit(" ("), F.format_string("%.2f", F.pmod("c_custkey", F.lit(100)) / 4), F.lit("%)")))
    return c.select("c_custkey", S.parsed_int(shown).alias("number"), both["bytes"].alias("bytes"), both["pct"].alias("pct"), S.class_and_field(F.concat(F.lit("a/B#f"), F.col("c_custkey").cast("string")))["field"].alias("field"), S.bare_array_label(F.concat(F.lit("int["), F.col("c_custkey").cast("string"), F.lit("]"))).alias("label"), S.millis_label(F.col("c_custkey") * 86_400_000).alias("day"), S.frame_text(F.lit("a/B"), F.lit("run"), F.lit("B.java"), F.pmod("c_custkey", F.lit(5)).cast("int") - 3).alias("frame"))


query("text_functions", _parsed, "SELECT c_custkey, c_custkey * 1234 AS number, c_custkey * 1234 AS bytes, (c_custkey % 100) / 4.0::DOUBLE AS pct, 'f' || c_custkey AS field, 'int[]' AS label, CASE WHEN c_custkey <> 0 THEN strftime(make_timestamp(c_custkey * 86400000000), '%Y-%m-%d %H:%M:%S') END AS day, CASE c_custkey % 5 - 3 WHEN 1 THEN 'a.B.run(B.java:1)' WHEN -2 THEN 'a.B.run(B.java(Compiled method))' WHEN -3 THEN 'a.B.run(Native Method)' ELSE 'a.B.run(B.java)' END AS frame FROM customer")


def _arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _FILES(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.pmod("event_id", F.lit(4)))).alias("refs"))
    return e.select("user_id", S.used_slots("refs").alias("used"), S.all_equal("refs").alias("constant"))


query("array_functions", _arrays, "SELECT user_id, CAST(count(*) FILTER (event_id % 4 <> 0) AS INTEGER) AS used, count(DISTINCT event_id % 4) = 1 AS constant FROM events GROUP BY 1")
query("array_fill", lambda sp, d: C.array_fill_ratios(_FILES(sp, d, "events").groupBy("user_id").agg(F.collect_list(F.pmod("event_id", F.lit(4))).alias("refs"), F.count("*").alias("shallow"))), f"WITH a AS (SELECT count(*) AS capacity, count(*) FILTER (event_id % 4 <> 0) AS elements FROM events GROUP BY user_id), b AS (SELECT {_BKT.format(b='(elements * 10000 // capacity)')} AS bucket, count(*) AS objects, sum(capacity) AS shallow, sum((capacity - elements) * 4) AS wasted FROM a GROUP BY 1) SELECT CAST(r.bucket AS INTEGER) AS bucket, coalesce(objects, 0) AS objects, CAST(coalesce(shallow, 0) AS BIGINT) AS shallow, CAST(coalesce(wasted, 0) AS BIGINT) AS wasted FROM range(11) r(bucket) LEFT JOIN b ON b.bucket = r.bucket")
query("holder_ranking", lambda sp, d: C.holder_ranking(_FILES(sp, d, "orders").select(F.col("o_orderpriority").alias("holder"), F.col("o_custkey").alias("ref")), _FILES(sp, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("obj_id"))), "SELECT o_orderpriority AS holder, count(*) AS refs FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING') GROUP BY 1 ORDER BY refs DESC, holder LIMIT 25")


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    o = _FILES(spark, sf_dir, "orders").select(F.concat(F.lit("C"), F.pmod("o_custkey", F.lit(97)).cast("string")).alias("class_name"), "o_orderkey")
    side = lambda cond, skew: o.where(cond).groupBy("class_name").agg(F.count("*").alias("instances"), (F.sum(F.pmod("o_orderkey", F.lit(50))) + F.when(F.col("class_name").endswith("3"), skew).otherwise(0)).alias("retained"))
    return side("class_name <> 'C5'", 0), side("class_name <> 'C7'", 9)


_SIDES = "o AS (SELECT 'C' || o_custkey % 97 AS class_name, o_orderkey FROM orders), a AS (SELECT class_name, count(*) AS i, sum(o_orderkey % 50) AS r FROM o WHERE class_name <> 'C5' GROUP BY 1), b AS (SELECT class_name, count(*) AS i, sum(o_orderkey % 50) + CASE WHEN class_name LIKE '%3' THEN 9 ELSE 0 END AS r FROM o WHERE class_name <> 'C7' GROUP BY 1)"
query("parity_compare", lambda sp, d: G.compared(*_sides(sp, d), ["class_name"], ["instances", "retained"]), f"WITH {_SIDES} SELECT coalesce(a.class_name, b.class_name) AS class_name, CASE WHEN a.class_name IS NULL THEN 'missing' WHEN b.class_name IS NULL THEN 'extra' WHEN a.i = b.i AND a.r = b.r THEN 'match' ELSE 'differs' END AS outcome, CASE WHEN a.class_name IS NULL OR b.class_name IS NULL OR (a.i = b.i AND a.r = b.r) THEN '' ELSE concat_ws(',', CASE WHEN a.i <> b.i THEN 'instances' END, CASE WHEN a.r <> b.r THEN 'retained' END) END AS measures FROM a FULL JOIN b ON a.class_name = b.class_name")
query("compared_classes", lambda sp, d: G.classes_compared(*(s.withColumnRenamed("instances", "objects") for s in _sides(sp, d))), f"WITH {_SIDES} SELECT class_name, CASE WHEN a.r IS NULL THEN 'missing' WHEN a.i = b.i AND a.r = b.r THEN 'match' ELSE 'differs' END AS outcome FROM b LEFT JOIN a USING (class_name)")
_CLASS = lambda t: t.withColumn("class_name", F.when(F.col("class_name") == "C13", "java.lang.Class").otherwise(F.col("class_name")))
_SUSPECTS_SQL = """, m AS (SELECT CASE WHEN class_name = 'C13' THEN 'java.lang.Class' ELSE class_name END AS class_name, r FROM a),
n AS (SELECT CASE WHEN class_name = 'C13' THEN 'java.lang.Class' ELSE class_name END AS class_name, r, round(r / 99991.0 * 100, 2) AS pct FROM b)
SELECT class_name, CASE WHEN m.r IS NULL THEN 'missing' WHEN m.r = n.r THEN 'match' WHEN class_name = 'java.lang.Class' THEN 'explained' ELSE 'differs' END AS retained_outcome,
       CASE WHEN m.r IS NULL THEN 'missing' WHEN round(m.r / 99991.0 * 100, 2) = pct THEN 'rounded' WHEN class_name = 'java.lang.Class' THEN 'explained' ELSE 'differs' END AS pct_outcome
FROM n LEFT JOIN m USING (class_name)
"""
query("compared_suspects", lambda sp, d: G.suspects_compared(_CLASS(_sides(sp, d)[0]), _CLASS(_sides(sp, d)[1]).withColumn("pct", F.round(F.col("retained") / 99_991.0 * 100, 2)), 99_991), f"WITH {_SIDES} {_SUSPECTS_SQL}")


def _package_sides(spark: SparkSession, sf_dir: str, name: str) -> tuple[DataFrame, DataFrame]:
    """Parts by container as packages; the other side counts one object and seven bytes more under ``name``."""
    p = _FILES(spark, sf_dir, "part").select(F.concat(F.lit("java.lang."), F.regexp_replace("p_brand", "#", "")).alias("package"), "p_size")
    ours = p.groupBy("package").agg(F.count("*").alias("objects"), F.sum("p_size").cast("long").alias("retained"))
    odd = F.col("package").endswith(name).cast("long")
    return ours.where("NOT endswith(package, '5')"), ours.select("package", (F.col("objects") + odd).alias("objects"), (F.col("retained") + 7 * odd).alias("retained"))


query("compared_packages", lambda sp, d: G.packages_compared(*_package_sides(sp, d, "2")), "SELECT DISTINCT 'java.lang.' || replace(p_brand, '#', '') AS package, CASE WHEN p_brand LIKE '%5' THEN 'skipped' WHEN p_brand LIKE '%2' THEN 'explained' ELSE 'match' END AS outcome FROM part")
_BAND = "concat(format_number(p_size * 37, 0), '.', p_partkey % 10, ' ', element_at(array('B', 'KB', 'MB', 'GB', 'TB'), cast(p_partkey % 5 as int) + 1))"
query("display_band", lambda sp, d: _FILES(sp, d, "part").select("p_partkey", G.display_band(F.expr(_BAND)).alias("b")).select("p_partkey", "b.low", "b.high"), "WITH x AS (SELECT p_partkey, CAST((p_size * 37)::VARCHAR || '.' || p_partkey % 10 AS DOUBLE) AS x, 0.05::DOUBLE AS h, 1024.0::DOUBLE ** (p_partkey % 5) AS k FROM part) SELECT p_partkey, greatest((x - h) * k, 0.0::DOUBLE) AS low, (x + h) * k AS high FROM x")
query("parity_any_equal", lambda sp, d: G.any_equal(*_sides(sp, d), "class_name", ["instances", "retained"]), f"WITH {_SIDES} SELECT class_name, i AS instances, CAST(r AS BIGINT) AS retained, EXISTS (SELECT 1 FROM a WHERE a.class_name = b.class_name AND a.i = b.i AND a.r = b.r) AS found FROM b")
query("parity_matched_once", lambda sp, d: G.matched_once(*(s.withColumn("n", F.pmod("retained", F.lit(10))) for s in _sides(sp, d)), ["n"]), f"WITH {_SIDES}, x AS (SELECT CAST(r % 10 AS BIGINT) AS n, count(*) AS ours FROM a GROUP BY 1), y AS (SELECT CAST(r % 10 AS BIGINT) AS n, count(*) AS theirs FROM b GROUP BY 1) SELECT coalesce(x.n, y.n) AS n, coalesce(ours, 0) AS ours, coalesce(theirs, 0) AS theirs, least(coalesce(ours, 0), coalesce(theirs, 0)) AS matched FROM x FULL JOIN y ON x.n = y.n")
query("sweep_gate", lambda sp, d: G.sweep_gate(_FILES(sp, d, "supplier").select(F.lit(0).alias("fails"), F.pmod("s_suppkey", F.lit(4)).alias("compared"))), "SELECT CAST(0 AS BIGINT) AS fails, count(*) FILTER (s_suppkey % 4 > 0) AS comparisons, count(*) FILTER (s_suppkey % 4 > 0) >= 15 AS passed FROM supplier")
query("event_windows", lambda sp, d: ST.windowed(_FILES(sp, d, "events")), "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS events, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS total FROM events GROUP BY 1, 2")
query("compressed_references", lambda sp, d: V.compressed_references(_FILES(sp, d, "orders").select((F.col("o_orderkey") * 40).alias("addr"), F.pmod("o_orderkey", F.lit(7)).alias("elements"))), "SELECT coalesce(bool_or(addr < pa + 16 + pn * 8), false) AS compressed FROM (SELECT o_orderkey * 40 AS addr, lag(o_orderkey * 40) OVER (ORDER BY o_orderkey) AS pa, lag(o_orderkey % 7) OVER (ORDER BY o_orderkey) AS pn FROM orders)")
over_heap("dominator_children", lambda h: GR.children(h.tree), "SELECT idom, count(*) AS n_children, CAST(sum(retained) AS BIGINT) AS children_retained FROM d WHERE idom IS NOT NULL GROUP BY 1")
over_heap("transposed_degrees", lambda h: GR.transposed(h.edges).groupBy("src").agg(F.count("*").alias("inbound")), ", e AS (SELECT 2000000000000000000 + n_nationkey AS dst FROM nation UNION ALL SELECT 3000000000000000000 + c_custkey FROM customer UNION ALL SELECT 4000000000000000000 + s_suppkey FROM supplier UNION ALL SELECT 8000000000000000000 + s_suppkey FROM supplier UNION ALL SELECT 6000000000000000000 + o_orderkey FROM orders UNION ALL SELECT obj_id FROM lf UNION ALL SELECT obj_id FROM lf UNION ALL SELECT 5000000000000000000 + p_partkey FROM part WHERE (p_partkey - 1) % 10 <> 0 AND p_partkey > 0) SELECT CAST(dst AS BIGINT) AS src, count(*) AS inbound FROM e GROUP BY 1")
over_heap("dominated_by_class", lambda h: V.dominated_by_class(h.tree, h.roots.select(F.col("obj_id").alias("point"))), "SELECT idom AS point, class_name, count(*) AS objects, CAST(sum(shallow) AS BIGINT) AS shallow, CAST(sum(retained) AS BIGINT) AS retained FROM d WHERE idom BETWEEN 1000000000000000000 AND 1999999999999999999 GROUP BY 1, 2")
over_heap("dominator_subtree", lambda h: GR.subtree(h.tree, 10**18 + 1, 2).select("obj_id", "class_name", "retained", "level"), "SELECT obj_id, class_name, retained, CAST(depth - 1 AS INTEGER) AS level FROM d WHERE region = 1 AND idom IS NOT NULL AND depth <= 3")
query("triage", lambda sp, d: T.evaluate(T.facts_of(relational_heap(sp, d).tree, relational_heap(sp, d).roots)))
