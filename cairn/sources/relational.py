"""A heap made of relational tables, on which every operator can be compared with SQL.

Rows own rows along foreign keys: region, nation, customer, order and line-item arrays; nation, supplier and line-item
arrays; supplier and a boxed balance. Regions are roots. Parts are garbage: chains of ten that nothing refers to.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.functions import scalars as S
from cairn.operators.graph import dominator_tree, union_edges, unreachable_forest
from cairn.plans.tables import written

#: Number of a class in object ids; its fields as (references, bytes of primitives).
CLASSES = {
    "region": (1, "com/shop/geo/Region", 1, 4),
    "nation": (2, "com/shop/geo/Nation", 2, 4),
    "customer": (3, "com/shop/party/Customer", 3, 16),
    "supplier": (4, "com/shop/party/Supplier", 3, 8),
    "part": (5, "com/shop/stock/Part", 3, 20),
    "orders": (6, "com/shop/sales/Order", 3, 24),
    "lineitem": (7, "[Lcom/shop/sales/LineItem;", 0, 0),
    "balance": (8, "java/lang/Double", 0, 8),
}
UNIT = 10**18


@dataclass
class Heap:
    """nodes: obj_id, class_row, canon_row, raw_name, class_name, loader, kind, shallow, repr_row, alloc_serial,
    elements; edges: src, dst; roots: obj_id, root_tag, is_synthetic. tree: nodes with the dominator tree."""

    nodes: DataFrame
    edges: DataFrame
    roots: DataFrame
    tree: DataFrame
    forest: DataFrame


def _id(table: str, key) -> Column:
    return (F.lit(CLASSES[table][0] * UNIT) + (F.col(key) if isinstance(key, str) else key)).cast("long")


def _objects(df: DataFrame, table: str, key, loader: Column, serial: Column | None = None) -> DataFrame:
    number, raw, refs, prims = CLASSES[table]
    return df.select(
        _id(table, key).alias("obj_id"), F.lit(number).alias("class_no"), F.lit(raw).alias("raw_name"), loader.cast("string").alias("loader"),
        F.lit(S.INSTANCE).alias("kind"), S.instance_size(F.lit(prims), F.lit(refs)).alias("shallow"), F.coalesce(serial, F.lit(0)).cast("long").alias("alloc_serial") if serial is not None else F.lit(0).cast("long").alias("alloc_serial"), F.lit(None).cast("long").alias("elements"),
    )


def relational_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """nodes, edges, roots of the tables in a folder."""
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")}
    nations = t["nation"].join(t["region"], F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_regionkey", "r_name")
    customers = t["customer"].join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_nationkey", "r_name")
    orders = t["orders"].join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", "r_name")
    leaves = t["lineitem"].groupBy("l_orderkey", "l_suppkey").agg(F.count("*").alias("n"))
    leaves = written(leaves.sortWithinPartitions("l_orderkey", "l_suppkey"), "line-items")  # in order, ids take less space from here on
    owned = leaves.join(orders.select("o_orderkey", "r_name"), F.col("l_orderkey") == F.col("o_orderkey"))
    leaf = F.col("l_orderkey") * 10**7 + F.col("l_suppkey")
    boot = F.lit("<boot>")
    suppliers = t["supplier"].join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    arrays = owned.select(_id("lineitem", leaf).alias("obj_id"), F.lit(7).alias("class_no"), F.lit(CLASSES["lineitem"][1]).alias("raw_name"), F.col("r_name").alias("loader"), F.lit(S.OBJECT_ARRAY).alias("kind"), S.object_array_size("n").alias("shallow"), F.lit(0).cast("long").alias("alloc_serial"), F.col("n").alias("elements"))
    nodes = _objects(t["region"], "region", "r_regionkey", F.col("r_name"))
    for more in (
        _objects(nations, "nation", "n_nationkey", F.col("r_name")),
        _objects(customers, "customer", "c_custkey", F.col("r_name")),
        _objects(suppliers, "supplier", "s_suppkey", F.col("r_name")),
        _objects(t["part"], "part", "p_partkey", boot),
        _objects(orders, "orders", "o_orderkey", F.col("r_name"), F.pmod("o_custkey", F.lit(50)) + 1),
        _objects(t["supplier"], "balance", "s_suppkey", boot),
        arrays,
    ):
        nodes = nodes.unionByName(more)
    # the class number and the loader make a class row; names here are never folded, so both rows are equal
    row = F.col("class_no").cast("long") * 1000 + F.when(F.col("loader") == "<boot>", 999).otherwise(F.pmod(F.crc32(F.encode("loader", "UTF-8")), F.lit(997)))
    nodes = nodes.withColumn("class_row", row.cast("long")).withColumn("canon_row", F.col("class_row")).withColumn("class_name", S.pretty_class_name("raw_name")).withColumn("repr_row", F.lit(None).cast("long")).drop("class_no")
    edges = union_edges(
        t["nation"].select(_id("region", "n_regionkey").alias("src"), _id("nation", "n_nationkey").alias("dst")),
        t["customer"].select(_id("nation", "c_nationkey").alias("src"), _id("customer", "c_custkey").alias("dst")),
        t["supplier"].select(_id("nation", "s_nationkey").alias("src"), _id("supplier", "s_suppkey").alias("dst")),
        t["supplier"].select(_id("supplier", "s_suppkey").alias("src"), _id("balance", "s_suppkey").alias("dst")),
        t["orders"].select(_id("customer", "o_custkey").alias("src"), _id("orders", "o_orderkey").alias("dst")),
        t["part"].where("p_partkey % 10 != 0").join(t["part"].select((F.col("p_partkey") - 1).alias("p_partkey")), "p_partkey").select(_id("part", "p_partkey").alias("src"), _id("part", F.col("p_partkey") + 1).alias("dst")),
    )
    for owner, key in (("orders", "l_orderkey"), ("supplier", "l_suppkey")):  # distinct as they are
        edges = edges.unionByName(leaves.select(_id(owner, key).alias("src"), _id("lineitem", leaf).alias("dst")).where("src IS NOT NULL AND dst IS NOT NULL"))
    tags = F.when(F.pmod("r_regionkey", F.lit(3)) == 0, 5).when(F.pmod("r_regionkey", F.lit(3)) == 1, 1).otherwise(8)
    roots = t["region"].select(_id("region", "r_regionkey").alias("obj_id"), tags.alias("root_tag"), F.lit(False).alias("is_synthetic"))
    return nodes, edges, roots


_HEAPS: dict[tuple[str, str], Heap] = {}


def relational_heap(spark: SparkSession, sf_dir: str) -> Heap:
    """The heap of a folder with its dominator tree; worked out once in a session."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _HEAPS:
        nodes, edges, roots = relational_graph(spark, sf_dir)
        nodes, edges, roots = written(nodes, "nodes"), written(edges, "edges"), written(roots, "roots")
        tree = dominator_tree(nodes, edges, roots)
        _HEAPS[key] = Heap(nodes, edges, roots, tree, written(unreachable_forest(tree, edges), "forest"))
    return _HEAPS[key]


#: The same heap in SQL: d has a row for each object, with closed forms for dominators and retained sizes.
HEAP_SQL = """
WITH nat AS (SELECT n_nationkey, n_regionkey, r_name FROM nation JOIN region ON n_regionkey = r_regionkey),
cus AS (SELECT c_custkey, n_nationkey, n_regionkey, r_name FROM customer JOIN nat ON c_nationkey = n_nationkey),
sup AS (SELECT s_suppkey, n_nationkey, n_regionkey, r_name FROM supplier JOIN nat ON s_nationkey = n_nationkey),
ord AS (SELECT o_orderkey, o_custkey, n_nationkey, n_regionkey, r_name FROM orders JOIN cus ON o_custkey = c_custkey),
leaf AS (SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2),
lf AS (SELECT 7000000000000000000 + l_orderkey * 10000000 + l_suppkey AS obj_id, l.n, o.r_name,
         CAST((16 + 4 * l.n + 7) // 8 * 8 AS BIGINT) AS shallow,
         CASE WHEN o.n_nationkey = s.n_nationkey THEN 2000000000000000000 + o.n_nationkey
              WHEN o.n_regionkey = s.n_regionkey THEN 1000000000000000000 + o.n_regionkey ELSE -1 END AS idom,
         CASE WHEN o.n_nationkey = s.n_nationkey THEN 3 WHEN o.n_regionkey = s.n_regionkey THEN 2 ELSE 1 END AS depth,
         CASE WHEN o.n_regionkey = s.n_regionkey THEN o.n_regionkey END AS region
       FROM leaf l JOIN ord o ON l_orderkey = o_orderkey JOIN sup s ON l_suppkey = s_suppkey),
rc AS (SELECT c_custkey, 40 + 48 * count(o_orderkey) AS retained FROM cus LEFT JOIN ord ON o_custkey = c_custkey GROUP BY 1),
rn AS (SELECT n_nationkey, 24 + coalesce((SELECT sum(retained) FROM rc JOIN cus USING (c_custkey) WHERE cus.n_nationkey = nat.n_nationkey), 0)
         + 56 * (SELECT count(*) FROM sup WHERE sup.n_nationkey = nat.n_nationkey)
         + coalesce((SELECT sum(shallow) FROM lf WHERE idom = 2000000000000000000 + nat.n_nationkey), 0) AS retained FROM nat),
rr AS (SELECT r_regionkey, 24 + coalesce((SELECT sum(retained) FROM rn JOIN nat USING (n_nationkey) WHERE nat.n_regionkey = r_regionkey), 0)
         + coalesce((SELECT sum(shallow) FROM lf WHERE idom = 1000000000000000000 + r_regionkey), 0) AS retained FROM region),
d0 AS (
  SELECT 1000000000000000000 + r_regionkey AS obj_id, 'com.shop.geo.Region' AS class_name, r_name AS loader, 0 AS kind, 24 AS shallow, -1 AS idom, 1 AS depth, retained, 0 AS alloc_serial, NULL AS elements, r_regionkey AS region FROM region JOIN rr USING (r_regionkey)
  UNION ALL SELECT 2000000000000000000 + n_nationkey, 'com.shop.geo.Nation', r_name, 0, 24, 1000000000000000000 + n_regionkey, 2, retained, 0, NULL, n_regionkey FROM nat JOIN rn USING (n_nationkey)
  UNION ALL SELECT 3000000000000000000 + c_custkey, 'com.shop.party.Customer', r_name, 0, 40, 2000000000000000000 + n_nationkey, 3, retained, 0, NULL, n_regionkey FROM cus JOIN rc USING (c_custkey)
  UNION ALL SELECT 4000000000000000000 + s_suppkey, 'com.shop.party.Supplier', r_name, 0, 32, 2000000000000000000 + n_nationkey, 3, 56, 0, NULL, n_regionkey FROM sup
  UNION ALL SELECT 8000000000000000000 + s_suppkey, 'java.lang.Double', '<boot>', 0, 24, 4000000000000000000 + s_suppkey, 4, 24, 0, NULL, n_regionkey FROM sup
  UNION ALL SELECT 6000000000000000000 + o_orderkey, 'com.shop.sales.Order', r_name, 0, 48, 3000000000000000000 + o_custkey, 4, 48, o_custkey % 50 + 1, NULL, n_regionkey FROM ord
  UNION ALL SELECT obj_id, 'com.shop.sales.LineItem[]', r_name, 1, shallow, idom, depth, shallow, 0, n, region FROM lf
  UNION ALL SELECT 5000000000000000000 + p_partkey, 'com.shop.stock.Part', '<boot>', 0, 48, NULL, NULL, NULL, 0, NULL, NULL FROM part),
d AS (SELECT CAST(obj_id AS BIGINT) AS obj_id, class_name, loader, kind, CAST(shallow AS BIGINT) AS shallow, CAST(idom AS BIGINT) AS idom, depth,
        CAST(retained AS BIGINT) AS retained, alloc_serial, CAST(elements AS BIGINT) AS elements, region FROM d0)
"""
