"""The analyses of a heap, each a small table. ``tree`` is a heap's nodes with their dominator tree.

Lists are bounded by the number of classes, a top k with all tie-breakers spelled out, or the depth of the tree, so
each is safe to collect.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions import scalars as S
from cairn.plans.tables import written
from cairn.operators.graph import _few, accumulation_points, merged_paths, ways_to

def reached(tree: DataFrame) -> DataFrame:
    return tree.where("idom IS NOT NULL")


def tops(tree: DataFrame) -> DataFrame:
    """The objects that the virtual root dominates immediately."""
    return tree.where("idom = -1")


def _total(tree: DataFrame, name: str = "total") -> DataFrame:
    return F.broadcast(reached(tree).agg(F.sum("shallow").alias(name)))


def heap_totals(tree: DataFrame) -> DataFrame:
    live = F.col("idom").isNotNull()
    sums = tree.agg(F.count_if(live).alias("reachable"), F.coalesce(F.sum(F.when(live, F.col("shallow"))), F.lit(0)).alias("reachable_shallow"), F.count_if(~live).alias("unreachable"), F.coalesce(F.sum(F.when(~live, F.col("shallow"))), F.lit(0)).alias("unreachable_shallow"))
    return sums.withColumn("fragmentation_bp", S.basis_points("unreachable_shallow", F.col("reachable_shallow") + F.col("unreachable_shallow")))


def with_system_loader(totals: DataFrame, size: int = 96) -> DataFrame:
    """Totals with the one class loader that the virtual machine itself stands for: it has no node."""
    return totals.withColumn("reachable", F.col("reachable") + 1).withColumn("reachable_shallow", F.col("reachable_shallow") + size)


def class_histogram(tree: DataFrame) -> DataFrame:
    """class_name, loader, instances, shallow, max_shallow, retained of reachable objects by canonical row.

    Retained sizes of objects below one of the same class count once; class objects also add theirs to the
    class they stand for."""
    live = reached(tree)
    own = F.when(~F.col("same_class"), F.col("retained")).otherwise(0)
    rows = live.groupBy("canon_row", "class_name", "loader").agg(F.count("*").alias("instances"), F.sum("shallow").alias("shallow"), F.max("shallow").alias("max_shallow"), F.sum(own).alias("retained"))
    extra = live.where("repr_row IS NOT NULL").groupBy(F.col("repr_row").alias("canon_row")).agg(F.sum("retained").alias("more"))
    return rows.join(extra, "canon_row", "left").withColumn("retained", F.col("retained") + F.coalesce("more", F.lit(0))).drop("more", "canon_row")


def composition(tree: DataFrame) -> DataFrame:
    live = F.col("idom").isNotNull()
    return tree.groupBy(S.kind_label("kind").alias("object_kind"), live.alias("reachable")).agg(F.count("*").alias("objects"), F.sum("shallow").alias("shallow"))


def unreachable_arrays(tree: DataFrame) -> DataFrame:
    """Unreachable primitive arrays by class, if there are two classes at least."""
    rows = tree.where((F.col("idom").isNull()) & (F.col("kind") == S.PRIMITIVE_ARRAY)).groupBy("class_name").agg(F.count("*").alias("objects"), F.sum("shallow").alias("shallow"))
    return rows.crossJoin(F.broadcast(rows.agg(F.count("*").alias("kinds")))).where("kinds >= 2").drop("kinds")


def roots_by_type(roots: DataFrame) -> DataFrame:
    least = roots.groupBy("obj_id").agg(F.min("root_tag").alias("root_tag"), F.min("is_synthetic").alias("is_synthetic"))
    return least.where("NOT is_synthetic").groupBy(S.root_label("root_tag").alias("root_type")).agg(F.count("*").alias("roots"))


def roots_retained(tree: DataFrame, roots: DataFrame) -> DataFrame:
    least = roots.groupBy("obj_id").agg(F.min("root_tag").alias("root_tag"))
    return least.join(tree, "obj_id").where("root_tag != 255").groupBy(S.root_label("root_tag").alias("root_type")).agg(F.count("*").alias("roots"), F.sum("retained").alias("retained"))


def depth_histogram(tree: DataFrame) -> DataFrame:
    return reached(tree).groupBy("depth").agg(F.count("*").alias("objects"))


def depth_summary(tree: DataFrame) -> DataFrame:
    """Cumulative counts by depth with the median, 90 % and largest depth on each row."""
    rows = depth_histogram(tree)
    run = rows.withColumn("cumulative", F.sum("objects").over(W.orderBy("depth").rowsBetween(W.unboundedPreceding, 0))).withColumn("total", F.sum("objects").over(W.partitionBy()))
    marks = run.agg(F.min(F.when(F.col("cumulative") * 2 >= F.col("total"), F.col("depth"))).alias("median_depth"), F.min(F.when(F.col("cumulative") * 10 >= F.col("total") * 9, F.col("depth"))).alias("p90_depth"), F.max("depth").alias("max_depth"))
    return run.crossJoin(F.broadcast(marks)).withColumn("cumulative_bp", S.basis_points("cumulative", "total")).drop("total")


def retention_concentration(tree: DataFrame) -> DataFrame:
    """Shares of the reachable heap that the largest 1, 10 and 100 top-level objects retain; how many hold 1 %."""
    first = tops(tree).orderBy(F.desc("retained"), "obj_id").limit(100).withColumn("k", F.row_number().over(W.orderBy(F.desc("retained"), "obj_id")))
    held = first.agg(*[F.coalesce(F.sum(F.when(F.col("k") <= n, F.col("retained"))), F.lit(0)).alias(f"top{n}") for n in (1, 10, 100)])
    big = tops(tree).crossJoin(_total(tree)).agg(F.count_if(F.col("retained").cast("decimal(38,0)") * 100 >= F.col("total")).alias("one_percent_objects"))
    return held.crossJoin(big).crossJoin(_total(tree)).select(*[S.basis_points(f"top{n}", "total").alias(f"top{n}_bp") for n in (1, 10, 100)], "one_percent_objects")


def loader_rollup(tree: DataFrame, top: int = 20) -> DataFrame:
    rows = class_histogram(tree).groupBy("loader").agg(F.count("*").alias("classes"), F.sum("instances").alias("instances"), F.sum("shallow").alias("shallow"), F.sum("retained").alias("retained"))
    return rows.orderBy(F.desc("retained"), "loader").limit(top)


def duplicate_classes(tree: DataFrame, top: int = 20, shown: int = 8) -> DataFrame:
    """Classes of one name in several loaders, with the first loaders of each."""
    rows = class_histogram(tree).groupBy("class_name", "loader").agg(F.sum("instances").alias("instances"), F.sum("retained").alias("retained"))
    rank = F.row_number().over(W.partitionBy("class_name").orderBy(F.desc("retained"), F.desc("instances"), "loader"))
    each = rows.withColumn("k", rank).groupBy("class_name").agg(F.count("*").alias("loaders"), F.sum("instances").alias("instances"), F.sum("retained").alias("retained"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= shown, F.struct("k", "loader")))), lambda x: x["loader"]), ",").alias("shown"))
    return each.where("loaders > 1").orderBy(F.desc("retained"), "class_name").limit(top)


def top_components(tree: DataFrame, top: int = 10, classes: int = 5) -> DataFrame:
    """Loaders by what their top-level objects retain, each with its first classes."""
    rows = tops(tree).groupBy("loader", "class_name").agg(F.count("*").alias("objects"), F.sum("retained").alias("retained"))
    total = rows.groupBy("loader").agg(F.sum("retained").alias("component_retained")).orderBy(F.desc("component_retained"), "loader").limit(top)
    rank = F.row_number().over(W.partitionBy("loader").orderBy(F.desc("retained"), "class_name"))
    return rows.join(total, "loader").withColumn("class_rank", rank).where(F.col("class_rank") <= classes).crossJoin(_total(tree)).withColumn("component_bp", S.basis_points("component_retained", "total")).drop("total")


# Classes that wrap a number, as the analyses list them.
BOXED = ("java.lang.Boolean", "java.lang.Byte", "java.lang.Character", "java.lang.Short", "java.lang.Integer", "java.lang.Long", "java.lang.Float", "java.lang.Double", "java.lang.BigInteger", "java.lang.BigDecimal")


def boxed_numbers(tree: DataFrame) -> DataFrame:
    rows = class_histogram(tree).where(F.col("class_name").isin(*BOXED))
    return rows.crossJoin(_total(tree)).select("class_name", "instances", "shallow", S.basis_points("shallow", "total").alias("heap_bp"), F.floor(F.col("shallow") / F.col("instances")).cast("long").alias("mean_size"))


def header_overhead(tree: DataFrame, header: int = 12, top: int = 30) -> DataFrame:
    """Classes whose headers take 30 % of their shallow size, or a mebibyte."""
    rows = class_histogram(tree).withColumn("header_bytes", F.col("instances") * header)
    worth = (F.col("header_bytes") * 10 >= F.col("shallow") * 3) | (F.col("header_bytes") >= 1 << 20)
    return rows.where(worth & (F.col("shallow") > 0)).select("class_name", "loader", "instances", "shallow", "header_bytes", S.basis_points("header_bytes", "shallow").alias("header_bp"), F.floor(F.col("shallow") / F.col("instances")).cast("long").alias("mean_size")).orderBy(F.desc("header_bytes"), "class_name", "loader").limit(top)


def top_class_share(tree: DataFrame) -> DataFrame:
    first = class_histogram(tree).orderBy(F.desc("retained"), "class_name", "loader").limit(1)
    return first.crossJoin(F.broadcast(tops(tree).agg(F.sum("retained").alias("total")))).select("class_name", "loader", "retained", S.basis_points("retained", "total").alias("share_bp"))


def unreachable_histogram(forest: DataFrame, tree: DataFrame, top: int = 30) -> DataFrame:
    """Garbage by class; a class object counts for the class that it stands for."""
    names = tree.select("canon_row", "class_name", "loader").distinct()
    rows = forest.withColumn("canon_row", F.coalesce("repr_row", "class_row"))
    rows = rows.groupBy("canon_row").agg(F.count("*").alias("objects"), F.sum("shallow").alias("shallow"), F.sum(F.when(~F.col("same_class"), F.col("retained")).otherwise(0)).alias("retained"))
    return rows.join(names, "canon_row").drop("canon_row").orderBy(F.desc("shallow"), F.desc("objects"), "class_name").limit(top)


def garbage_roots(forest: DataFrame, tree: DataFrame, top: int = 10) -> DataFrame:
    """The heads of the largest garbage trees, with how many objects each holds."""
    heads = forest.where("idom = -1").select("obj_id", "retained", F.col("below").alias("objects")).join(tree.select("obj_id", "class_name"), "obj_id")
    return heads.orderBy(F.desc("retained"), "obj_id").limit(top)


def arrays_by_size(tree: DataFrame) -> DataFrame:
    """Arrays by kind and power-of-two bucket of their lengths; bucket 0 holds the empty ones."""
    arrays = tree.where(F.col("kind").isin(S.OBJECT_ARRAY, S.PRIMITIVE_ARRAY))
    bucket = F.when(F.col("elements") == 0, F.lit(0).cast("long")).otherwise(S.next_power_of_two("elements"))
    return arrays.groupBy(S.kind_label("kind").alias("object_kind"), bucket.alias("length_to")).agg(F.count("*").alias("objects"), F.sum("shallow").alias("shallow"))


def top_sizes(tree: DataFrame) -> DataFrame:
    """Top-level objects by power-of-two bucket of what they retain."""
    return tops(tree).groupBy(S.next_power_of_two("retained").alias("retained_to")).agg(F.count("*").alias("objects"), F.sum("retained").alias("retained"))


def top_size_stats(tree: DataFrame) -> DataFrame:
    """Least, largest, median (element n/2 of the falling list) and total of what top-level objects retain.

    Equal sizes are counted before they are put in order, in ranges of powers of two."""
    counts = tops(tree).groupBy("retained").agg(F.count("*").alias("c")).withColumn("size_range", S.next_power_of_two("retained"))
    ranges = counts.groupBy("size_range").agg(F.sum("c").alias("rc"), F.sum(F.col("c") * F.col("retained")).alias("bytes"), F.min("retained").alias("lo"), F.max("retained").alias("hi"))
    over = F.broadcast(ranges.select("size_range", F.coalesce(F.sum("rc").over(W.orderBy(F.desc("size_range")).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("ahead")))  # 64 rows at most
    total = F.broadcast(ranges.agg(F.sum("rc").alias("n"), F.min("lo").alias("least"), F.max("hi").alias("largest"), F.sum("bytes").alias("total")))
    within = F.sum("c").over(W.partitionBy("size_range").orderBy(F.desc("retained")))
    rows = counts.withColumn("upto", within).join(over, "size_range").withColumn("upto", F.col("upto") + F.col("ahead")).crossJoin(total)
    middle = F.floor(F.col("n") / 2) + 1
    return rows.where((F.col("upto") >= middle) & (F.col("upto") - F.col("c") < middle)).select("n", "least", "largest", F.col("retained").alias("median"), "total")


def biggest_objects(tree: DataFrame, top: int = 20) -> DataFrame:
    return tops(tree).crossJoin(_total(tree)).select("obj_id", "class_name", "shallow", "retained", S.basis_points("retained", "total").alias("heap_bp")).orderBy(F.desc("retained"), "obj_id").limit(top)


def biggest_classes(tree: DataFrame, top: int = 20) -> DataFrame:
    rows = tops(tree).groupBy("class_name", "loader").agg(F.count("*").alias("objects"), F.sum("retained").alias("retained"))
    return rows.crossJoin(_total(tree)).withColumn("heap_bp", S.basis_points("retained", "total")).drop("total").orderBy(F.desc("retained"), "class_name", "loader").limit(top)


def package_tree(tree: DataFrame) -> DataFrame:
    """Each dotted prefix of top-level objects' packages, where it retains 1 % of the heap at least."""
    rows = tops(tree).select("shallow", "retained", F.explode(S.package_prefixes(S.package_path("class_name"))).alias("package"))
    sums = rows.groupBy("package").agg(F.count("*").alias("objects"), F.sum("shallow").alias("shallow"), F.sum("retained").alias("retained"))
    return sums.crossJoin(_total(tree)).where(F.col("retained").cast("decimal(38,0)") * 10000 >= F.col("total").cast("decimal(38,0)") * 100).drop("total")


def leak_suspects(tree: DataFrame, share: int = 10) -> DataFrame:
    """Top-level objects that retain ``share`` percent of the heap, and classes that do so only together."""
    total = _total(tree)
    big = F.col("retained").cast("decimal(38,0)") * 100 >= F.col("total").cast("decimal(38,0)") * share
    single = tops(tree).crossJoin(total).where(big)
    known = single.select("class_row").distinct()
    groups = tops(tree).groupBy("class_row", "class_name", "loader").agg(F.count("*").alias("objects"), F.sum("shallow").alias("shallow"), F.sum("retained").alias("retained")).crossJoin(total).where(big).join(known, "class_row", "left_anti")
    one = single.select(F.lit("single").alias("suspect"), "obj_id", "class_name", "loader", F.lit(1).cast("long").alias("objects"), "shallow", "retained", S.basis_points("retained", "total").alias("heap_bp"))
    many = groups.select(F.lit("group").alias("suspect"), F.lit(None).cast("long").alias("obj_id"), "class_name", "loader", "objects", "shallow", "retained", S.basis_points("retained", "total").alias("heap_bp"))
    return one.unionByName(many)


def suspects_descent(tree: DataFrame, share: int = 10) -> DataFrame:
    """Where each single suspect's memory piles up, and the way there by class names."""
    single = leak_suspects(tree, share).where("suspect = 'single'")
    found = F.broadcast(accumulation_points(tree, single))  # 100 / share rows at most; else the tree may be taken for the small side
    at = tree.select(F.col("obj_id").alias("point"), F.col("class_name").alias("point_class"), F.col("retained").alias("point_retained"))
    return found.join(at, "point")


def heaviest_nodes(tree: DataFrame, nodes: int = 5000, depth: int = 20) -> DataFrame:
    """The top of the dominator tree: the ``nodes`` heaviest objects down to ``depth``.

    A dominator retains no less than what it dominates and is less deep, so in this order it comes first and the rows
    always are a whole top of the tree."""
    live = tree.where(F.col("idom").isNotNull() & (F.col("depth") <= depth))
    return live.select("obj_id", "idom", "depth", "class_name", "shallow", "retained", F.col("below").alias("objects")).orderBy(F.desc("retained"), "depth", "obj_id").limit(nodes)


def point_children(tree: DataFrame, points: DataFrame, shown: int = 50) -> DataFrame:
    """point, child_rank, obj_id, class_name, shallow, retained: the ``shown`` heaviest objects that each accumulation point
    (column point) dominates immediately. Ranks are limited before they are exchanged."""
    at = F.broadcast(points.select("point").distinct())  # of suspects, each a tenth of the heap: ten at most
    rows = tree.join(at, F.col("idom") == F.col("point")).select("point", "obj_id", "class_name", "shallow", "retained")
    rank = F.row_number().over(W.partitionBy("point").orderBy(F.desc("retained"), "obj_id"))
    return rows.withColumn("child_rank", rank).where(F.col("child_rank") <= shown)


def dominated_by_class(tree: DataFrame, points: DataFrame) -> DataFrame:
    """Children of points (column point) in the dominator tree, by class."""
    rows = tree.join(points.select(F.col("point").alias("idom")).distinct(), "idom")
    return rows.groupBy(F.col("idom").alias("point"), "class_name").agg(F.count("*").alias("objects"), F.sum("shallow").alias("shallow"), F.sum("retained").alias("retained"))


def big_drops(tree: DataFrame, top: int = 25) -> DataFrame:
    """Objects that retain much more than their largest child does: 1 % of the heap and more."""
    # a drop is no more than what is retained, so only objects that retain as much are asked about their children
    heavy = reached(tree).crossJoin(_total(tree)).where(F.col("retained").cast("decimal(38,0)") * 100 >= F.col("total")).drop("total")
    heavy = written(heavy.select("obj_id", "class_name", "retained"), "heavy-objects")
    held = tree.where("idom >= 0").select("idom", "retained").join(_few(heavy).select(F.col("obj_id").alias("idom")), "idom", "left_semi")
    largest = held.groupBy("idom").agg(F.max("retained").alias("child_retained"))
    rows = heavy.join(largest.withColumnRenamed("idom", "obj_id"), "obj_id", "left").withColumn("child_retained", F.coalesce("child_retained", F.lit(0))).withColumn("drop", F.col("retained") - F.col("child_retained"))
    worth = (F.col("drop") > 0) & (F.col("drop").cast("decimal(38,0)") * 100 >= F.col("total"))
    return rows.crossJoin(_total(tree)).where(worth).select("obj_id", "class_name", "retained", "child_retained", "drop").orderBy(F.desc("drop"), "obj_id").limit(top)


def immediate_dominators(tree: DataFrame, top: int = 30) -> DataFrame:
    """By class of the dominator: how many, what they dominate immediately, and both shallow sizes."""
    below = tree.where("idom >= 0").groupBy("idom").agg(F.count("*").alias("n"), F.sum("shallow").alias("s"))
    rows = below.join(tree.where("below > 1").select(F.col("obj_id").alias("idom"), "class_name", "shallow"), "idom")
    return rows.groupBy("class_name").agg(F.count("*").alias("dominators"), F.sum("shallow").alias("dominators_shallow"), F.sum("n").alias("dominated"), F.sum("s").alias("dominated_shallow")).orderBy(F.desc("dominated_shallow"), F.desc("dominated"), "class_name").limit(top)


def merged_root_paths(tree: DataFrame, top: int = 60) -> DataFrame:
    return merged_paths(tree).orderBy(F.desc("retained"), "path").limit(top)


def root_path(tree: DataFrame, depth: int = 30) -> DataFrame:
    """The way from the virtual root to the largest object of each class, by class names."""
    best = reached(tree).groupBy("class_name").agg(F.max(F.struct("retained", (-F.col("obj_id")).alias("m"))).alias("b")).select(F.col("class_name").alias("of_class"), (-F.col("b.m")).alias("obj_id"))
    best = written(best, "largest-objects")
    steps = best.join(ways_to(tree, best, depth), "obj_id").select("of_class", F.col("depth").alias("k"), "over")
    named = _few(written(steps, "steps")).join(tree.select(F.col("obj_id").alias("over"), "class_name"), "over")
    return named.groupBy("of_class").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "class_name"))), lambda s: s["class_name"]), " > ").alias("path"))


def allocation_sites(tree: DataFrame, top: int = 50) -> DataFrame:
    """Objects by the stack they were allocated on; unreachable ones too, and nested retained sizes add up."""
    return tree.where("alloc_serial != 0").groupBy("alloc_serial").agg(F.count("*").alias("objects"), F.sum("shallow").alias("shallow"), F.sum(F.coalesce("retained", F.lit(0))).alias("retained")).orderBy(F.desc("objects"), F.desc("retained"), "alloc_serial").limit(top)


def anonymous_classes(tree: DataFrame) -> DataFrame:
    rows = class_histogram(tree)
    return rows.agg(F.count_if(S.is_anonymous("class_name")).alias("anonymous"), F.count("*").alias("classes"))


def _address_ranges(arrays: DataFrame) -> DataFrame:
    """a (addr in unsigned order), elements, bucket: its range of 4 MiB."""
    return arrays.select(F.col("addr").bitwiseXOR(F.lit(-(2**63))).alias("a"), "elements").withColumn("bucket", F.shiftright("a", 22))


def compressed_references(arrays: DataFrame, id_size: int = 8, header: int = 16) -> DataFrame:
    """Whether references are four bytes: some object array starts inside the one before, were they eight.

    arrays: addr, elements. Rows are dealt by ranges of addresses of 4 MiB, which hold 262,144 arrays of 16 bytes at
    most; each range also sees the last array of the one before. A heap of 100 GiB has 25,600 ranges."""
    rows = _address_ranges(arrays)
    before = W.partitionBy("bucket").orderBy("a")
    inner = rows.withColumn("prev", F.lag(F.struct("a", "elements")).over(before))
    ends = rows.groupBy("bucket").agg(F.max(F.struct("a", "elements")).alias("last"), F.min("a").alias("first"))
    edges = ends.select("first", F.lag("last").over(W.orderBy("bucket")).alias("prev")).select(F.col("first").alias("a"), "prev")
    pairs = inner.select("a", "prev").unionByName(edges)
    over = F.col("a") < F.col("prev.a") + header + F.col("prev.elements") * id_size
    return pairs.agg(F.coalesce(F.bool_or(over), F.lit(False)).alias("compressed"))
