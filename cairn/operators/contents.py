"""What objects hold: strings, arrays, collections, references and the fields that lead to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions import scalars as S


def _values(strings: DataFrame) -> DataFrame:
    """value, copies, bytes (of the text in UTF-8) for each distinct value; exact, not by hash."""
    return strings.where("value IS NOT NULL").groupBy("value").agg(F.count("*").alias("copies")).withColumn("bytes", F.octet_length("value").cast("long"))


def duplicate_strings(strings: DataFrame, top: int = 25) -> DataFrame:
    rows = _values(strings).where("copies > 1")
    return rows.withColumn("wasted", (F.col("copies") - 1) * F.col("bytes")).orderBy(F.desc("copies"), "value").limit(top)


def longest_strings(strings: DataFrame, top: int = 25) -> DataFrame:
    return _values(strings).orderBy(F.desc("bytes"), "value").limit(top)


def _median(rows: DataFrame, column: str) -> DataFrame:
    """The element n/2 of the rising list, by counts of distinct values: no global sort of rows."""
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    run = counts.withColumn("upto", F.sum("n").over(W.orderBy(column))).withColumn("half", F.floor(F.sum("n").over(W.partitionBy()) / 2))
    return run.where("upto > half").agg(F.min(column).alias("median"))


def string_stats(strings: DataFrame) -> DataFrame:
    rows = _values(strings)
    sums = rows.agg(F.sum("copies").alias("strings"), F.count("*").alias("distinct_values"), F.count_if(F.col("copies") > 1).alias("duplicated_values"), F.sum((F.col("copies") - 1) * F.col("bytes")).alias("wasted"), F.min("bytes").alias("least"), F.max("bytes").alias("largest"), F.sum("bytes").alias("total"))
    return sums.crossJoin(F.broadcast(_median(rows, "bytes")))


def string_lengths(strings: DataFrame) -> DataFrame:
    return _values(strings).groupBy(S.next_power_of_two("bytes").alias("length_to")).agg(F.count("*").alias("distinct_values"))


def _wasted(arrays: DataFrame) -> DataFrame:
    return arrays.withColumn("wasted", F.greatest(F.col("capacity") - F.col("used"), F.lit(0).cast("long")))


def char_array_waste(arrays: DataFrame) -> DataFrame:
    """Over backing arrays (obj_id, used, capacity): how many, how many with room to spare, and how much."""
    return _wasted(arrays).agg(F.count("*").alias("examined"), F.count_if(F.col("wasted") > 0).alias("wasteful"), F.sum("wasted").alias("wasted"))


def top_char_waste(arrays: DataFrame, top: int = 25) -> DataFrame:
    return _wasted(arrays).orderBy(F.desc("wasted"), "obj_id").limit(top)


def duplicate_arrays(arrays: DataFrame, width: int = 4) -> DataFrame:
    """By class: groups of primitive arrays of equal content, their arrays, and bytes that copies waste."""
    same = arrays.groupBy("class_name", "items").agg(F.count("*").alias("n")).where("n > 1")
    return same.groupBy("class_name").agg(F.count("*").alias("groups"), F.sum("n").alias("arrays"), F.sum((F.col("n") - 1) * F.size("items") * width).alias("wasted"))


def constant_arrays(arrays: DataFrame, width: int = 4) -> DataFrame:
    """Arrays of two elements or more that are all equal, by class, length and value, with their main owner."""
    rows = arrays.where((F.size("items") >= 2) & S.all_equal("items")).select("class_name", F.size("items").alias("length"), F.element_at("items", 1).cast("double").alias("value"), "owner")
    owners = rows.groupBy("class_name", "length", "value", "owner").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("m"), "owner"))
    return owners.groupBy("class_name", "length", "value").agg(F.sum("n").alias("objects"), best.alias("b"), F.sum(F.col("n") * F.col("length") * width).alias("bytes")).select("class_name", "length", "value", "objects", "bytes", F.col("b.owner").alias("main_owner"))


def top_arrays(arrays: DataFrame, width: int = 4, top: int = 10) -> DataFrame:
    rows = arrays.groupBy("class_name").agg(F.count("*").alias("arrays"), F.sum(F.size("items").cast("long") * width).alias("bytes"), F.max(F.size("items")).alias("longest"))
    return rows.orderBy(F.desc("bytes"), "class_name").limit(top)


def fill_ratios(collections: DataFrame, ref: int = 4) -> DataFrame:
    """All eleven ratio buckets of elements to capacity, also those that hold nothing."""
    rows = collections.where("capacity > 0").withColumn("bucket", S.ratio_bucket(S.basis_points("elements", "capacity")))
    sums = rows.groupBy("bucket").agg(F.count("*").alias("objects"), F.sum("shallow").alias("shallow"), F.sum(F.greatest(F.col("capacity") - F.col("elements"), F.lit(0)) * ref).alias("wasted"))
    every = collections.sparkSession.range(11).select(F.col("id").cast("int").alias("bucket"))
    zero = F.lit(0).cast("long")
    return every.join(sums, "bucket", "left").select("bucket", *[F.coalesce(c, zero).alias(c) for c in ("objects", "shallow", "wasted")])


def array_fill_ratios(arrays: DataFrame, ref: int = 4) -> DataFrame:
    """As ``fill_ratios`` for object arrays (refs, shallow) with one slot at least; null references are free slots."""
    rows = arrays.where(F.size("refs") > 0).select(S.used_slots("refs").cast("long").alias("elements"), F.size("refs").cast("long").alias("capacity"), "shallow")
    return fill_ratios(rows, ref)


def collections_by_size(collections: DataFrame) -> DataFrame:
    bucket = F.when(F.col("elements") == 0, F.lit(0).cast("long")).otherwise(S.next_power_of_two("elements"))
    return collections.groupBy(bucket.alias("elements_to")).agg(F.count("*").alias("objects"), F.sum("shallow").alias("shallow"))


def collections_by_kind(collections: DataFrame) -> DataFrame:
    return collections.groupBy("kind").agg(F.count("*").alias("objects"), F.sum("elements").alias("elements"), F.sum("shallow").alias("shallow"), F.max("elements").alias("largest"))


def _ranked_types(rows: DataFrame, keys: list[str], shown: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("n"), "value_class"))
    listed = F.array_sort(F.collect_list(F.when(F.col("k") <= shown, F.struct("k", F.concat_ws(":", "value_class", F.col("n").cast("string")).alias("t")))))
    return rows.withColumn("k", rank).groupBy(*keys).agg(F.array_join(F.transform(listed, lambda x: x["t"]), ",").alias("types"), F.sum("n").alias("values"))


def biggest_collections(collections: DataFrame, contents: DataFrame, top: int = 25, shown: int = 4) -> DataFrame:
    """The largest collections, each with the classes of what it holds; limited before contents are joined."""
    first = collections.orderBy(F.desc("elements"), "obj_id").limit(top)
    held = contents.join(F.broadcast(first.select("obj_id")), "obj_id").groupBy("obj_id", "value_class").agg(F.count("*").alias("n"))
    return first.join(_ranked_types(held, ["obj_id"], shown), "obj_id").select("obj_id", "kind", "elements", "types")


def collection_contents(collections: DataFrame, contents: DataFrame, shown: int = 5) -> DataFrame:
    per = contents.groupBy("obj_id", "value_class").agg(F.count("*").alias("n"))
    sums = per.join(collections.select("obj_id", "kind"), "obj_id").groupBy("kind", "value_class").agg(F.sum("n").alias("n"))
    return _ranked_types(sums, ["kind"], shown).join(collections.groupBy("kind").agg(F.count("*").alias("collections")), "kind")


def attribution_overall(held: DataFrame, top: int = 25) -> DataFrame:
    """Fields by the elements of all distinct containers that they hold."""
    rows = held.select("holder", "field", "container", "elements", "kind").distinct()
    kind = F.when(F.countDistinct("kind") > 1, "mixed").otherwise(F.min("kind"))
    return rows.groupBy("holder", "field").agg(F.count("*").alias("containers"), F.sum("elements").alias("elements"), kind.alias("kind")).orderBy(F.desc("elements"), "holder", "field").limit(top)


def attribution_single(held: DataFrame, top: int = 25) -> DataFrame:
    """Fields by the largest container that they hold."""
    best = F.max(F.struct("elements", "retained", (-F.col("container")).alias("m")))
    rows = held.groupBy("holder", "field").agg(best.alias("b"))
    return rows.select("holder", "field", (-F.col("b.m")).alias("container"), "b.elements", "b.retained").orderBy(F.desc("elements"), "holder", "field").limit(top)


def fields_by_size(held: DataFrame, top: int = 25) -> DataFrame:
    """Fields by what their distinct pointees retain, with the type that has more than half of it, or `varies`."""
    rows = held.select("holder", "field", "container", "retained", "type").distinct()
    types = rows.groupBy("holder", "field", "type").agg(F.sum("retained").alias("r"), F.count("*").alias("n"))
    most = F.max(F.struct("r", "type"))
    sums = types.groupBy("holder", "field").agg(F.sum("n").alias("pointees"), F.sum("r").alias("retained"), most.alias("m"), F.count("*").alias("types"))
    main = F.when((F.col("types") == 1) | (F.col("m.r") * 2 > F.col("retained")), F.col("m.type")).otherwise("varies")
    return sums.select("holder", "field", "pointees", "retained", main.alias("main_type")).orderBy(F.desc("retained"), F.desc("pointees"), "holder", "field").limit(top)


def reference_histogram(references: DataFrame, cap: int = 200) -> DataFrame:
    """Referents by kind of reference and class; classes after the first ``cap`` of a kind are one row."""
    rows = references.groupBy("kind", "class_name").agg(F.count("*").alias("objects"), F.sum("shallow").alias("shallow"))
    rank = F.row_number().over(W.partitionBy("kind").orderBy(F.desc("objects"), "class_name"))
    return rows.withColumn("class_name", F.when(rank <= cap, F.col("class_name")).otherwise("<other>")).groupBy("kind", "class_name").agg(F.sum("objects").alias("objects"), F.sum("shallow").alias("shallow"))


def only_weakly_retained(references: DataFrame) -> DataFrame:
    return references.where("NOT reachable").groupBy("kind", "class_name").agg(F.count("*").alias("objects"), F.sum("shallow").alias("shallow"))


def holder_ranking(fields: DataFrame, targets: DataFrame, top: int = 25) -> DataFrame:
    """Classes by how many of their references (holder, ref) lead to target objects (obj_id)."""
    hit = fields.join(targets.select(F.col("obj_id").alias("ref")).distinct(), "ref", "left_semi")
    return hit.groupBy("holder").agg(F.count("*").alias("refs")).orderBy(F.desc("refs"), "holder").limit(top)
