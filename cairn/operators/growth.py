"""Differences between reports: several of one program over time, or ours and another tool's."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def series(reports: DataFrame) -> DataFrame:
    """class_name, report, retained and step (difference to the class's report before)."""
    before = F.lag("retained").over(W.partitionBy("class_name").orderBy("report"))
    return reports.select("class_name", "report", "retained", (F.col("retained") - before).alias("step"))


def growth(reports: DataFrame) -> DataFrame:
    """First against last report (class_name, report, retained, instances) for each class, summed over loaders."""
    return changes(reports, F.broadcast(reports.agg(F.max("report").alias("last"))))


def changes(reports: DataFrame, last: int | DataFrame) -> DataFrame:
    """The same where the last report's number is known, or in a table of one row: rows may be missing from whole reports."""
    rows = reports.withColumn("last", F.lit(last)) if isinstance(last, int) else reports.crossJoin(last)
    pick = lambda c, when: F.sum(F.when(when, F.col(c)))
    first, last = F.col("report") == 0, F.col("report") == F.col("last")
    sums = rows.groupBy("class_name").agg(pick("retained", first).alias("fr"), pick("retained", last).alias("lr"), pick("instances", first).alias("fi"), pick("instances", last).alias("li"))
    zero = F.lit(0).cast("long")
    state = F.when(F.col("fr").isNull() & F.col("lr").isNull(), "passing").when(F.col("fr").isNull(), "new").when(F.col("lr").isNull(), "gone").otherwise("kept")
    value = lambda c: F.coalesce(c, zero)
    return sums.select("class_name", state.alias("state"), value("fr").alias("first_retained"), value("lr").alias("last_retained"), (value("lr") - value("fr")).alias("delta_retained"), (value("li") - value("fi")).alias("delta_instances"))


def histories(reports: DataFrame) -> DataFrame:
    """class_name, state, and of every report in order its retained size and instances (0 where the class is missing), with
    the difference of the ends: arrays as long as there are reports."""
    ends = F.broadcast(reports.agg(F.max("report").cast("int").alias("last")))  # one row
    found = reports.groupBy("class_name", "report").agg(F.sum("retained").alias("retained"), F.sum("instances").alias("instances"))
    maps = found.groupBy("class_name").agg(*[F.map_from_entries(F.collect_list(F.struct(F.col("report").cast("int").alias("k"), F.col(c).alias("v")))).alias(c) for c in ("retained", "instances")])
    every = F.sequence(F.lit(0), F.col("last"))
    along = lambda c: F.transform(every, lambda k: F.coalesce(F.try_element_at(F.col(c), k), F.lit(0).cast("long")))
    start, end = F.array_contains(F.map_keys("retained"), 0), F.array_contains(F.map_keys("retained"), F.col("last"))
    state = F.when(start & end, "kept").when(start, "gone").when(end, "new").otherwise("passing")
    rows = maps.crossJoin(ends).select("class_name", state.alias("state"), along("retained").alias("retained"), along("instances").alias("instances"))
    return rows.withColumn("delta_retained", F.element_at("retained", -1) - F.element_at("retained", 1))


def heavy_classes(reports: DataFrame, share: int = 10) -> DataFrame:
    """The rows of classes that hold ``share`` percent of their report's retained sum: suspects where only rows are known."""
    total = reports.groupBy("report").agg(F.sum("retained").alias("total"))
    return reports.join(F.broadcast(total), "report").where(F.col("retained").cast("decimal(38,0)") * 100 >= F.col("total").cast("decimal(38,0)") * share).drop("total")


def compared(ours: DataFrame, theirs: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """One row for each key of either side: match, differs, missing (on our side) or extra, and which measures."""
    a = ours.select(*keys, *[F.col(m).alias(f"ours_{m}") for m in measures], F.lit(True).alias("in_ours"))
    b = theirs.select(*keys, *[F.col(m).alias(f"theirs_{m}") for m in measures], F.lit(True).alias("in_theirs"))
    differing = F.array_compact(F.array(*[F.when(~F.col(f"ours_{m}").eqNullSafe(F.col(f"theirs_{m}")), m) for m in measures]))
    outcome = F.when(F.col("in_ours").isNull(), "missing").when(F.col("in_theirs").isNull(), "extra").when(F.size(differing) == 0, "match").otherwise("differs")
    return a.join(b, keys, "full").select(*keys, outcome.alias("outcome"), F.when(outcome == "differs", F.array_join(differing, ",")).otherwise("").alias("measures"))


def any_equal(ours: DataFrame, theirs: DataFrame, key: str, measures: list[str]) -> DataFrame:
    """Their rows, each with whether any of our rows of the same name agrees in all measures."""
    same = ours.select(key, *measures).distinct().withColumn("found", F.lit(True))
    return theirs.join(same, [key, *measures], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def matched_once(ours: DataFrame, theirs: DataFrame, keys: list[str]) -> DataFrame:
    """Their rows matched with ours of the same keys, each of ours used once: counts by key."""
    a, b = (t.groupBy(*keys).agg(F.count("*").alias(n)) for t, n in ((ours, "ours"), (theirs, "theirs")))
    both = a.join(b, keys, "full").na.fill(0, ["ours", "theirs"])
    return both.withColumn("matched", F.least("ours", "theirs"))


def suspects_compared(ours: DataFrame, theirs: DataFrame, total: int) -> DataFrame:
    """Their suspects (class_name, retained, pct) with ours of the name: missing, match, differs, or explained where only
    the class objects that the other tool roots differ; and the same of the percentage to two decimals."""
    rows = theirs.join(ours.groupBy("class_name").agg(F.max("retained").alias("ours")), "class_name", "left")
    gap = F.col("class_name") == "java.lang.Class"
    outcome = F.when(F.col("ours").isNull(), "missing").when(F.col("ours") == F.col("retained"), "match").when(gap, "explained").otherwise("differs")
    shown = F.format_string("%.2f", F.col("pct").cast("double"))
    share = lambda c: F.format_string("%.2f", F.lit(0.0) if not total else F.col(c) / float(total) * 100)
    pct = F.when(F.col("ours").isNull(), "missing").when(share("ours") == shown, "rounded").when(gap & (share("retained") == shown), "explained").otherwise("differs")
    return rows.select("class_name", outcome.alias("retained_outcome"), pct.alias("pct_outcome"))


def classes_compared(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Their biggest classes (class_name, objects, retained): missing, match or differs on our side."""
    mine = ours.select("class_name", F.col("objects").alias("o"), F.col("retained").alias("r"))
    same = (F.col("o") == F.col("objects")) & (F.col("r") == F.col("retained"))
    return theirs.join(mine, "class_name", "left").select("class_name", F.when(F.col("r").isNull(), "missing").when(same, "match").otherwise("differs").alias("outcome"))


def packages_compared(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """Their packages (package, objects, retained) with ours: skipped where we have none, match, differs, or explained.

    Differences are explained where all of them are on the way to java.lang or below it, and the other
    tool has more top-level objects at each: it roots class objects that we don't."""
    mine = ours.select("package", F.col("objects").alias("o"), F.col("retained").alias("r"))
    rows = theirs.join(mine, "package", "left").withColumn("apart", F.coalesce(F.col("r") != F.col("retained"), F.lit(False)))
    chain = F.col("package").isin("", "java", "java.lang") | F.col("package").startswith("java.lang.")
    proof = F.broadcast(rows.where("apart").agg(F.coalesce(F.bool_and(chain & (F.col("objects") > F.col("o"))), F.lit(False)).alias("proven")))  # one row
    outcome = F.when(F.col("r").isNull(), "skipped").when(~F.col("apart"), "match").when(chain & F.col("proven"), "explained").otherwise("differs")
    return rows.crossJoin(proof).select("package", outcome.alias("outcome"))


def display_band(shown: str | Column) -> Column:
    """low, high: the bytes that a shown size ("1.2 GB", one decimal at most) may stand for; null where it is none."""
    text = F.col(shown) if isinstance(shown, str) else shown
    value = F.regexp_replace(F.regexp_extract(text, r"^([0-9,]+(?:\.[0-9]+)?) (B|KB|MB|GB|TB)$", 1), ",", "")
    unit = F.regexp_extract(text, r" (B|KB|MB|GB|TB)$", 1)
    scale = F.create_map(*[F.lit(x) for k, u in enumerate(("B", "KB", "MB", "GB", "TB")) for x in (u, float(1 << 10 * k))])[unit]
    half = scale * 0.5 / F.pow(F.lit(10.0), F.when(value.contains("."), F.length(F.substring_index(value, ".", -1))).otherwise(0))
    middle = F.when(value != "", value.cast("double")) * scale
    return F.when(middle.isNotNull(), F.struct(F.greatest(middle - half, F.lit(0.0)).alias("low"), (middle + half).alias("high")))


def verdict(growth_rows: DataFrame, first_shallow: int, last_shallow: int, new_suspects: int = 0) -> str:
    """One sentence on how the heap grew, from the rows of ``growth`` and both shallow totals."""
    delta = last_shallow - first_shallow
    share = delta / first_shallow * 100 if first_shallow > 0 else 0.0
    if delta > 0:
        lead = growth_rows.where("delta_retained > 0").orderBy(F.desc("delta_retained"), "class_name").first()
        driver = f"; largest driver `{lead.class_name}` ({lead.delta_retained:+,} bytes retained)" if lead else ""
        line = f"Heap grew {share:.1f}% ({delta:+,} bytes shallow){driver}."
    elif delta < 0:
        line = f"Heap shrank {-share:.1f}% ({delta:+,} bytes shallow); no net growth."
    else:
        line = "Heap size is unchanged."
    return line + (f" {new_suspects} new suspect{'' if new_suspects == 1 else 's'}." if new_suspects else "")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, as often, in any order."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def sweep_gate(diffs: DataFrame, least: int = 15) -> DataFrame:
    """Over diffs (name, fails, compared): no failure, and ``least`` real comparisons."""
    return diffs.agg(F.sum("fails").alias("fails"), F.count_if(F.col("compared") > 0).alias("comparisons")).withColumn("passed", (F.col("fails") == 0) & (F.col("comparisons") >= least))
