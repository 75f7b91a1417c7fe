"""Saved reports as tables, once or as a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows are kept as text: their columns differ from section to section.
SCHEMA = "version int, source string, sections map<string, struct<title:string,columns:array<string>,rows:array<array<string>>>>"


def parsed(texts: DataFrame, version: int) -> DataFrame:
    """source, sections of whole report files (column value); another version is an error."""
    rows = texts.select(F.from_json("value", SCHEMA).alias("r")).select("r.*")
    wrong = F.raise_error(F.concat(F.lit("a report of version "), F.coalesce(F.col("version").cast("string"), F.lit("?")), F.lit(f"; only {version} can be read")))
    return rows.withColumn("version", F.when(F.col("version") == version, F.col("version")).otherwise(wrong)).where("version IS NOT NULL")


def section(reports: DataFrame, name: str) -> DataFrame:
    """ord, source, and a column for each of a section's (from the first report that has it)."""
    rows = reports.where(F.col("sections")[name].isNotNull())
    columns = rows.select(F.col("sections")[name]["columns"].alias("c")).first().c
    each = rows.select(*[c for c in ("ord", "source") if c in reports.columns], F.explode(F.col("sections")[name]["rows"]).alias("x"))
    return each.select(*[c for c in ("ord", "source") if c in reports.columns], *[F.col("x")[i].alias(c) for i, c in enumerate(columns)])


def read_reports(spark: SparkSession, paths: list[str], version: int = 1) -> DataFrame:
    """Reports in the order given, with ord from 0; `.gz` files are unpacked."""
    out = None
    for i, path in enumerate(paths):
        one = parsed(spark.read.text(path, wholetext=True), version).withColumn("ord", F.lit(i))
        out = one if out is None else out.unionByName(one)
    return out


def suspect_rows(reports: DataFrame) -> DataFrame:
    """report, class_name, instances, retained of the leak suspects: single objects and groups, summed by class."""
    rows = section(reports, "suspects")
    return rows.groupBy(F.col("ord").alias("report"), "class_name").agg(F.sum(F.col("objects").cast("long")).alias("instances"), F.sum(F.col("retained").cast("long")).alias("retained"))


def shallow_totals(reports: DataFrame) -> list[int]:
    """Shallow bytes of what is reachable, by report: a number for each file that was named."""
    return [r.bytes for r in section(reports, "totals").select("ord", F.col("reachable_shallow").cast("long").alias("bytes")).orderBy("ord").collect()]


def class_rows(reports: DataFrame) -> DataFrame:
    """report, class_name, instances, retained of the histograms, for growth; loaders' rows are summed."""
    rows = section(reports, "histogram")
    return rows.groupBy(F.col("ord").alias("report"), "class_name").agg(F.sum(F.col("instances").cast("long")).alias("instances"), F.sum(F.col("retained").cast("long")).alias("retained"))
