"""Streams: growth over a folder of saved reports, and windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def report_stream(spark: SparkSession, folder: str, version: int = 1, per_trigger: int = 20) -> DataFrame:
    """class_name, instances, retained, at (file time) of each report's histogram as it arrives.

    Expects the columns of a class histogram in its own order; state is by class, so it is bounded by their number."""
    files = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", per_trigger).load(folder).withColumn("at", F.col("_metadata.file_modification_time"))
    rows = files.select("at", F.from_json("value", "version int, sections map<string, struct<title:string,columns:array<string>,rows:array<array<string>>>>").alias("r"))
    hist = F.col("r.sections")["histogram"]
    place = lambda name: F.array_position(F.col("columns"), F.lit(name)).cast("int")
    each = rows.where(F.col("r.version") == version).select("at", hist["columns"].alias("columns"), F.explode(hist["rows"]).alias("x"))
    pick = lambda name: F.element_at("x", place(name))
    return each.select("at", pick("class_name").alias("class_name"), pick("instances").cast("long").alias("instances"), pick("retained").cast("long").alias("retained"))


def streamed_growth(rows: DataFrame) -> DataFrame:
    """First and last retained size of each class so far, for complete or update output."""
    sums = rows.groupBy("class_name").agg(F.min(F.struct("at", "retained")).alias("a"), F.max(F.struct("at", "retained")).alias("b"), F.count("*").alias("reports"))
    return sums.select("class_name", F.col("a.retained").alias("first_retained"), F.col("b.retained").alias("last_retained"), (F.col("b.retained") - F.col("a.retained")).alias("delta_retained"), "reports")


def windowed(events: DataFrame, length: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Counts and sums by event type and tumbling window of ts; on a stream, events later than ``late`` are dropped."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    rows = events.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum(F.floor("value").cast("long")).alias("total"))
    return rows.select(F.col("w.start").alias("window_start"), "event_type", "events", "total")


