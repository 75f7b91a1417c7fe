"""Tables written between iterations, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructField, StructType

_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; without one, a temporary folder where driver and tasks are one process."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='cairn-heap-')}"
        spark.conf.set("spark.checkpoint.dir", where)
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


@contextlib.contextmanager
def by_real_size(spark: SparkSession) -> Iterator[None]:
    """Joins planned within choose a broadcast by the bytes that were really exchanged, not by the size of files: ids in
    order take next to no space in a file, and very much when they are sent to every executor."""
    most, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = {k: spark.conf.get(k, None) for k in (most, adaptive)}
    if before[adaptive] is None:
        spark.conf.set(adaptive, spark.conf.get(most))
    spark.conf.set(most, "-1")
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write and reread: cuts the lineage of a loop, and a lost executor costs a reread only. The table is removed
    when the driver's Python ends. ``by`` names columns whose values get folders of their own."""
    path = f"{shared_folder(df.sparkSession)}/heap-{name}-{uuid.uuid4().hex}"
    with by_real_size(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path, partitionBy=list(by) or None)
    _WRITTEN.append((df.sparkSession, path))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove_written() -> None:
    for spark, path in _WRITTEN:
        try:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may be gone already; the folder's owner removes what is left
            pass


atexit.register(_remove_written)


def one_row(*frames: DataFrame) -> DataFrame:
    """The columns of several one-row tables as one row. Each is worked out on its own: together they would
    make one plan of very many joins."""
    values, fields = [], []
    for frame in frames:
        row = frame.first()
        values += list(row) if row is not None else [None] * len(frame.columns)
        fields += frame.schema.fields
    schema = StructType([StructField(f.name, f.dataType, True) for f in fields])
    return frames[0].sparkSession.createDataFrame([tuple(values)], schema)
