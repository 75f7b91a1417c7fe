"""Helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which driver and executors share.

    Only where the session names none and driver and executors are one process (tests) is one made in the local
    temporary folder; a cluster must name one.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='cairn-checkpoints-')}"
        spark.conf.set("spark.checkpoint.dir", where)
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a compressed table in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a reread of the table, not the work before it. The
    table is removed when the Python process ends; a killed driver leaves it to the folder's owner.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cairn-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def _remove_written() -> None:
    for spark, path in _WRITTEN:
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # the session may be gone already; the folder's owner removes what is left
            pass


atexit.register(_remove_written)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


#: Bits of a sieve at most: 16 MB, the most that is sent to every executor, and a sixteenth of its keys' places up
#: to some eight million keys. With more keys more rows pass, up to all: never a wrong result, one exchange at worst.
SIEVE = 1 << 27
#: Bits of one row of a sieve; bitmap_construct_agg makes them.
_BITMAP = 1 << 15


def text_key(text: Column | None = None) -> Column:
    """The text's SHA-256, as binary; a null text is an empty one."""
    return F.unhex(F.sha2(F.encode(text_or_empty() if text is None else text, "UTF-8"), 256))


def sieved(rows: DataFrame, key: str, wanted: DataFrame, inverse: bool = False) -> DataFrame:
    """The rows whose ``key`` may be, or with ``inverse`` can't be, among those of ``wanted`` (a written table).

    A bitmap of hashes, sized by the wanted keys, is sent to the executors."""
    size = _BITMAP
    while size < min(16 * wanted.count(), SIEVE):
        size *= 2
    place = F.pmod(F.xxhash64(key), F.lit(size))
    spread = wanted.select(place.alias("__place")).distinct()
    bitmaps = spread.groupBy(F.expr(f"__place div {_BITMAP}").alias("__bitmap")).agg(F.expr(f"bitmap_construct_agg(__place % {_BITMAP})").alias("__bits"))
    met = rows.withColumn("__place", place).withColumn("__bitmap", F.expr(f"__place div {_BITMAP}")).join(F.broadcast(bitmaps), "__bitmap", "left")
    octet = F.expr(f"ascii(decode(substring(__bits, cast((__place % {_BITMAP}) div 8 as int) + 1, 1), 'ISO-8859-1'))")
    bit = F.coalesce(octet.bitwiseAND(F.expr("shiftleft(1, cast(__place % 8 as int))")) != 0, F.lit(False))
    return met.where(~bit if inverse else bit).drop("__place", "__bitmap", "__bits")


def without_rows(docs: DataFrame, key: Callable[[Column], Column], dropped: DataFrame, repeated: DataFrame) -> DataFrame:
    """``docs`` without the rows whose doc_id and ``key`` of the text are in ``dropped`` (doc_id, key, both written);
    of rows of an id in ``repeated`` that agree in both only one stays. Only texts of rows whose id the sieve
    lets through are looked at and moved."""
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"))
    gone = dropped.select(F.col("doc_id").alias("gone_id"), F.col("key").alias("gone_key")).distinct()
    several = not repeated.isEmpty()
    wanted = dropped.select(F.col("doc_id").alias("id"))
    wanted = written(wanted.unionByName(repeated.select(F.col("doc_id").alias("id"))).distinct(), "wanted-ids") if several else wanted
    some = sieved(rows, "id", wanted).withColumn("key", key(text_or_empty("row.text")))
    some = some.join(gone, (F.col("key") == F.col("gone_key")) & F.col("id").eqNullSafe(F.col("gone_id")), "left_anti")
    if several:
        some = some.dropDuplicates(["id", "key"])
    out = some.select("row").unionByName(sieved(rows, "id", wanted, inverse=True).select("row"))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, giving freed memory back to the system when a task ends: workers are kept between tasks."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.set_memory_pool(pa.system_memory_pool())
        try:
            yield from run(batches)
        finally:
            trim()

    return wrapped


def trim() -> None:
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # only glibc has it
        pass


def by_batch(df: DataFrame, schema: str, rows: Callable[[dict[str, list]], dict[str, list]]) -> DataFrame:
    """mapInArrow for a function from columns (Python lists) to columns; ``schema`` gives types and order."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                out = rows({n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([_arrow(out[n], kind) for n, kind in zip(names, _kinds(schema), strict=True)], names=names)

    return df.mapInArrow(lean(run), schema)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}


def _kinds(schema: str) -> list[str]:
    return [c.strip().split(" ")[1] for c in schema.split(",")]


def _arrow(values, kind: str) -> pa.Array:
    return values if isinstance(values, pa.Array) else pa.array(values, type=_ARROW[kind])
