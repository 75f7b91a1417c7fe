"""Exact deduplication of an incoming batch against immutable snapshots, screened by binary-fuse filters.

A snapshot is written once: its distinct digests with their smallest doc_id and number of rows, in buckets
by digest, and for each bucket a static binary-fuse filter of about nine bits a digest. Incoming rows are first
grouped among themselves, so that copies within the batch are found without the snapshot and only distinct
digests go on. Each meets its bucket's filter; only those that pass (all true members, and about one in
256 others) are joined with the exact buckets. Last, the bytes of every row that has a partner are compared
with those of the row that stays; rows that share a digest but not the bytes are grouped anew by their texts.

Grouping combines before the shuffle, and joins have one row for each digest on one side, so any number of
copies spreads over tasks. Filters stay in the tables and meet digests by a join: none is sent to the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm._common import sieved, text_key, text_or_empty, without_rows, written

#: Digests in a filter, on average.
BUCKET_DIGESTS = 50_000


def normalised(text: Column) -> Column:
    """The text with each run of ASCII white space replaced by one space."""
    return F.regexp_replace(text, "[\\x20\\x09-\\x0D]+", " ")


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.encode(text, "UTF-8"), 256))


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = keys + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (2**64 - 1))
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(33))


def _places(h: np.ndarray, segment: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Three neighbouring segments' slots of each hash, and its eight-bit fingerprint."""
    base = ((h >> np.uint64(32)) * np.uint64(segments)) >> np.uint64(32)
    mask = np.uint64(segment - 1)
    inner = [(h >> np.uint64(s)) & mask for s in (0, 18, 36)]
    slots = np.stack([(base + np.uint64(k)) * np.uint64(segment) + inner[k] for k in range(3)]).astype(np.int64)
    return slots, ((h ^ (h >> np.uint64(47))) & np.uint64(255)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> bytes:
    """A static filter of distinct 64-bit keys: every key passes, others about once in 256.

    Keys are peeled in rounds: a slot that one remaining key alone touches can be set last, to make
    that key's three slots XOR to its fingerprint. Each round takes all such keys at once."""
    n = len(keys)
    segment = 1 << max(3, min(17, int(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
    per = 1.125 if n > 100_000 else 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 3))
    segments = max(1, -(-int(n * max(per, 1.125) + 16) // segment) - 2)
    for seed in range(1000):
        slots, prints = _places(_mixed(keys, seed), segment, segments)
        size = (segments + 2) * segment
        count = np.bincount(slots.ravel(), minlength=size)
        owner = np.zeros(size, np.int64)
        for k in range(3):
            np.bitwise_xor.at(owner, slots[k], np.arange(n))
        left, order = n, []
        ready = np.flatnonzero(count == 1)
        while len(ready):
            key, first = np.unique(owner[ready], return_index=True)
            order.append((key, ready[first]))
            left -= len(key)
            for k in range(3):
                np.subtract.at(count, slots[k][key], 1)
                np.bitwise_xor.at(owner, slots[k][key], key)
            touched = np.unique(slots[:, key])
            ready = touched[count[touched] == 1]
        if left:
            continue
        table = np.zeros(size, np.uint8)
        for key, slot in reversed(order):
            three = slots[:, key]
            others = np.where(three == slot, np.uint8(0), table[three])
            table[slot] = prints[key] ^ others[0] ^ others[1] ^ others[2]
        return np.array([seed, segment, segments], "<u4").tobytes() + table.tobytes()
    raise ValueError("no filter found: keys repeat")


def passes(filter_bytes: bytes, keys: np.ndarray) -> np.ndarray:
    seed, segment, segments = np.frombuffer(filter_bytes, "<u4", 3).tolist()
    table = np.frombuffer(filter_bytes, np.uint8, offset=12)
    slots, prints = _places(_mixed(keys, seed), segment, segments)
    return table[slots[0]] ^ table[slots[1]] ^ table[slots[2]] == prints


def _key64(digests: pa.ChunkedArray) -> np.ndarray:
    """The digest's last eight bytes, or all of a shorter one, as a number."""
    return np.array([int.from_bytes(d[-8:], "little") for d in digests.to_pylist()], np.uint64)


def grouped(rows: DataFrame) -> DataFrame:
    """digest, first_id (smallest doc_id), rows: from doc_id, digest."""
    return rows.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("rows"))


def snapshot(rows: DataFrame, n_buckets: int) -> tuple[DataFrame, DataFrame]:
    """The exact buckets (bucket, digest, first_id, rows) and filters (bucket, filter) of doc_id, digest rows."""
    exact = written(grouped(rows).withColumn("bucket", _bucket(n_buckets)), "exact-buckets")

    def build(group: pa.Table) -> pa.Table:
        return pa.table({"bucket": group.column("bucket").slice(0, 1), "filter": pa.array([build_filter(np.unique(_key64(group.column("digest"))))], pa.binary())})

    return exact, written(exact.select("bucket", "digest").groupBy("bucket").applyInArrow(build, "bucket int, filter binary"), "fuse-filters")


def _bucket(n_buckets: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(n_buckets)).cast("int")


def screened(batch: DataFrame, filters: DataFrame, n_buckets: int) -> DataFrame:
    """The rows of ``batch`` (digest, first_id, rows; digests distinct) that pass their bucket's filter."""

    def screen(digests: pa.Table, found: pa.Table) -> pa.Table:
        keep = passes(found.column("filter")[0].as_py(), _key64(digests.column("digest"))) if found.num_rows and digests.num_rows else np.zeros(digests.num_rows, bool)
        return digests.filter(pa.array(keep))

    left = batch.withColumn("bucket", _bucket(n_buckets)).groupBy("bucket")
    return left.cogroup(filters.groupBy("bucket")).applyInArrow(screen, "digest binary, first_id long, rows long, bucket int")


def dedup(docs: DataFrame, in_snapshot: Column, digest: Callable[[Column], Column] = sha256_digest) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``.

    ``in_snapshot`` says which rows are the immutable snapshot; all others are the incoming batch. Of rows
    whose normalised texts are equal, that with the smallest doc_id stays; of equal (or null) ids, which count
    as the smallest, each is marked as kept. A null text is an empty one. Other columns are ignored. ``digest`` may be
    weak: rows of equal digests and different bytes are told apart.
    """
    # null ids can't be compared; the smallest number stands for them until the end
    number, known = F.col("doc_id").cast("long"), F.col("doc_id").cast("long").isNotNull()
    base = docs.select(F.coalesce(number, F.lit(-(2**63))).alias("doc_id"), (~known).alias("null_id"), text_or_empty().alias("raw"), F.coalesce(in_snapshot, F.lit(False)).alias("snap"))
    # the hash of the text as it is finds rows again without normalising all texts once more
    base = base.withColumn("h", F.xxhash64("raw"))
    rows = _digested(base, digest)
    strong = digest is sha256_digest
    digests = written(rows.select("doc_id", "null_id", "snap", "h", "digest", *([] if strong else [F.sha2(F.encode("norm", "UTF-8"), 256).alias("text_sha256")])), "digests")
    if strong:
        digests = digests.withColumn("text_sha256", F.lower(F.hex("digest")))
    n_buckets = max(1, -(-digests.count() // BUCKET_DIGESTS))

    exact, filters = snapshot(digests.where("snap"), n_buckets)
    batch = written(grouped(digests.where("not snap")), "new-batch")
    hits = screened(batch, filters, n_buckets).alias("b").join(exact.alias("e"), "digest").select("digest", F.least("b.first_id", "e.first_id").alias("keep_id"), (F.col("b.rows") + F.col("e.rows")).alias("group_size"))
    hits = written(hits, "snapshot-hits")
    alone = [t.join(hits, "digest", "left_anti").select("digest", F.col("first_id").alias("keep_id"), F.col("rows").alias("group_size")) for t in (exact, batch)]
    groups = reduce(DataFrame.unionByName, alone, hits)

    placed = written(digests.join(groups, "digest"), "grouped-rows")
    wrong = written(_other_bytes(base, placed, digest), "colliding-digests")  # none but with a weak digest
    out = placed
    if not wrong.isEmpty():
        wrong = wrong.distinct()
        out = placed.drop("h").join(wrong, "digest", "left_anti").unionByName(_by_text(rows, wrong))
    smallest = F.lit(-(2**63))
    return out.select(
        F.when(~F.col("null_id"), F.col("doc_id")).alias("doc_id"),
        F.when(F.col("keep_id") != smallest, F.col("keep_id")).alias("keep_id"),
        "group_size",
        (F.col("doc_id") == F.col("keep_id")).alias("kept"),
        "text_sha256",
    )


def _digested(base: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    return base.withColumn("norm", normalised(F.col("raw"))).withColumn("digest", digest(F.col("norm"))).drop("raw")


def first_rows(docs: DataFrame, in_snapshot: Column) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group, with all columns as they are.

    Null texts are empty; of rows of one id and text any one stays; an empty table stays empty."""
    found = written(dedup(docs, in_snapshot).select("doc_id", "kept", F.unhex("text_sha256").alias("key")), "exact-groups")
    repeated = found.where("kept").groupBy("doc_id", "key").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    dropped = found.where("not kept").select("doc_id", "key")
    return without_rows(docs, lambda text: text_key(normalised(text)), written(dropped, "exact-dropped"), written(repeated, "repeated-ids"))


def _other_bytes(base: DataFrame, placed: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    """Digests of rows whose digest is shared and whose bytes differ from those of a row that stays.

    A sieve of the texts' own hashes lets only such rows be normalised and moved, and few others. Rows that stay are found
    by digest and id together, so that a group of any size spreads over tasks, and are one for each digest after."""
    shared = written(placed.where("group_size > 1").select("digest", "keep_id", "h").distinct(), "shared-digests")
    texts = written(_digested(sieved(base, "h", shared), digest).select("digest", "doc_id", "norm"), "shared-texts")
    firsts = shared.select("digest", F.col("keep_id").alias("doc_id")).distinct()
    stay = texts.join(firsts, ["digest", "doc_id"]).select("digest", F.col("norm").alias("kept_norm"))
    stay = written(stay.dropDuplicates(["digest", "kept_norm"]), "kept-texts")
    return texts.join(stay, "digest").where("norm != kept_norm").select("digest")


def _by_text(rows: DataFrame, digests: DataFrame) -> DataFrame:
    texts = rows.join(digests, "digest", "left_semi")
    groups = texts.groupBy("norm").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    return texts.join(groups, "norm").select("digest", "doc_id", "null_id", "snap", "keep_id", "group_size", F.sha2(F.encode("norm", "UTF-8"), 256).alias("text_sha256"))
