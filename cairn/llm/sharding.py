"""A uniform shuffle into shards of exact size, from a hypergeometric communication matrix.

Row p of the matrix says how many rows of input partition p go to each shard. The matrix is a multivariate
hypergeometric draw: exactly what a uniform permutation of all rows would give. It is never held whole:
partitions form a binary tree, each node splits its shard counts between its halves with a draw seeded by
the node, and a task walks down to the rows it needs. So only the partitions' row counts are sent
(8 bytes for each input partition), and any task, also one rerun elsewhere, finds the same numbers.

Within a partition a keyed bijection permutes the rows, and cumulative counts of the matrix row cut them into
shards. Rows are exchanged, and a second keyed bijection over the shard's rows gives the slot. Both
are pure functions of (partition, row number), so nothing is sorted or held to be permuted, and a
shard may be larger than any task: it is dealt out in blocks of slots.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm._common import text_or_empty, written

#: Slots of a shard that are exchanged to one task and written together.
BLOCK = 1 << 20
#: Rows up to which a permutation is drawn as a list.
LISTED = 4096
_LARGE = 10**9


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many of n rows drawn from good + bad are good; numpy's draw, and beyond its range one by
    inversion over 14 standard deviations around the mode."""
    if n == 0 or good == 0:
        return 0
    if bad == 0:
        return n
    total = good + bad
    if total < _LARGE:
        return int(rng.hypergeometric(good, bad, n))
    mode = (n + 1) * (good + 1) // (total + 2)
    spread = int(14 * math.sqrt(n * (good / total) * (bad / total) * ((total - n) / (total - 1)))) + 16
    low, high = max(0, n - bad, mode - spread), min(n, good, mode + spread)
    k = np.arange(low, high, dtype=np.float64)
    steps = np.log((good - k) * (n - k)) - np.log((k + 1) * (bad - n + k + 1))
    logs = np.concatenate([[0.0], np.cumsum(steps)])
    share = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(share, rng.random() * share[-1]))


def split_counts(rng: np.random.Generator, shards: np.ndarray, n: int) -> np.ndarray:
    """How many of n rows drawn from all fall on each shard's places."""
    out, rest = np.zeros(len(shards), np.int64), int(shards.sum())
    for s, size in enumerate(shards.tolist()):
        rest -= size
        out[s] = took = hypergeometric(rng, size, rest, n)
        n -= took
    return out


def matrix_row(before: np.ndarray, sizes: np.ndarray, seed: int, p: int) -> tuple[np.ndarray, np.ndarray]:
    """Partition p's counts by shard, and the shards' rows that come from partitions before p.

    before: rows in all partitions before each one, and at last all rows."""
    low, high, counts, ahead = 0, len(before) - 1, sizes.copy(), np.zeros(len(sizes), np.int64)
    while high - low > 1:
        mid = (low + high) // 2
        left = split_counts(np.random.default_rng([seed, low, high]), counts, int(before[mid] - before[low]))
        if p < mid:
            counts, high = left, mid
        else:
            ahead, counts, low = ahead + left, counts - left, mid
    return counts, ahead


def permuted(index: np.ndarray, n: int, key: list[int]) -> np.ndarray:
    """A keyed bijection of 0 to n-1, applied to index: a drawn permutation of few rows, whose order must be exactly
    uniform; beyond LISTED six Feistel rounds, walking on while outside, which need no table."""
    if n <= LISTED:
        return np.random.default_rng(key).permutation(n)[index]
    half = max(1, ((max(n, 2) - 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    keys = np.random.default_rng(key).integers(0, 1 << 63, 6, dtype=np.uint64)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & mask
        for k in keys:
            mixed = (right + k) * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            left, right = right, left ^ ((mixed >> np.uint64(32)) & mask)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= n]
    return out.astype(np.int64)


def shuffled_shards(rows: DataFrame, n_shards: int = 40, seed: int = 20) -> DataFrame:
    """``rows`` with shard (0 to n_shards - 1) and slot (gapless from 0 in each shard), uniformly shuffled.

    Shard sizes differ by one at most. The rows are written once, with the input partition and row number
    that they had, so that later tasks agree on them; columns named shard or slot are replaced. Equal rows
    count as different ones; an empty table gives no rows.
    """
    rows = rows.drop("shard", "slot", "__row", "__block")
    kept = written(rows.withColumn("__row", F.monotonically_increasing_id()), "shards")
    found = kept.groupBy(F.shiftrightunsigned("__row", 33).alias("p")).agg(F.count("*").alias("n")).collect()
    counts = np.zeros(max([r.p for r in found], default=-1) + 1, np.int64)
    for r in found:
        counts[r.p] = r.n
    before = np.concatenate([[0], np.cumsum(counts)])
    sizes = np.array([(int(before[-1]) + n_shards - 1 - s) // n_shards for s in range(n_shards)], np.int64)
    sent, names = rows.sparkSession.sparkContext.broadcast(before), rows.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, known = sent.value, {}
        for batch in batches:
            row = batch.column(batch.schema.names.index("__row")).to_numpy()
            parts, at = row >> 33, row & ((1 << 33) - 1)
            shard, slot = np.zeros(len(row), np.int32), np.zeros(len(row), np.int64)
            for p in np.unique(parts).tolist():
                if p not in known:
                    known = {p: matrix_row(before, sizes, seed, p)} if len(known) > 64 else known | {p: matrix_row(before, sizes, seed, p)}
                own, ahead = known[p]
                here = np.flatnonzero(parts == p)
                j = permuted(at[here], int(own.sum()), [seed, 1, p])
                ends = np.cumsum(own)
                shard[here] = s = np.searchsorted(ends, j, "right")
                slot[here] = ahead[s] + j - (ends[s] - own[s])
            for s in np.unique(shard).tolist():
                here = np.flatnonzero(shard == s)
                slot[here] = permuted(slot[here], int(sizes[s]), [seed, 2, s])
            columns = [c for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "__row"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(shard), pa.array(slot)], names=[*names, "shard", "slot"])

    placed = kept.mapInArrow(place, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "shard int", "slot long"]))
    tasks = max(n_shards, int(sum(-(-int(n) // BLOCK) for n in sizes)))
    return placed.repartition(tasks, "shard", F.shiftright("slot", 20)).sortWithinPartitions("shard", "slot")


def shard_documents(docs: DataFrame, n_shards: int = 40, seed: int = 20) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row of ``docs``, under the law `rows`.

    size is the text's UTF-8 bytes plus 16, a null text having none. Copies and repeated ids are separate rows.
    Other columns are ignored.
    """
    text = text_or_empty()
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    return shuffled_shards(rows, n_shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
