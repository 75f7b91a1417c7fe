"""SimHash near-duplicates: fingerprints within two bits, found by deletion-variant signatures.

A 64-bit fingerprint is cut into two segments of 32 bits. If two fingerprints differ by two bits at most, one
of the segments differs by one bit at most: so they share that segment itself, or one of its 32 variants
with one bit taken out. Distinct fingerprints are indexed under those 66 keys and meet by equality;
every meeting is verified on all 64 bits and counted under one key only.

A key under which many distinct fingerprints meet (a large family of near copies) isn't compared pair
by pair. Its members are grouped again by variants of the other segment: one bit taken out where the key
lacks a bit, two where it lacks none. Members of such a group are within two bits of each other by
construction, so each is linked to the first of its group, and no link between different components is
lost or made. Runs too long for a task's memory take the same step as an exchange between tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm._common import by_batch, text_key, text_or_empty, without_rows, written
from cairn.llm.components import components

#: Distinct fingerprints under a key that are compared pair by pair.
PAIRED = 32
#: Distinct fingerprints under a key that are grouped again within a task (8 bytes each).
HELD = 1 << 20
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
_LOW = np.uint64(0xFFFFFFFF)


def fingerprint(text: str, width: int = 3) -> int:
    """The SimHash of a text's word shingles, repeats included; zero without words.

    ASCII letters are lowered and words are what ASCII white space separates. Fewer words than
    ``width`` make one shingle. A bit is set where more than half of the shingles' hashes have it."""
    words = text.encode("utf-8").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    n = max(1, len(words) - width + 1)
    counts, digest, view = np.zeros(64, np.int64), xxhash.xxh64_intdigest, memoryview(joined)
    for at in range(0, n, 1 << 16):
        last = ends[at + width - 1 :][: min(n - at, 1 << 16)] if len(words) >= width else ends[-1:]
        hashes = np.array([digest(view[s:e], 42) for s, e in zip(starts[at : at + len(last)].tolist(), last.tolist(), strict=True)], "<u8")
        octets = hashes.view(np.uint8).reshape(-1, 8)
        if len(hashes) < 500:
            counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        else:
            counts += np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keyed: bool = False) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a long) for each row of ``docs``; null texts are empty.

    With ``keyed`` also key, the text's digest, which tells rows of one doc_id apart."""

    def rows(batch: dict[str, list]) -> dict[str, list]:
        fps = np.array([fingerprint(t) for t in batch["text"]], np.uint64).view(np.int64)
        return batch | {"fp": pa.array(fps)}

    key = [text_key().alias("key")] if keyed else []
    return by_batch(docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"), *key), "doc_id long, fp long" + ", key binary" * keyed, rows)


#: Key number: 33 for each segment, of which the last takes out no bit. The key has it above the segment's bits.
_KEYS = "explode(transform(sequence(0, 65), i -> struct((shiftleft(cast(i as bigint), 32) | ((CASE WHEN i < 33 THEN fp & 4294967295 ELSE shiftrightunsigned(fp, 32) END) & ~(CASE WHEN i % 33 = 32 THEN 0L ELSE shiftleft(1L, i % 33) END))) AS key, fp AS fp)))"


def _bits(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


def _pairs(key: np.ndarray, fp: np.ndarray, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Verified links within runs of equal keys, each under its one key: that of the first segment if it
    differs by one bit at most, without the bit that differs."""
    left, right, lag, live = [], [], 1, np.flatnonzero(size - rank > 1)
    while len(live):
        a, b = fp[live], fp[live + lag]
        low, high = _bits((a ^ b) & _LOW), _bits((a ^ b) >> np.uint64(32))
        number = (key[live] >> 32).astype(np.int64)
        own = np.where(number < 33, low, np.where(low <= 1, 99, high))
        good = (low + high <= 2) & (own == np.where(number % 33 == 32, 0, 1))
        left.append(a[good])
        right.append(b[good])
        lag += 1
        live = live[size[live] - rank[live] > lag]
    return (np.concatenate(left), np.concatenate(right)) if left else (fp[:0], fp[:0])


def _regroup_masks(number: int) -> list[int]:
    """For a key number: what to keep of the bits so that members that agree are within two bits."""
    segment, bit = divmod(number, 33)
    own, other = 32 * segment, 32 * (1 - segment)
    taken = [((own + bit), (other + k)) for k in range(32)] if bit < 32 else [(other + j, other + k) for j, k in combinations(range(32), 2)]
    return [(2**64 - 1) & ~(1 << j) & ~(1 << k) for j, k in taken]


def _stars(number: int, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join what is within two bits among one key's fingerprints: a forest."""
    root = np.arange(len(fp))
    for mask in _regroup_masks(number):
        _, first, inverse = np.unique(fp & np.uint64(mask), return_index=True, return_inverse=True)
        if len(first) == len(fp):
            continue
        mine, theirs = root, root[first[inverse]]
        while (mine != theirs).any():  # hook the larger root of each pair to the smaller one, and shorten
            np.minimum.at(root, np.maximum(mine, theirs), np.minimum(mine, theirs))
            while (root != root[root]).any():
                root = root[root]
            mine, theirs = root, root[first[inverse]]
    moved = np.flatnonzero(root != np.arange(len(fp)))
    return fp[moved], fp[root[moved]]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) from rows (key, fp) in the order of keys; rows of runs too long to hold, with their key."""

    def out(u: np.ndarray, v: np.ndarray | None, key: np.ndarray | None = None) -> pa.RecordBatch:
        none = pa.nulls(len(u), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), none if v is None else pa.array(v.view(np.int64)), none if key is None else pa.array(key)], names=["u", "v", "key"])

    def settle(key: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sizes = np.diff(np.concatenate([first, [len(key)]]))
        size = np.repeat(sizes, sizes)
        rank = np.arange(len(key)) - np.repeat(first, sizes)
        few = np.flatnonzero((size > 1) & (size <= PAIRED))
        u, v = _pairs(key[few], fp[few], size[few], rank[few])
        yield out(u, v)
        for at in np.flatnonzero(sizes > PAIRED):
            u, v = _stars(int(key[first[at]] >> 32), fp[first[at] : first[at] + sizes[at]])
            yield out(u, v)

    key, fp, long_key = np.zeros(0, np.int64), np.zeros(0, np.uint64), None
    for batch in batches:
        key = np.concatenate([key, batch.column(0).to_numpy()])
        fp = np.concatenate([fp, batch.column(1).to_numpy().view(np.uint64)])
        last = int(np.searchsorted(key, key[-1])) if len(key) else 0  # the last key may go on in the next batch
        if last:
            if long_key is not None and key[0] == long_key:
                cut = int(np.searchsorted(key, long_key, "right"))
                yield out(fp[:cut], None, key[:cut])
                yield from settle(key[cut:last], fp[cut:last]) if cut < last else ()
            else:
                yield from settle(key[:last], fp[:last])
            key, fp, long_key = key[last:], fp[last:], None
        if len(key) > HELD:
            long_key = int(key[0])
            yield out(fp, None, key)
            key, fp = key[:0], fp[:0]
        elif long_key is not None and len(key) and key[0] == long_key:
            yield out(fp, None, key)
            key, fp = key[:0], fp[:0]
    if len(key):
        yield from [out(fp, None, key)] if long_key is not None and key[0] == long_key else settle(key, fp)


def _exchanged_stars(rows: DataFrame) -> DataFrame:
    """The star links of rows (u, key) whose runs are too long for a task."""
    masks = {n: _regroup_masks(n) for n in range(66)}
    signed = lambda m: m - 2**64 if m >= 2**63 else m
    table = F.create_map(*[x for n, ms in masks.items() for x in (F.lit(n), F.array(*[F.lit(signed(m)) for m in ms]))])
    spread = rows.select("u", "key", F.posexplode(table[F.shiftright("key", 32).cast("int")]).alias("k", "mask")).withColumn("rest", F.col("u").bitwiseAND(F.col("mask")))
    first = spread.groupBy("key", "k", "rest").agg(F.min("u").alias("v"))
    return spread.join(first, ["key", "k", "rest"]).select("u", "v")


def links(fps: DataFrame) -> DataFrame:
    """u, v: links that connect all fingerprints (column fp, distinct) within two bits of each other."""
    met = written(fps.selectExpr(_KEYS + " AS x").select("x.key", "x.fp").repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_meet, "u long, v long, key long"), "meetings")
    found = met.where("v IS NOT NULL").select("u", "v")
    long_runs = met.where("v IS NULL").select("u", "key")
    return found if long_runs.isEmpty() else found.unionByName(_exchanged_stars(long_runs))


def grouped(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, fp, more) with component_id."""
    groups = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least_id")), "distinct-fingerprints")
    joined = components(links(groups.select("fp")))
    rooted = groups.join(joined.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    return rows.join(rooted.join(names, "root").select("fp", "component_id", "root"), "fp")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits), component_id for each row of ``docs``.

    Rows are in one component if a chain of links (two or fewer differing bits) joins them;
    component_id is the smallest doc_id in it. Equal texts and all texts without words are linked like any
    others. Repeated doc_ids stay; a null doc_id is in a component but never its name, unless all are null.
    Other columns are ignored; an empty table gives no rows.
    """
    rows = written(fingerprints(docs), "fingerprints")
    return grouped(rows).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The row of the smallest doc_id of each component, with all columns as they are; of several rows
    of that id, the one whose text has the smallest digest."""
    rows = written(fingerprints(docs, keyed=True), "fingerprints")
    return without_copies(docs, written(grouped(rows), "near-groups"))


def without_copies(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The row of ``docs`` that each root of ``found`` (doc_id, key, root) keeps."""
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "key")
    stay = found.groupBy("root").agg(F.min(order).alias("s"), F.count("*").alias("n")).where("n > 1")
    met = written(found.join(stay, "root").select("doc_id", "key", "root", ((F.col("key") == F.col("s.key")) & F.col("doc_id").eqNullSafe(F.col("s.doc_id"))).alias("stays")), "near-met")
    repeated = met.where("stays").groupBy("root").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")).where("n > 1").select("doc_id")
    return without_rows(docs, text_key, written(met.where("not stays").select("doc_id", "key"), "near-dropped"), written(repeated, "near-repeated"))
