"""Bytes of passages that occur elsewhere, by prefix-free parsing of the corpus.

Corpus parse. Rolling hashes of short grams are computed at each byte. A gram is a trigger where its
hash is the least among the grams of some ``span`` bytes, so every string of that length has one, and equal
strings have it at the same place. A trigger and all strings that it is least for make a phrase. Phrases
have two names: the rolling hash of the trigger gram, and a keyed cryptographic digest of the whole phrase, as
the dictionary of a prefix-free parse names its phrases.

 - A trigger gram seen once in the corpus: no string of its phrase occurs elsewhere.
 - A phrase seen twice: all its strings do.
 - Else, where a gram is in different phrases, their bytes are fetched and compared below. On plain text
   this is a small part, so that no byte of most documents ever leaves the task that reads it.

Suffix arrays. The distinct phrases that share grams meet in buckets. A bucket's text is parsed again with
dense triggers (hash divisible by 16) in overlapping pieces that end with a trigger, so no piece suffix
longer than the overlap is a prefix of another. The suffix array of the dictionary of distinct pieces ranks each
place within its piece; that of the parse ranks what follows; the two ranks together put all
places of the bucket in the order of their suffixes. Strings that occur twice are next to each other in that
order, and neighbours are compared byte by byte; their rolling hashes only spare comparisons of different ones.

A bucket is taken in lots of bounded size. A gram with more distinct phrases than ``HELD`` (a passage in very many documents,
everywhere with other neighbours) is first dealt anew: its strings are split by how far before the trigger
they start, and each part by the bytes that all of a part's strings cover. What then has equal bytes is settled; the
rest is split again where it is still too much, at last to single strings, so that no group outgrows a lot.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cairn.llm._common import lean, sieved, text_or_empty, trim, written

#: Bytes of text that are hashed at a time; longer texts are taken in pieces that overlap.
PIECE = 1 << 17
#: Bytes of phrases in a bucket, on average, and in a lot that suffix arrays order at once.
BUCKET_BYTES = 1 << 18
#: Distinct phrases of one trigger gram beyond which its strings are dealt anew.
HELD = 512
#: Bytes of phrases that one task compares, on average.
TASK_BYTES = 1 << 21

_U = np.uint64
_random = np.random.default_rng(200)
_VALUES = _random.integers(1, 1 << 63, (2, 256), dtype=_U)
_BASES = [int(x) | 1 for x in _random.integers(1, 1 << 63, 2, dtype=_U)]


def _powers(base: int, n: int) -> np.ndarray:
    return np.concatenate([np.ones(1, _U), np.cumprod(np.full(n - 1, base, _U), dtype=_U)])


class _Rolling:
    """Rolling hashes modulo 2**64 of any span of a text, from prefix sums of values times falling powers."""

    tables: dict = {}

    def __init__(self, data: np.ndarray, which: int):
        if len(self.tables.get(which, [()])[0]) < len(data):
            n, base = max(3 * PIECE, len(data)), _BASES[which]
            self.tables[which] = _powers(base, n), _powers(pow(base, -1, 2**64), n)
        self.up, down = self.tables[which]
        self.sums = np.concatenate([np.zeros(1, _U), np.cumsum(_VALUES[which][data] * down[: len(data)], dtype=_U)])

    def grams(self, size: int) -> np.ndarray:
        n = len(self.sums) - size
        return (self.sums[size:] - self.sums[:n]) * self.up[:n]



def mixed(h: np.ndarray, salt: int) -> np.ndarray:
    h = (h ^ _U(salt)) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def phrases(data: np.ndarray, ends: list[int], span: int, gram: int, salt: bytes = b"") -> dict[str, np.ndarray]:
    """first (place of the first string), cnt (strings), key (trigger gram), sup (digest of the phrase's bytes), at
    (trigger's place from first) of each phrase of the texts that end at ``ends`` of ``data``, in order."""
    n = len(data) - span + 1
    if n <= 0:
        return {k: np.zeros(0, np.int64) for k in ("first", "cnt", "key", "sup", "at")}
    grams = _Rolling(data, 0).grams(gram)
    places = _U((1 << 23) - 1)
    least = (mixed(grams, 1) & ~places) | np.arange(len(grams), dtype=_U)
    have, want = 1, span - gram + 1
    while have < want:
        step = min(have, want - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    trigger = (least & places).astype(np.int64)
    valid = np.ones(n + 1, bool)
    valid[n] = False
    start = 0
    for end in ends:
        valid[max(start, end - span + 1) : end] = False
        start = end
    moved = trigger[1:] != trigger[:-1]
    first = np.flatnonzero(valid[:n] & np.concatenate([[True], ~valid[: n - 1] | moved]))
    last = np.flatnonzero(valid[:n] & np.concatenate([moved | ~valid[1:n], [True]]))
    at = trigger[first]
    key = mixed(grams[at], 2)
    raw, named = memoryview(data), hashlib.blake2b
    digests = [named(raw[b:e], digest_size=8, key=salt).digest() for b, e in zip(first.tolist(), (last + span).tolist(), strict=True)]
    return {"first": first, "cnt": last - first + 1, "key": key.view(np.int64), "sup": np.frombuffer(b"".join(digests), np.int64), "at": at - first}


def _doc_key():
    """128 bits of a text's digest, as binary: equal texts lose the same bytes."""
    return F.substring(F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)), 1, 16)


def parse(docs: DataFrame, span: int, gram: int) -> DataFrame:
    """uid (row), doc (text key), first, cnt, at, key, sup: one row for each phrase of each document.

    Digests are keyed with random bytes of this call, so that no text can be made to fool them."""
    salt = os.urandom(16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids, keys = batch.column(0).to_numpy(), batch.column(1)
            held, size = [], 0

            def flush(held: list) -> pa.RecordBatch:
                ends = np.cumsum([len(b) for _, _, b in held])
                found = phrases(np.frombuffer(b"".join(b for _, _, b in held), np.uint8), ends.tolist(), span, gram, salt)
                of = np.searchsorted(ends, found["first"], "right")
                begin = np.array([b for _, b, _ in held]) - (ends - [len(b) for _, _, b in held])
                rows = np.array([r for r, _, _ in held])[of]
                columns = [pa.array(uids[rows]), keys.take(pa.array(rows)), pa.array(found["first"] + begin[of]), pa.array(found["cnt"].astype(np.int32)), pa.array(found["at"].astype(np.int32)), pa.array(found["key"]), pa.array(found["sup"])]
                return pa.RecordBatch.from_arrays(columns, names=["uid", "doc", "first", "cnt", "at", "key", "sup"])

            for row in range(batch.num_rows):
                text = batch.column(2)[row].as_py().encode("utf-8")
                if len(text) < span:
                    continue
                for begin in range(0, len(text) - span + 1, PIECE):
                    held.append((row, begin, text[begin : begin + PIECE + span - 1]))
                    size += len(held[-1][2])
                    if size >= PIECE:
                        yield flush(held)
                        held, size = [], 0
            if held:
                yield flush(held)

    rows = docs.select(F.monotonically_increasing_id().alias("uid"), _doc_key().alias("doc"), "text")
    return rows.mapInArrow(lean(run), "uid long, doc binary, first long, cnt int, at int, key long, sup long")


def _ranks(symbols: np.ndarray, ends: np.ndarray, packed: int = 1) -> np.ndarray:
    """The rank of each suffix (up to its own end) among all, equal ones sharing it: prefix doubling.

    symbols: from 1; ends: for each place, where its string ends. Symbols up to 511 may be taken seven at a time."""
    place, step = np.arange(len(symbols)), packed
    first = symbols
    for k in range(1, packed):
        first = (first << 9) | np.where(place + k < ends, symbols[np.minimum(place + k, len(symbols) - 1)], 0)
    values, rank = np.unique(first, return_inverse=True)
    rank = rank.astype(np.int64) + 1
    while len(values) < len(rank):
        follow = place + step
        then = np.where(follow < ends, rank[np.minimum(follow, len(rank) - 1)], 0)
        values, inverse = np.unique(rank * (len(rank) + 1) + then, return_inverse=True)
        grown = len(values) > rank.max()
        rank, step = inverse.astype(np.int64) + 1, step * 2
        # classes that a doubling doesn't split are final: what agrees in k places then agrees in 2k, and so on
        if not grown:
            break
    return rank


def _same_bytes(data: np.ndarray, one: np.ndarray, two: np.ndarray, span: int) -> np.ndarray:
    """Whether the strings of ``span`` bytes at places ``one`` and ``two`` are equal, pair by pair."""
    window = np.lib.stride_tricks.sliding_window_view(data, span)
    return np.concatenate([np.zeros(0, bool), *((window[one[k : k + 2048]] == window[two[k : k + 2048]]).all(axis=1) for k in range(0, len(one), 2048))])


def repeated(segments: list[bytes], span: int, overlap: int = 8, density: int = 16) -> list[np.ndarray]:
    """For each segment, which of its strings of ``span`` bytes are also in another place of any segment."""
    data = np.frombuffer(b"".join(segments), np.uint8)
    sizes = np.array([len(s) for s in segments])
    ends = np.cumsum(sizes)
    begins = ends - sizes
    segment_end = np.repeat(ends, sizes)
    # pieces: from a trigger, or the segment's start, to the end of the next trigger's gram
    starts = np.zeros(len(data), bool)
    starts[begins] = True
    rolling = _Rolling(data, 0)
    if len(data) > overlap:
        hit = np.flatnonzero(mixed(rolling.grams(overlap), 4) % _U(density) == 0)
        starts[hit[hit + overlap < segment_end[hit]]] = True
    begin = np.flatnonzero(starts)
    stop = np.minimum(np.concatenate([begin[1:] + overlap, [len(data)]]), segment_end[begin])
    piece = np.cumsum(starts) - 1
    # dictionary of distinct pieces, in any order, and the parse that names them
    number: dict[bytes, int] = {}
    raw = data.tobytes()
    parsed = np.array([number.setdefault(raw[b:e], len(number)) for b, e in zip(begin.tolist(), stop.tolist(), strict=True)])
    words = list(number)
    word_size = np.array([len(w) for w in words])
    word_end = np.cumsum(word_size)
    word_begin = word_end - word_size
    in_word = _ranks(np.frombuffer(b"".join(words), np.uint8).astype(np.int64) + 1, np.repeat(word_end, word_size), packed=7)
    # a piece's rank in the parse's alphabet is that of its whole word among the dictionary's suffixes
    last = np.searchsorted(begin, segment_end[begin])
    following = np.concatenate([_ranks(in_word[word_begin[parsed]], last), [0]])
    # corpus order of the places where a string of span bytes starts
    at = np.flatnonzero(np.arange(len(data)) + span <= segment_end)
    own = piece[at]
    first = in_word[word_begin[parsed[own]] + at - begin[own]]
    then = np.where(own + 1 < last[own], following[own + 1], 0)
    at = at[np.argsort(first * (len(begin) + 2) + then, kind="stable")]
    twice = np.zeros(len(data), bool)
    if len(at) > 1:
        hashes = rolling.grams(span)[at]
        pair = np.flatnonzero(hashes[1:] == hashes[:-1])  # unequal hashes are unequal strings
        pair = pair[_same_bytes(data, at[pair], at[pair + 1], span)]
        twice[at[pair]] = twice[at[pair + 1]] = True
    return [twice[b : max(b, e - span + 1)] for b, e in zip(begins.tolist(), ends.tolist(), strict=True)]


def _compared(segments: DataFrame, span: int) -> DataFrame:
    """key, sup, frm, cnt, mask (a bit for each string that is elsewhere too) of segments.

    Equal strings are in one grp, so a bucket is taken in lots of whole ones. Segments that are in the corpus twice
    themselves only take part for the others' sake."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("grp")
        groups, data = group.column("grp").to_pylist(), group.column("bytes").to_pylist()
        masks: list[np.ndarray] = []
        begin = 0
        while begin < len(groups):
            end, size = begin, 0
            while end < len(groups):
                after = end
                while after < len(groups) and groups[after] == groups[end]:
                    size += len(data[after])
                    after += 1
                if size > BUCKET_BYTES and end > begin:
                    break
                end = after
            masks += repeated(data[begin:end], span)
            begin = end
        packed = [np.packbits(m, bitorder="little").tobytes() if m.any() else None for m in masks]
        columns = {k: group.column(k) for k in ("key", "sup", "frm")} | {"cnt": pa.array([len(m) for m in masks], pa.int32()), "mask": pa.array(packed, pa.binary())}
        trim()
        return pa.table(columns).filter(pa.array([m is not None and n == 1 for m, n in zip(packed, group.column("n").to_pylist(), strict=True)], pa.bool_()))

    total = segments.agg(F.sum(F.length("bytes"))).first()[0] or 0
    buckets = max(1, -(-total // BUCKET_BYTES))
    dealt = segments.select("grp", "key", "sup", "frm", "n", "bytes", F.pmod(F.xxhash64("grp"), F.lit(buckets)).alias("bucket"))
    dealt = dealt.repartition(max(1, -(-total // TASK_BYTES)), "bucket")
    return dealt.groupBy("bucket").applyInArrow(run, "key long, sup long, frm int, cnt int, mask binary")


#: Columns of a segment: grp (equal strings share it), low and high (how far before its trigger its strings start), key
#: and sup (its phrase), at (the trigger's place in the bytes), frm (its first string's number in the phrase), n, bytes.
_SEGMENT = ("grp", "low", "high", "key", "sup", "at", "frm", "n", "bytes")


def _split(hot: DataFrame, span: int, ways: int = 4) -> DataFrame:
    """Segments dealt anew: each one's strings in up to ``ways`` ranges of how far before the trigger they start.

    The bytes that all strings of a range cover, and the range, make the new grp, so equal strings stay together."""
    wide = F.greatest(F.lit(1), F.expr(f"cast(ceil((high - low + 1) / {ways}) as int)"))
    ranges = F.transform(F.sequence(F.col("low"), F.col("high"), wide), lambda a: F.struct(a.alias("a"), F.least(a + wide - 1, F.col("high")).alias("z")))
    rows = hot.withColumn("r", F.explode(ranges)).withColumn("strings", F.length("bytes") - (span - 1))
    # string o of a segment starts at - o before the trigger
    rows = rows.withColumn("first", F.greatest(F.lit(0), F.col("at") - F.col("r.z"))).withColumn("last", F.least(F.col("strings") - 1, F.col("at") - F.col("r.a"))).where("first <= last")
    own = F.expr(f"substring(bytes, first + 1, last - first + {span})")
    shared = F.expr(f"substring(bytes, at - r.a + 1, {span} - r.z + r.a)")
    return rows.select(F.xxhash64("grp", "r.a", shared).alias("grp"), F.col("r.a").alias("low"), F.col("r.z").alias("high"), "key", "sup", (F.col("at") - F.col("first")).alias("at"), (F.col("frm") + F.col("first")).alias("frm"), "n", own.alias("bytes"))


def _by_range(hot: DataFrame, span: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Of segments of crowded groups: those that may now be compared, and key, sup, frm, cnt of those settled
    by equal bytes."""
    few, settled = [], []
    while not hot.isEmpty():
        dealt = written(_split(hot, span), "split-segments")
        # one segment of each kind goes on, since others may hold some of its strings
        kinds = written(dealt.groupBy("grp", "low", "high", "bytes", "at").agg(F.sum("n").alias("n"), F.min(F.struct("key", "sup", "frm")).alias("s")), "segment-kinds")
        twice = kinds.where("n > 1").select("grp", "bytes")
        settled.append(dealt.join(twice, ["grp", "bytes"], "left_semi").select("key", "sup", "frm", (F.length("bytes") - (span - 1)).alias("cnt")))
        # written, so that the join reads both sides from plain exchanges and a crowded group can be split
        sizes = written(kinds.groupBy("grp").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 AND least = 1"), "segment-groups")
        open_ = written(kinds.join(sizes, "grp").select("grp", "low", "high", "s.key", "s.sup", "at", "s.frm", "n", "bytes", "kinds"), "open-segments")
        few.append(open_.where(F.col("kinds") <= HELD).select(*_SEGMENT))
        hot = open_.where(F.col("kinds") > HELD).select(*_SEGMENT)
    return few, settled


def repeats(docs: DataFrame, span: int = 200, gram: int = 64) -> DataFrame:
    """doc (text key), places (first, cnt, mask): runs of strings of each text that occur elsewhere.

    Only texts that have some; a mask of null says all of the run's strings. Equal texts share a row."""
    parsed = written(parse(docs, span, gram), "corpus-parse")
    # written, so that the join reads both sides from plain exchanges and a frequent gram can be split
    grams = written(parsed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "grams")
    shared = written(parsed.drop("doc").join(grams, "key"), "shared-grams")

    by_phrase = written(shared.groupBy("key", "sup").agg(F.count("*").alias("n"), F.min(F.struct("uid", "first", "cnt", "at")).alias("rep")), "distinct-phrases")
    by_gram = written(by_phrase.groupBy("key").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).where("kinds > 1 AND least = 1"), "unsure-grams")
    unsure = by_phrase.join(by_gram, "key").select("key", "sup", "n", "kinds", "rep.*")
    owners = parsed.select("uid", "doc").distinct()
    wanted = written(unsure.join(owners, "uid"), "unsure-phrases")

    keyed = docs.withColumn("doc", _doc_key())
    # of equal texts any one will do; they are combined before the exchange
    texts = sieved(keyed, "doc", wanted).groupBy("doc").agg(F.first("text").alias("text"))
    texts = texts.join(wanted.groupBy("doc").agg(F.collect_list(F.struct("key", "sup", "n", "kinds", "first", "cnt", "at")).alias("wanted")), "doc")
    bytes_ = F.expr(f"substring(data, cast(w.first + 1 as int), w.cnt + {span - 1})")
    segments = texts.select(F.encode("text", "UTF-8").alias("data"), F.explode("wanted").alias("w"))
    segments = segments.select(F.col("w.key").alias("grp"), F.lit(0).alias("low"), F.lit(span - gram).alias("high"), "w.key", "w.sup", "w.at", F.lit(0).alias("frm"), "w.n", bytes_.alias("bytes"), "w.kinds")
    segments = written(segments, "segments")
    few, settled = _by_range(segments.where(F.col("kinds") > HELD).select(*_SEGMENT), span)
    whole = [by_phrase.where("n > 1").select("key", "sup", F.lit(0).alias("frm"), F.col("rep.cnt").alias("cnt")), *settled]
    masks = _compared(reduce(DataFrame.unionByName, few, segments.where(F.col("kinds") <= HELD).select(*_SEGMENT)), span)
    known = written(masks.unionByName(reduce(DataFrame.unionByName, whole).withColumn("mask", F.lit(None).cast("binary"))), "known-phrases")

    places = shared.join(known.withColumnRenamed("cnt", "run"), ["key", "sup"]).join(owners, "uid")
    places = places.groupBy("doc", (F.col("first") + F.col("frm")).alias("first"), "run").agg(F.first("mask").alias("mask"))
    return places.groupBy("doc").agg(F.collect_list(F.struct("first", F.col("run").alias("cnt"), "mask")).alias("places"))


def covered(n: int, places: list[dict] | None, span: int) -> list[tuple[int, int]]:
    """The maximal runs of removed bytes (from, to) in a text of n bytes."""
    marks = np.zeros(n + 1, np.int32)
    for p in places or []:
        first, cnt, mask = p["first"], p["cnt"], p["mask"]
        if mask is None:
            marks[first] += 1
            marks[first + cnt + span - 1] -= 1
        else:
            k = first + np.flatnonzero(np.unpackbits(np.frombuffer(mask, np.uint8), bitorder="little")[:cnt])
            np.add.at(marks, k, 1)
            np.add.at(marks, k + span, -1)
    gone = np.concatenate([[False], np.cumsum(marks)[:n] > 0, [False]])
    edges = np.flatnonzero(gone[1:] != gone[:-1])
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def with_places(docs: DataFrame, span: int, gram: int) -> tuple[DataFrame, DataFrame]:
    """Two tables of row (all columns of ``docs``), text (null as empty), places (see ``repeats``): the rows
    that may have places, null where they don't, and those that surely have none."""
    docs = docs.select(F.struct("*").alias("row"), text_or_empty().alias("text"))
    found = written(repeats(docs, span, gram), "repeats")
    docs = docs.withColumn("doc", _doc_key())
    touched = sieved(docs, "doc", found).join(found, "doc", "left").select("row", "text", "places")
    clear = sieved(docs, "doc", found, inverse=True)
    return touched, clear.select("row", "text", F.lit(None).cast(found.schema["places"].dataType).alias("places"))


def removal_digests(docs: DataFrame, span: int = 200, gram: int = 64) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of ``docs``.

    A byte is removed if a string of ``span`` bytes that covers it also starts anywhere else, in this or
    another row. Copies of a text lose all of it if it has ``span`` bytes; shorter texts lose none. Null texts
    are empty; repeated and null doc_ids are separate rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, places in zip(batch.column(1), batch.column(2), strict=True):
                data, digest, at = text.as_py().encode("utf-8"), hashlib.sha256(), 0
                spans = covered(len(data), places.as_py(), span) if places.is_valid else []
                for low, high in spans:
                    digest.update(data[at:low])
                    at = high
                digest.update(data[at:])
                out.append((len(data), sum(h - w for w, h in spans), len(spans), digest.hexdigest()))
            columns = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    touched, clear = with_places(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), span, gram)
    return touched.unionByName(clear).select("row.doc_id", "text", "places").mapInArrow(lean(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, span: int = 200, gram: int = 64) -> DataFrame:
    """``docs`` with the removed bytes cut from text and n_chars made to fit; characters cut in two go.

    Rows stay, also those left with an empty text; other columns stay as they are."""
    columns = docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part, texts = batch.slice(at, 256), []
                for text, places in zip(part.column(1), part.column(2), strict=True):
                    data, low_end, kept = text.as_py().encode("utf-8"), 0, []
                    for low, high in covered(len(data), places.as_py(), span):
                        kept.append(data[low_end:low].decode("utf-8", "ignore"))
                        low_end = high
                    texts.append("".join([*kept, data[low_end:].decode("utf-8", "ignore")]))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["row", "text"])

    touched, clear = with_places(docs, span, gram)
    touched = touched.withColumn("row", F.col("row").dropFields("text"))
    touched = touched.mapInArrow(lean(cut), StructType([touched.schema["row"], StructField("text", StringType())]))
    rows = touched.unionByName(clear.select(F.col("row").dropFields("text").alias("row"), "text"))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return rows.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in columns])
