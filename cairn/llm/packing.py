"""Cost-balanced packing of tokenised documents into sequences of bounded length.

A document of n tokens costs n + n * n / length: linear layers plus attention. Documents are cut into
whole sequences as long as they fill one; what is left of each, shorter than a sequence, is packed in buckets
of a bounded number of documents, dealt by row number, so that neither a long document nor many copies
load one task. A bucket has just as many sequences as its tokens fill, and its last tokens get sequences of
lengths that are powers of two, which need no padding. Within a bucket the documents are taken by falling
length, and each goes to the sequence of lowest cost among those that have room for all of it. Where none
has, the document is cut: it fills the sequence of lowest cost that has any room, and the rest goes on.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cairn.llm._common import lean, text_or_empty, trim
from cairn.llm.bpe import byte_letters

#: Documents whose remainders are packed together: at most this many times the sequence length in tokens.
BUCKET_DOCUMENTS = 4096
#: Characters whose classes no Unicode version disputes, as ranges for a pattern; of these, letters, digits and white space.
_SETTLED_CHARS = [*range(0x250), *range(0x2000, 0x2065)]
_SPACES = "\t-\r \x85\xa0\u2000-\u200a\u2028\u2029\u202f\u205f"
_LETTERS, _DIGITS = ("".join(f"\\u{c:04x}" for c in _SETTLED_CHARS if unicodedata.category(chr(c))[0] == kind) for kind in "LN")
_SETTLED = re.compile("[\x00-\u024f\u2000-\u2064]*")
#: Fixed value: how byte-level vocabularies of this family split a text into words, each encoded by itself.
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_DIGITS}]+| ?[^{_SPACES}{_LETTERS}{_DIGITS}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"
#: Words whose ids are kept in each of two generations of a worker's cache, and their longest.
KEPT, LONGEST = 250_000, 48
WIDE = np.dtype("<u4")


class _Words(dict):
    """Words' ids as bytes, by the library's model where they are first met; those met lately are kept."""

    def __init__(self, model):
        super().__init__()
        self.tokenize, self.old, self.letters = model.tokenize, {}, dict(enumerate(byte_letters()))

    def __missing__(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            pieces = self.tokenize(word.encode("utf-8").decode("latin-1").translate(self.letters))
            found = array("I", [t.id for t in pieces]).tobytes()
        if len(word) <= LONGEST:
            if len(self) >= KEPT:
                self.old = dict(self)
                self.clear()
            self[word] = found
        return found


class ByteTokenizer:
    """The ids of a byte-level tokenizer file. They all come from the library: from its model word by word, kept between
    texts, where its split of the text is sure (no special token, no disputed letters), else of the whole text."""

    def __init__(self, path: str):
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.plain = spec["normalizer"] is None and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self.words, self.split = _Words(self.library.model), re.compile(WORDS).findall

    def ids(self, text: str) -> np.ndarray:
        if self.plain and _SETTLED.fullmatch(text) and not any(t in text for t in self.special):
            return np.frombuffer(b"".join(map(self.words.__getitem__, self.split(text))), WIDE)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, WIDE)


@functools.lru_cache(maxsize=4)
def tokenizer(path: str) -> ByteTokenizer:
    return ByteTokenizer(path)


def sequence_lengths(tokens: int, length: int) -> list[int]:
    """The whole sequences that these tokens fill, and powers of two for the rest."""
    whole, rest = divmod(tokens, length)
    return [length] * whole + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def assign(lengths: list[int], rooms: list[int], length: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; the documents fill the rooms exactly."""
    room, cost, used, pieces = np.array(rooms, np.int64), np.zeros(len(rooms)), np.zeros(len(rooms), np.int64), []
    for d in sorted(range(len(lengths)), key=lambda d: (-lengths[d], d)):
        start = 0
        while (rest := lengths[d] - start) > 0:
            if not (fits := room >= rest).any():
                fits = room > 0
            s = int(np.where(fits, cost, np.inf).argmin())
            took = min(rest, int(room[s]))
            pieces.append((d, start, took, s, int(used[s])))
            room[s] -= took
            used[s] += took
            cost[s] += took + took * took / length
            start += took
    return pieces


def pack_documents(docs: DataFrame, path: str, length: int = 2048, end_id: int = 1) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are its text's, without special tokens, and ``end_id``; a null text is an empty one,
    so has that one id. Each id is in one piece. Repeated rows and repeated or null doc_ids
    are packed as separate documents. Other columns are ignored. An empty table gives no rows.
    """
    buckets = max(1, -(-docs.count() // BUCKET_DOCUMENTS))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), F.monotonically_increasing_id().alias("row"))
    wide = WIDE

    def tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).ids
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                whole, rest, counts = [], [], []
                for text in part.column(1).to_pylist():
                    ids = np.append(encode(text), wide.type(end_id))
                    full = len(ids) // length
                    whole.append(np.array([zlib.crc32(ids[k * length : (k + 1) * length]) for k in range(full)], wide).tobytes())
                    tail = ids[full * length :]
                    rest.append(tail.astype("<u2").tobytes() if len(tail) == 0 or tail.max() < 65536 else b"\0" + tail.tobytes())
                    counts.append(len(ids))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(counts, pa.int64()), pa.array(whole, pa.binary()), pa.array(rest, pa.binary())], names=["doc_id", "row", "doc_tokens", "whole", "rest"])

    def packed(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by("row")
        tails = [np.frombuffer(b[1:], wide) if len(b) % 2 else np.frombuffer(b, "<u2").astype(wide) for b in group.column("rest").to_pylist()]
        counts = group.column("doc_tokens").to_pylist()
        out, following = [], int(key[0].as_py()) << 32
        for d, crcs in enumerate(group.column("whole").to_pylist()):
            for k, crc in enumerate(np.frombuffer(crcs, wide).tolist()):
                out.append((d, k * length, length, crc, following, 0))
                following += 1
        sizes = [len(t) for t in tails]
        for d, start, took, s, offset in assign(sizes, sequence_lengths(sum(sizes), length), length):
            out.append((d, counts[d] - sizes[d] + start, took, zlib.crc32(tails[d][start : start + took].tobytes()), following + s, offset))
        of = np.array(out, np.int64).reshape(-1, 6)
        trim()
        columns = {"start": of[:, 1], "length": of[:, 2], "ids_crc32": of[:, 3], "doc_tokens": np.array(counts, np.int64)[of[:, 0]], "sequence_id": of[:, 4], "offset": of[:, 5]}
        return pa.table({"doc_id": group.column("doc_id").take(pa.array(of[:, 0]))} | {k: pa.array(v) for k, v in columns.items()})

    tokens = rows.mapInArrow(lean(tokenised), "doc_id long, row long, doc_tokens long, whole binary, rest binary")
    dealt = tokens.withColumn("bucket", F.pmod(F.xxhash64("row"), F.lit(buckets)).cast("int"))
    # a task for each bucket, so that tasks stay alike however large the table is
    return dealt.repartitionById(buckets, F.col("bucket")).groupBy("bucket").applyInArrow(packed, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
