"""Byte-pair encoding and decoding from a tokenizer file, with an own merge loop.

A word is a doubly linked list of symbols (two arrays of neighbours). Adjacent pairs that have a merge
rank wait in a priority queue; the lowest rank, then the leftmost place, goes first. Merging leaves the
old neighbours' entries in the queue: an entry is stale, and skipped, when its symbols are no longer
those it was made for. A word of n symbols costs O(n log n), so one very long word is no trap.
Words repeat, so encoded words are kept in two bounded generations of a cache.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import unicodedata

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm._common import by_batch, text_or_empty

#: Words kept in each of the two generations of a worker's cache.
CACHE_WORDS = 200_000


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    printable = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = iter(range(256, 512))
    return [chr(b if b in printable else next(others)) for b in range(256)]


class WordBpe:
    """Encoder and decoder for a word-level BPE file: NFC, white space to one blank, lower case, split by
    the file's pattern, bytes as letters, merges within a word whose last symbol carries the suffix."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.strings = {i: s for s, i in self.vocab.items()}
        self.strings |= {t["id"]: t["content"] for t in spec["added_tokens"]}
        self.suffix = model["end_of_word_suffix"] or ""
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.ranks = {pair: i for i, pair in enumerate(pairs)}
        self.letters = byte_letters()
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.words = regex.compile(next(s["pattern"]["Regex"] for s in steps if s["type"] == "Split"))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.any_special = re.compile("|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.young: dict[str, tuple[str, str]] = {}
        self.old: dict[str, tuple[str, str]] = {}

    def merge(self, symbols: list[str]) -> list[str]:
        """The symbols after all merges, lowest rank first and leftmost first among equal ranks."""
        n = len(symbols)
        if n < 2:
            return symbols
        ranks, text = self.ranks, list(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(rank, i, text[i], text[i + 1]) for i in range(n - 1) if (rank := ranks.get((text[i], text[i + 1]))) is not None]
        heapq.heapify(queue)
        while queue:
            _, i, left, right = heapq.heappop(queue)
            j = after[i]
            if text[i] != left or j >= n or text[j] != right:
                continue  # stale: one of the two was merged since
            text[i], text[j] = left + right, ""
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (rank := ranks.get((text[i], text[k]))) is not None:
                    heapq.heappush(queue, (rank, i, text[i], text[k]))
            if (h := before[i]) >= 0 and (rank := ranks.get((text[h], text[i]))) is not None:
                heapq.heappush(queue, (rank, h, text[h], text[i]))
        return [s for s in text if s]

    def encode_word(self, word: str) -> list[int]:
        symbols = [self.letters[b] for b in word.encode("utf-8")]
        symbols[-1] += self.suffix
        return [self.vocab[s] for s in self.merge(symbols) if s in self.vocab]

    def _chunk(self, chunk: str) -> tuple[str, str]:
        """Ids, and vocabulary strings, of text without white space, each joined by one blank."""
        if (found := self.old.get(chunk)) is None:
            ids = [i for word in self.words.findall(chunk) for i in self.encode_word(word)]
            found = " ".join(map(str, ids)), " ".join(map(self.strings.__getitem__, ids))
        if len(self.young) >= CACHE_WORDS:
            self.old, self.young = self.young, {}
        if len(chunk) < 200:
            self.young[chunk] = found
        return found

    def _plain(self, text: str) -> list[tuple[str, str]]:
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # one letter at a time where a language rule of str.lower() would look at neighbours
        text = "".join(c.lower() for c in text) if "Σ" in text else text.lower()
        # str.split() also cuts at four control characters that the pattern keeps
        chunks = regex.split(r"\s+", text) if _CONTROLS.search(text) else text.split()
        out, young = [], self.young
        for chunk in chunks:
            if (found := young.get(chunk)) is None:
                found = self._chunk(chunk)
                young = self.young
            out.append(found)
        return out

    def encode_pairs(self, text: str) -> tuple[str, str]:
        """Decimal ids and vocabulary strings of a whole text, each joined by one blank."""
        if self.any_special is None or not self.any_special.search(text):
            parts = self._plain(text)
        else:
            parts, at = [], 0
            for m in self.any_special.finditer(text):
                parts += self._plain(text[at : m.start()])
                parts.append((str(self.special[m[0]]), m[0]))
                at = m.end()
            parts += self._plain(text[at:])
        return " ".join([p[0] for p in parts if p[0]]), " ".join([p[1] for p in parts if p[0]])

    def encode(self, text: str) -> list[int]:
        ids = self.encode_pairs(text)[0]
        return list(map(int, ids.split(" "))) if ids else []

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings one after the other, a blank between them, special ones included."""
        return " ".join(map(self.strings.__getitem__, ids))


_CONTROLS = re.compile("[\x1c-\x1f]")


@functools.lru_cache(maxsize=4)
def tokenizer(path: str) -> WordBpe:
    return WordBpe(path)


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (decimal, joined by one blank), decoded: one row for each row of ``docs``.

    Null and empty texts have no ids and decode to the empty string. Repeated rows and repeated or null
    doc_ids stay as they are. Other columns of ``docs`` are ignored, whatever their names.
    """

    def rows(batch: dict[str, list]) -> dict[str, list]:
        pairs = [tokenizer(path).encode_pairs(t) for t in batch["text"]]
        return {"doc_id": batch["doc_id"], "ids": [p[0] for p in pairs], "decoded": [p[1] for p in pairs]}

    return by_batch(docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")), "doc_id long, ids string, decoded string", rows)


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """As ``encode_documents``, with digests made where the ids are, so that ids don't travel:
    doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def rows(batch: dict[str, list]) -> dict[str, list]:
        pairs = [tokenizer(path).encode_pairs(t) for t in batch["text"]]
        return {
            "doc_id": batch["doc_id"],
            "n_tokens": [p[0].count(" ") + 1 if p[0] else 0 for p in pairs],
            "ids_sha256": [_sha(p[0]) for p in pairs],
            "decoded_sha256": [_sha(p[1]) for p in pairs],
        }

    return by_batch(docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text")), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", rows)
