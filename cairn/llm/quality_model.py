"""A quality classifier without labels: heuristic labellers, their estimated accuracies, a hashed scorer.

Several heuristics overlap: each votes good, bad or nothing on a document. Votes are counted by pattern, over all
documents, so expectation-maximisation runs on a small table (at most 3 to the power of the
labellers) yet is exact for the corpus: it finds how often good documents are and how each labeller votes on
good and on bad ones, given the class independently of the others. The posterior of a document's pattern is its weak label.

Posteriors then train a linear scorer on hashed features of the text (byte trigrams, pairs of character kinds,
repetition, lines), so that documents on which no labeller votes are scored too, and a
labeller's mistake is outvoted by what the text looks like. The scorer is trained on ``TRAINED`` documents of
either kind at most, in the order of their hashes: the one bounded sample; all else covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from cairn.llm._common import text_or_empty, written

#: Weakly good and weakly bad documents at most that train the scorer.
TRAINED = 1500
#: Hashed features.
WIDTH = 4096
#: Probability of being good below which a document is rejected.
REJECT = 0.4

_KIND = np.full(256, 6, np.uint8)  # other ASCII marks
_KIND[[ord(c) for c in " \t\r\x0b\f"]] = 0
_KIND[ord("\n")] = 1
_KIND[48:58] = 2
_KIND[65:91] = 3
_KIND[97:123] = 4
_KIND[128:] = 5
_KIND[[ord(c) for c in ".,;:'\"-()"]] = 7
_KIND[[ord(c) for c in "!?"]] = 8
_KIND[[ord(c) for c in "#*$%&|<>"]] = 9
_SALT = np.random.default_rng(44).integers(1, 1 << 62, 256, dtype=np.uint64)


def measures(text: str) -> dict[str, float]:
    """What labellers and scorer look at, beside the bytes: shares of words, letters and lines."""
    words = text.split()
    n = len(words)
    lines = [x for x in text.split("\n") if x and not x.isspace()]
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    kinds = np.bincount(_KIND[data], minlength=10) if len(data) else np.zeros(10, np.int64)
    letters = max(1, int(kinds[3] + kinds[4] + kinds[5]))
    fours = list(zip(words, words[1:], words[2:], words[3:], strict=False))
    again = sum(map(eq, words, words[1:]))
    return {
        "n_words": n,
        "symbols": float(kinds[9]) / max(1, n),
        "shouts": float(kinds[8]) / max(1, n),
        "capitals": float(kinds[3]) / letters,
        "again": again / max(1, n - 1),
        "repeats": 1 - len(set(fours)) / len(fours) if fours else 0.0,
        "same_lines": 1 - len(set(lines)) / len(lines) if lines else 0.0,
        "plain_words": (n - sum(not w[:-1].isalpha() for w in words if not w.isalpha())) / max(1, n),
        "letters": letters / max(1, int(kinds[2:].sum())),
        "points": float(kinds[7]) / max(1, n),
        "distinct": len(set(words)) / max(1, n),
    }


#: name, votes bad when, has enough to judge when: a labeller that has votes good if it doesn't vote bad.
LABELLERS = (
    ("symbols", lambda m: m["symbols"] > 0.2, lambda m: m["n_words"] >= 5),
    ("plain_words", lambda m: m["plain_words"] < 0.6, lambda m: m["n_words"] >= 12),
    ("letters", lambda m: m["letters"] < 0.8, lambda m: m["n_words"] >= 20),
    ("shouts", lambda m: m["shouts"] > 0.4, lambda m: m["n_words"] >= 5),
    ("capitals", lambda m: m["capitals"] > 0.5, lambda m: m["n_words"] >= 5),
    ("again", lambda m: m["again"] > 0.3, lambda m: m["n_words"] >= 10),
    ("repeats", lambda m: m["repeats"] > 0.4, lambda m: m["n_words"] >= 24),
    ("same_lines", lambda m: m["same_lines"] > 0.45, lambda m: m["n_words"] >= 40),
    ("vocabulary", lambda m: m["distinct"] < 0.15, lambda m: m["n_words"] >= 50),
)


def votes(m: dict[str, float]) -> str:
    """One letter for each labeller: b bad, g good, - nothing."""
    return "".join("-" if not enough(m) else "b" if bad(m) else "g" for _, bad, enough in LABELLERS)


def expectation_maximisation(patterns: dict[str, int], rounds: int = 100) -> tuple[float, np.ndarray, dict[str, float]]:
    """Share of good documents, each labeller's chance to vote bad on (bad, good) ones, posteriors by pattern.

    A labeller that doesn't vote says nothing. The start, that bad votes are rare on good documents and that no
    labeller knows all kinds of bad ones, also says which class is which."""
    if not patterns:
        return 0.85, np.zeros((2, 0)), {}
    keys = sorted(patterns)
    count = np.array([patterns[k] for k in keys], float)
    bad = np.array([[v == "b" for v in k] for k in keys], float).reshape(len(keys), -1)
    cast = np.array([[v != "-" for v in k] for k in keys], float).reshape(len(keys), -1)
    good, chance = 0.85, np.stack([np.full(bad.shape[1], 0.3), np.full(bad.shape[1], 0.005)])
    posterior = np.zeros(len(keys))
    for _ in range(rounds):
        logs = [np.log(p) + bad @ np.log(c) + (cast - bad) @ np.log(1 - c) for p, c in zip((1 - good, good), chance, strict=True)]
        posterior = 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
        good = min(max(float(count @ posterior) / max(count.sum(), 1.0), 1e-6), 1 - 1e-6)
        for c, weight in enumerate((count * (1 - posterior), count * posterior)):
            chance[c] = np.clip((weight @ bad + 0.01) / (weight @ cast + 0.1), 1e-6, 1 - 1e-6)
    return good, chance, dict(zip(keys, posterior.tolist(), strict=True))


def features(text: str, m: dict[str, float]) -> np.ndarray:
    """Roots of the shares of hashed byte trigrams, of pairs of kinds, and of the measures, in WIDTH places."""
    out = np.zeros(WIDTH)
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    if len(data) >= 3:
        low = data | ((data >= 65) & (data <= 90)) * np.uint8(32)
        h = (low[:-2].astype(np.uint32) * np.uint32(0x9E3779B1) + low[1:-1].astype(np.uint32) * np.uint32(0x85EBCA6B) + low[2:].astype(np.uint32) * np.uint32(0xC2B2AE35)) >> np.uint32(21)
        out[:2048] = np.bincount(h, minlength=2048) * (0.25 / len(h))
        kinds = _KIND[data].astype(np.uint32)
        pairs = ((kinds[:-1] * 16 + kinds[1:]) * np.uint32(0x9E3779B1)) >> np.uint32(22)
        out[2048:3072] = np.bincount(pairs, minlength=1024) / len(pairs)
    for k, name in enumerate(("symbols", "shouts", "capitals", "again", "repeats", "same_lines", "points", "distinct", "plain_words", "letters")):
        level = min(9, int(10 * min(1.0, m[name])))
        out[3072 + int(_SALT[k * 16 + level] % 1024)] += 0.3
    return np.sqrt(out)


def train(x: np.ndarray, p: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Weights, the last one a bias, of a logistic model of soft labels; both classes weigh alike."""
    x = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    weight = np.where(p > 0.5, 0.5 / max(1, (p > 0.5).sum()), 0.5 / max(1, (p <= 0.5).sum())).astype(np.float32)
    p, w, step, speed = p.astype(np.float32), np.zeros(x.shape[1], np.float32), np.float32(2.0), np.zeros(x.shape[1], np.float32)
    for _ in range(rounds):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        speed = np.float32(0.9) * speed - step * ((weight * (q - p)) @ x + np.float32(1e-5) * w)
        w = w + speed
    return w.astype(np.float64)


def _voted(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([votes(measures(t)) for t in batch.column(1).to_pylist()], pa.string())], names=["h", "votes"])

    return docs.select(F.xxhash64("text").alias("h"), "text").mapInArrow(run, "h long, votes string")


def fit(docs: DataFrame) -> np.ndarray | None:
    """The scorer's weights, learned from the texts of ``docs`` alone; None for an empty table."""
    docs = docs.select(text_or_empty().alias("text"))
    voted = written(_voted(docs).groupBy("h", "votes").agg(F.count("*").alias("n")), "votes")
    patterns = {r.votes: r.n for r in voted.groupBy("votes").agg(F.sum("n").alias("n")).collect()}
    if not patterns:
        return None
    _, _, posterior = expectation_maximisation(patterns)
    sets = [[k for k, p in posterior.items() if (p > 0.5) == good and abs(p - 0.5) > 0.2] for good in (True, False)]
    picked = [voted.where(F.col("votes").isin(keys)).orderBy(F.xxhash64("h"), "h").limit(TRAINED) for keys in sets]
    chosen = written(picked[0].unionByName(picked[1]).select("h", "votes").distinct(), "training-keys")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, vote in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = features(text, measures(text)).astype(np.float16).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([posterior[vote]]), pa.array([x], pa.binary())], names=["p", "x"])

    # 2 * TRAINED keys of 8 bytes at most, whatever the corpus
    texts = docs.withColumn("h", F.xxhash64("text")).join(F.broadcast(chosen), "h").groupBy("h").agg(F.first("text").alias("text"), F.first("votes").alias("votes"))
    rows = sorted((r.p, bytes(r.x)) for r in texts.select("text", "votes").mapInArrow(run, "p double, x binary").collect())
    x = np.stack([np.frombuffer(b, np.float16) for _, b in rows]).astype(np.float32) if rows else np.zeros((0, WIDTH), np.float32)
    return train(x, np.array([p for p, _ in rows]))


def scored(docs: DataFrame, weights: np.ndarray | None) -> DataFrame:
    """row (all columns of ``docs``) and score, the probability of being good."""
    sent = docs.sparkSession.sparkContext.broadcast(weights)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                row = batch.column(0).slice(at, 1024)
                found = []
                for text in row.field(place).to_pylist():
                    x = features(text or "", measures(text or ""))
                    found.append(float(1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))))
                yield pa.RecordBatch.from_arrays([row, pa.array(found, pa.float64())], names=["row", "score"])

    rows = docs.select(F.struct("*").alias("row"))
    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("score", DoubleType())]))


def quality(docs: DataFrame, reject: float = REJECT) -> DataFrame:
    """doc_id, score (probability of being good), kept for each row of ``docs``.

    No labels are read. Null texts are empty; a text without words gets the score its features give.
    Repeated and null ids stay, equal texts get equal scores; other columns are ignored."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return scored(rows, fit(docs)).select("row.doc_id", "score", (F.col("score") >= reject).alias("kept"))


def without_rejected(docs: DataFrame, reject: float = REJECT) -> DataFrame:
    """The rows of ``docs`` that are kept, with all columns as they are."""
    kept = scored(docs, fit(docs)).where(F.col("score") >= reject)
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
