"""Toxicity by a support vector machine over a subsequence string kernel with Nyström landmarks.

The kernel of two strings sums, over all subsequences of three characters that they share, a decay to the
power of the stretch each takes up in either string. So an insult with inserted or spaced-out characters
still shares most of its subsequences with the plain one, at the price of their gaps. Between a
sentence and a landmark the kernel is the largest over the sentence's words (single letters in a row
count as one word too), as a share of the landmark's own.

Landmarks are learned: pieces of words that tell toxic from other labelled documents apart, chosen one by
one so that each adds documents that none before has. The Nyström map turns kernels with the
landmarks into features in which a linear machine is one of the kernel; it is trained on sentences: all
of documents labelled clean, and of each toxic document the one that looks worst, chosen anew each round. A
document scores as its worst sentence, made a probability by a logistic fit on the training rows.

The machine is fitted on ``TRAINED`` labelled documents of each label at most, in the order of their ids' hashes;
what is gathered to the driver is bounded by that, ``WORDS``, ``PIECES`` and ``LANDMARKS``. A kernel is only worked out where the longest common subsequence (by bit vectors, for many
words at a time) covers 85 % of the landmark, and kept by word.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.llm._common import text_or_empty, written

#: Words with the most toxic, and with the most other, documents whose counts are gathered to choose landmarks.
WORDS = 6000
#: Labelled documents of each label at most that landmarks and machine are learned from.
TRAINED = 3000
LANDMARKS = 48
#: Sentences of a document that training looks at: those with the largest kernels.
SENTENCES = 4
#: Pieces of words that are looked for in the training documents to choose landmarks from.
PIECES = 3000
#: Likelihood ratio that a piece needs to be a landmark.
CHANCE = 22.0
DECAY = 0.8
#: Longest word seen whole; longer ones are seen in overlapping pieces.
LONGEST = 24
#: A share of a landmark's kernel with itself below which a word says nothing of it.
LEAST = 0.45
KNOWN = 300_000

_ENDS = regex.compile(r"[.!?\n]+(?=\s|$)|\n+")


def words_of(text: str) -> list[str]:
    """The words of lower-cased text; three or more single characters in a row, also with a mark each, make a word too."""
    words = text.lower().split()
    run: list[str] = []
    more = []
    for w in [*words, "   "]:
        if len(w) == 1 or len(w) == 2 and w[0].isalpha() and not w[1].isalnum():
            run.append(w[0])
        elif run:
            if len(run) >= 3:
                more.append("".join(run))
            run = []
    return words + more


def _pieces(word: str) -> list[str]:
    """What of a word is compared: itself, and its letters alone where other characters are among them."""
    if not word.isalpha() and (letters := "".join(c for c in word if c.isalpha())):
        return _cut(word) + _cut(letters)
    return _cut(word)


def _cut(word: str) -> list[str]:
    return [word] if len(word) <= LONGEST else [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


class Kernel:
    """Shares of the landmarks' own kernels that words have."""

    def __init__(self, landmarks: list[str]):
        self.landmarks = landmarks
        letters = sorted({c for t in landmarks for c in t})
        self.table = np.zeros(0x110000 if any(ord(c) > 0xFFFF for c in letters) else 0x10000, np.uint8)
        for i, c in enumerate(letters, 1):
            self.table[ord(c)] = min(i, 255)
        self.codes = [self.table[np.array([ord(c) for c in t])] for t in landmarks]
        self.sizes = np.array([len(t) for t in landmarks])
        self.masks = np.zeros((256, len(landmarks)), np.uint64)
        for m, codes in enumerate(self.codes):
            for j, c in enumerate(codes.tolist()):
                self.masks[c, m] |= np.uint64(1 << j)
        self.masks[0] = 0
        self.needed = np.ceil(0.85 * self.sizes)
        self.own = np.array([self._kernel(c[None, :], c)[0] for c in self.codes])

    def coded(self, words: list[str]) -> np.ndarray:
        points = np.array(words, dtype=f"U{LONGEST}").view(np.uint32).reshape(len(words), LONGEST)
        return np.where(points < len(self.table), self.table[np.minimum(points, len(self.table) - 1)], 0)

    @staticmethod
    def _kernel(words: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """The kernel of each word with one landmark: subsequences of three, both stretches decaying."""
        n, size = words.shape
        fade = np.triu(DECAY ** np.abs(np.subtract.outer(np.arange(len(mark)), np.arange(len(mark)))))
        before = [np.ones((n, len(mark) + 1)) for _ in range(size + 1)]
        total = np.zeros(n)
        same = [(words[:, i, None] == mark[None, :]) for i in range(size)]
        for p in range(3):
            run, after = np.zeros((n, len(mark) + 1)), [np.zeros((n, len(mark) + 1))]
            for i in range(size):
                hit = same[i] * before[i][:, :-1] * DECAY**2
                if p == 2:
                    total += hit.sum(axis=1)
                    continue
                run = DECAY * run
                run[:, 1:] += hit @ fade
                after.append(run)
            before = after
        return total

    def shares(self, words: list[str]) -> np.ndarray:
        """A row of shares for each word of up to LONGEST characters; zero where too little is in common."""
        out = np.zeros((len(words), len(self.landmarks)), np.float32)
        for at in range(0, len(words), 4096):
            coded = self.coded(words[at : at + 4096])
            state = np.full((len(coded), len(self.landmarks)), ~np.uint64(0))
            coded = coded[:, : 1 + np.flatnonzero(coded.any(axis=0)).max(initial=0)]
            for i in range(coded.shape[1]):
                hit = state & self.masks[coded[:, i]]
                state = (state + hit) | (state - hit)
            within = np.array([(1 << int(s)) - 1 for s in self.sizes], np.uint64)
            common = np.bitwise_count(~state & within)
            for m in np.flatnonzero((common >= self.needed).any(axis=0)).tolist():
                rows = np.flatnonzero(common[:, m] >= self.needed[m])
                share = self._kernel(coded[rows], self.codes[m]) / self.own[m]
                out[at + rows, m] = np.where(share >= LEAST, np.minimum(share, 1.0), 0)
        return out


class Words:
    """Kernel rows of words, kept between documents: all that have any, and a bounded number that have none."""

    def __init__(self, landmarks: list[str]):
        self.kernel = Kernel(landmarks)
        self.some: dict[str, np.ndarray] = {}
        self.none: set[str] = set()

    def learn(self, words: set[str]) -> None:
        new = list(words - self.none - self.some.keys())
        if len(self.none) > KNOWN:
            self.none = set()
        if len(self.some) > KNOWN // 4:
            self.some = {}
            new = list(words)
        pieces = [(w, p) for w in new for p in _pieces(w)]
        rows = self.kernel.shares([p for _, p in pieces])
        for k in np.flatnonzero(rows.any(axis=1)).tolist():
            w = pieces[k][0]
            self.some[w] = np.maximum(self.some[w], rows[k]) if w in self.some else rows[k]
        self.none.update(w for w in new if w not in self.some)

    def sentences(self, text: str, words: set[str]) -> list[np.ndarray]:
        """Kernel rows of the sentences that have any."""
        hot = words & self.some.keys()
        if not hot:
            return []
        out = []
        for sentence in _ENDS.split(text):
            rows = [self.some[w] for w in set(words_of(sentence)) & hot]
            if rows:
                out.append(np.max(rows, axis=0))
        return out or [np.max([self.some[w] for w in hot], axis=0)]


def pieces_of(word: str) -> set[str]:
    return {word[i:j] for i in range(len(word)) for j in range(i + 4, min(len(word), i + 10) + 1)}


def candidates(counts: list[tuple[str, int, int]], positives: int, negatives: int) -> list[str]:
    """Pieces that toxic documents' words have far oftener, from (word, toxic documents, others)."""
    pos, neg = defaultdict(int), defaultdict(int)
    for word, p, n in counts:
        for piece in pieces_of(word):
            pos[piece] += p
            neg[piece] += n
    odd = {t: pos[t] / positives - 3 * neg[t] / negatives for t in pos if pos[t] >= 3}
    return sorted((t for t in odd if odd[t] > 0), key=lambda t: (-odd[t], -len(t), t))[:PIECES]


def choose_landmarks(pieces: list[str], has: np.ndarray, toxic: np.ndarray) -> list[str]:
    """Pieces in an order in which each adds most toxic documents and few others; has: document by piece.

    A toxic document counts half as much for each landmark it has already, since it may hold several insults;
    a piece that shares four characters in a row with an earlier one is that one again."""
    share = np.where(toxic, 1 / max(1, toxic.sum()), -6 / max(1, (~toxic).sum()))
    left, chosen = np.ones(len(toxic)), []
    worth = np.array([1 + 0.001 * len(t) for t in pieces])
    # likelihood ratio of the piece's share of toxic documents against that of all: beyond what chance gives the
    # luckiest of thousands of pieces
    p, n = has[toxic].sum(axis=0) + 1e-9, has[~toxic].sum(axis=0) + 1e-9
    rate = toxic.mean()
    fresh = 2 * (p * np.log(p / (p + n) / rate) + n * np.log(n / (p + n) / (1 - rate))) > CHANCE
    while len(chosen) < LANDMARKS and fresh.any():
        gain = np.where(fresh, (share * left) @ has, -np.inf)
        best = int((gain * worth).argmax())
        if gain[best] <= 0.002:
            break
        chosen.append(pieces[best])
        left = left * np.where(has[:, best] & toxic, 0.5, 1.0)
        fours = {pieces[best][i : i + 4] for i in range(len(pieces[best]) - 3)}
        fresh &= np.array([not any(f in t for f in fours) for t in pieces])
    return chosen


def nystrom(landmarks: list[str]) -> np.ndarray:
    """The map from kernels with the landmarks to features: the inverse root of their own kernel matrix."""
    own = Kernel(landmarks).shares([t[:LONGEST] for t in landmarks]).astype(float)
    values, vectors = np.linalg.eigh((own + own.T) / 2)
    keep = values > 1e-3
    return vectors[:, keep] / np.sqrt(values[keep])


def train_svm(x: np.ndarray, y: np.ndarray, strength: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Weights, the last one a bias, by dual coordinate descent on the hinge loss; classes weigh alike."""
    x = np.hstack([x, np.ones((len(x), 1))])
    most = strength * len(y) / 2 / np.where(y > 0, max(1, (y > 0).sum()), max(1, (y < 0).sum()))
    alpha, w, size, rng = np.zeros(len(y)), np.zeros(x.shape[1]), (x * x).sum(axis=1), np.random.default_rng(5)
    for _ in range(rounds):
        for i in rng.permutation(len(y)):
            new = min(max(alpha[i] + (1 - y[i] * (x[i] @ w)) / size[i], 0), most[i])
            if new != alpha[i]:
                w += (new - alpha[i]) * y[i] * x[i]
                alpha[i] = new
    return w


def logistic(f: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """a, c so that 1 / (1 + exp(-(a * f + c))) fits the labels; a ridge keeps separable rows finite."""
    z, x = np.array([1.0, 0.0]), np.stack([f, np.ones_like(f)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ z, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + 1e-2 * z
        z = z - np.linalg.solve(x.T @ (x * (weight * p * (1 - p))[:, None]) + 1e-2 * np.eye(2), gradient)
    return float(max(z[0], 0.0)), float(z[1])


class Model:
    """Landmarks, the weight of each in a sentence's value, the bias, and the logistic's a and c."""

    def __init__(self, landmarks: list[str], weights: np.ndarray, bias: float, a: float, c: float):
        self.landmarks, self.weights, self.bias, self.a, self.c = landmarks, weights, bias, a, c

    def scores(self, documents: list[list[np.ndarray]]) -> list[float]:
        """A score for each document, given its sentences' kernel rows."""
        worst = np.array([max([float(r @ self.weights) for r in rows], default=0.0) for rows in documents])
        return (1 / (1 + np.exp(-np.clip(self.a * (np.maximum(worst, 0.0) + self.bias) + self.c, -30, 30)))).tolist()


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The model of the labelled rows that aren't held out; one that says 0 for all if they lack a label."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).cast("int").alias("toxic")).where(~held_out(F.col("doc_id")))
    known = written(known, "labels")
    sizes = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return Model([], np.zeros(0), 0.0, 1.0, -30.0)
    picked = [known.where(F.col("toxic") == t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAINED) for t in (0, 1)]
    # at most 2 * TRAINED ids, whatever the tables' sizes
    ids = F.broadcast(written(picked[0].unionByName(picked[1]), "training-ids"))
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(ids, "doc_id").select("toxic", "text").repartition(16), "training-texts")
    taken = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(taken) < 2:
        return Model([], np.zeros(0), 0.0, 1.0, -30.0)
    words = rows.select("toxic", F.explode(F.array_distinct(F.split(F.lower("text"), "\\s+"))).alias("word")).where(F.length("word").between(3, LONGEST))
    counts = written(words.groupBy("word").agg(F.sum("toxic").alias("p"), F.sum(1 - F.col("toxic")).alias("n")), "word-counts")
    top = {(r.word, r.p, r.n) for c in ("p", "n") for r in counts.orderBy(F.desc(c), "word").limit(WORDS).collect()}
    pieces = candidates(sorted(top), taken[1], taken[0])

    def presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {t: i for i, t in enumerate(pieces)}
        for batch in batches:
            found = []
            for text in batch.column(1).to_pylist():
                own = {number[t] for w in set(words_of(text)) if len(w) <= 2 * LONGEST for t in pieces_of(w) if t in number}
                found.append(np.array(sorted(own), np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["toxic", "own"])

    seen = rows.mapInArrow(presence, "toxic int, own binary").collect()
    has = np.zeros((len(seen), len(pieces)), bool)
    for k, r in enumerate(seen):
        has[k, np.frombuffer(r.own, np.int32)] = True
    landmarks = choose_landmarks(pieces, has, np.array([r.toxic == 1 for r in seen]))
    if not landmarks:
        return Model([], np.zeros(0), 0.0, 1.0, -30.0)

    def kernels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words(landmarks)
        for batch in batches:
            found = []
            for text in batch.column(1).to_pylist():
                own = set(words_of(text))
                known.learn(own)
                best = sorted(known.sentences(text, own), key=lambda r: -float(r.sum()))[:SENTENCES]
                found.append(np.array(best, np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["toxic", "rows"])

    gathered = rows.mapInArrow(kernels, "toxic int, rows binary").collect()
    documents = sorted((r.toxic, bytes(r.rows)) for r in gathered)  # one order, whatever the tasks' order
    y = np.array([t for t, _ in documents])
    bags = [np.frombuffer(b, np.float32).reshape(-1, len(landmarks)).astype(float) for _, b in documents]
    to_features = nystrom(landmarks)
    weights = np.ones(len(landmarks))
    for _ in range(3):
        x, t = [], []
        for label, bag in zip(y, bags, strict=True):
            none = np.zeros((1, len(landmarks)))
            own = (bag if len(bag) else none) if not label else (bag[[int((bag @ weights).argmax())]] if len(bag) else none[:0])
            x.append(own)
            t += [1.0 if label else -1.0] * len(own)
        x.append(np.zeros((1, len(landmarks))))
        t.append(-1.0)
        w = train_svm(np.vstack(x) @ to_features, np.array(t))
        weights, bias = to_features @ w[:-1], float(w[-1])
    worst = np.array([max(0.0, float((bag @ weights).max())) if len(bag) else 0.0 for bag in bags]) + bias
    share = np.where(y == 1, sizes[1] / max(1, (y == 1).sum()), sizes[0] / max(1, (y == 0).sum()))
    return Model(landmarks, weights, bias, *logistic(worst, y.astype(float), share * len(y) / share.sum()))


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of ``docs``, from its text alone."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        known = Words(model.landmarks) if model.landmarks else None
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = part.column(2).to_pylist()
                if known is None:
                    scores = [0.0] * len(texts)
                else:
                    own = [set(words_of(t)) for t in texts]
                    known.learn(set().union(*own))
                    scores = model.scores([known.sentences(t, w) for t, w in zip(texts, own, strict=True)])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= threshold) for s in scores], pa.int32())], names=["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def toxic_documents(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted for each row of ``docs``, learned from ``labels`` (doc_id, toxic).

    Rows whose crc32 of the doc_id as text is 2 modulo 4 are held out: their labels aren't looked at. Null
    and empty texts score as a text without insults. Repeated and null ids stay; other columns are ignored; without
    labels of both kinds all scores are 0.
    """
    return score(docs, fit(docs, labels), threshold)
