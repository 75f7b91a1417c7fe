import itertools
import math
import random

import numpy as np

from cairn.llm import quality_model
from cairn.llm.quality_model import LABELLERS, expectation_maximisation, measures, quality, votes, without_rejected


def corpus(n=400, seed=6):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "ti", "es", "ed"]) for _ in range(rng.randint(1, 4)))
    rows, good = [], []
    for i in range(n):
        words = [word() for _ in range(rng.randint(25, 120))]
        for k in range(0, len(words), 9):
            words[k] = words[k].title()
            words[k - 1] += "."
        kind = rng.randrange(10)
        if kind == 0:
            words = [w + rng.choice(["$$$", "%%%", "***"]) for w in words]
        elif kind == 1:
            words = [w.upper() + "!!" for w in words]
        elif kind == 2:
            words = words[:6] * 15
        elif kind == 3:
            words = [w for w in words[:8] for _ in range(12)]
        rows.append((i, " ".join(words)))
        good.append(kind > 3)
    return rows, good


def test_separates_junk_without_labels(spark, docs_of):
    rows, good = corpus()
    odd = [(900, None), (901, ""), (902, "x " * 60_000), (903, " \n"), (0, "repeated id"), (None, "null id")]
    got = quality(docs_of(rows + odd)).collect()
    assert len(got) == len(rows) + len(odd) and all(0 <= r.score <= 1 and r.kept == (r.score >= 0.4) for r in got)
    by = {r.doc_id: r.kept for r in got if r.doc_id is not None and 0 < r.doc_id < 900}
    assert np.mean([by[i] == good[i] for i in by]) > 0.97
    kept = without_rejected(docs_of(rows + odd))
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.kept)
    assert kept.columns == docs_of(rows).columns
    assert quality(docs_of(rows).limit(0)).count() == 0 == without_rejected(docs_of(rows).limit(0)).count()


def test_expectation_maximisation_finds_the_accuracies():
    rng = np.random.default_rng(1)
    good = rng.random(40_000) < 0.8
    recall, alarm = np.array([0.6, 0.4, 0.5, 0.3]), np.array([0.01, 0.02, 0.005, 0.03])
    bad = rng.random((40_000, 4)) < np.where(good[:, None], alarm, recall)
    cast = rng.random((40_000, 4)) < 0.9
    patterns = {}
    for b, c in zip(bad, cast, strict=True):
        key = "".join("-" if not y else "b" if x else "g" for x, y in zip(b, c, strict=True))
        patterns[key] = patterns.get(key, 0) + 1
    share, chance, posterior = expectation_maximisation(patterns, rounds=300)
    assert abs(share - 0.8) < 0.02 and np.abs(chance[0] - recall).max() < 0.04 and np.abs(chance[1] - alarm).max() < 0.02
    assert posterior["bbbb"] < 0.01 < 0.8 < posterior["gggg"]


def test_any_pattern_has_a_posterior():
    patterns = {"".join(p): 1 for p in itertools.product("bg-", repeat=4)}
    assert all(0 <= p <= 1 for p in expectation_maximisation(patterns)[2].values())
    assert expectation_maximisation({})[2] == {}


def test_votes_of_odd_texts():
    for text in ("", " ", "\n\n", "a", "é" * 1000, "! " * 50, "日本 " * 30):
        assert len(votes(measures(text))) == len(LABELLERS)
    assert votes(measures("short text")) == "-" * len(LABELLERS)


def brute_features(text):
    """The scorer's features with plain loops over bytes."""
    data, out = text.encode("utf-8"), [0.0] * quality_model.WIDTH
    low = [b + 32 if 65 <= b <= 90 else b for b in data]
    n = len(data) - 2
    if n >= 1:
        for a, b, c in zip(low, low[1:], low[2:], strict=False):
            out[(a * 0x9E3779B1 + b * 0x85EBCA6B + c * 0xC2B2AE35) % 2**32 >> 21] += 0.25 / n
        kinds = [int(quality_model._KIND[b]) for b in data]
        for a, b in zip(kinds, kinds[1:], strict=False):
            out[2048 + (((a * 16 + b) * 0x9E3779B1) % 2**32 >> 22)] += 1 / (len(data) - 1)
    m = quality_model.measures(text)
    for k, name in enumerate(("symbols", "shouts", "capitals", "again", "repeats", "same_lines", "points", "distinct", "plain_words", "letters")):
        out[3072 + int(quality_model._SALT[k * 16 + min(9, int(10 * min(1.0, m[name])))] % 1024)] += 0.3
    return [x**0.5 for x in out]


def test_query_against_plain_features_and_scores(spark, docs_of):
    texts = ["plain words of a clean text, which go on for a while.\n" * 3, "$$$ ### $$$ ***", "", None, "Ünïcode é ü", "SHOUT!! " * 30, "ab"] + [f"another clean text number {i} with words." for i in range(20)]
    docs = docs_of(list(enumerate(texts)))
    weights = quality_model.fit(docs)
    for text in texts:
        plain = brute_features(text or "")
        assert max(abs(a - b) for a, b in zip(plain, quality_model.features(text or "", quality_model.measures(text or "")), strict=True)) < 1e-9
    want = {i: 1 / (1 + math.exp(-(sum(x * w for x, w in zip(brute_features(t or ""), weights[:-1], strict=True)) + weights[-1]))) for i, t in enumerate(texts)}
    got = {r.doc_id: r for r in quality_model.quality(docs).collect()}
    assert set(got) == set(want) and all(abs(got[i].score - s) < 1e-9 and got[i].kept == (got[i].score >= quality_model.REJECT) for i, s in want.items())


def test_measures_against_plain_counts():
    text = "One two two three!! ## one two two three\nsame line here\nsame line here\n\n"
    m, words = quality_model.measures(text), text.split()
    lines = [x for x in text.split("\n") if x.strip()]
    fours = [tuple(words[i : i + 4]) for i in range(len(words) - 3)]
    assert m["n_words"] == len(words) and m["again"] == sum(a == b for a, b in zip(words, words[1:], strict=False)) / (len(words) - 1)
    assert m["symbols"] == 2 / len(words) and m["shouts"] == 2 / len(words) and m["distinct"] == len(set(words)) / len(words)
    assert m["same_lines"] == 1 - len(set(lines)) / len(lines) and m["repeats"] == 1 - len(set(fours)) / len(fours)
