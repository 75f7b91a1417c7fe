import hashlib
import re
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from cairn.llm import exact_dedup
from cairn.llm.exact_dedup import build_filter, dedup, passes


def brute(rows):
    norm = [re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t in rows]
    ids = defaultdict(list)
    for (i, _), t in zip(rows, norm, strict=True):
        ids[t].append(i)
    low = lambda xs: min(xs, key=lambda i: (i is not None, i or 0))
    return sorted(((i, low(ids[t]), len(ids[t]), i == low(ids[t]), hashlib.sha256(t.encode()).hexdigest()) for (i, _), t in zip(rows, norm, strict=True)), key=str)


ROWS = [(i, f"text {i % 30}" if i % 2 else f"text\t\n {i % 40}") for i in range(300)] + [(500, None), (501, ""), (502, " "), (503, "\x0b"), (504, " "), (7, "text 7"), (None, "text 8"), (None, "only"), (600, "x" * 100_000), (601, "x" * 100_000)]


def test_against_brute_force(spark, docs_of, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BUCKET_DIGESTS", 20)
    for split in (F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0, F.lit(True), F.lit(False)):
        got = sorted((tuple(r) for r in dedup(docs_of(ROWS), split).collect()), key=str)
        assert got == brute(ROWS)


def test_weak_digests_are_told_apart_by_bytes(spark, docs_of):
    weak = lambda text: F.encode(F.pmod(F.crc32(F.encode(text, "UTF-8")), F.lit(5)).cast("string"), "UTF-8")
    got = sorted((tuple(r) for r in dedup(docs_of(ROWS), F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0, digest=weak).collect()), key=str)
    assert got == brute(ROWS)


def test_empty(spark, docs_of):
    assert dedup(docs_of(ROWS).limit(0), F.lit(True)).count() == 0


def test_filter_has_all_members_and_few_others():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 10, 100, 1000, 50_000):
        keys = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        made = build_filter(keys)
        assert passes(made, keys).all()
        assert passes(made, rng.integers(0, 2**63, 50_000, dtype=np.uint64)).mean() < 0.006
        assert n < 50_000 or len(made) < 1.3 * n
