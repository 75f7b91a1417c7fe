import zlib
from collections import Counter

import numpy as np

from cairn.llm import sharding
from cairn.llm.sharding import hypergeometric, matrix_row, permuted, shard_documents


def test_law_slots_and_digests(spark, docs_of):
    rows = [(i % 90, "same" if i % 3 else f"text é {i}") for i in range(997)] + [(None, None), (1, ""), (1, "")]
    got = shard_documents(docs_of(rows, 5), n_shards=7).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
    by = {s: sorted(r.slot for r in got if r.shard == s) for s in range(7)}
    assert all(v == list(range(len(v))) for v in by.values())
    assert {len(v) for v in by.values()} <= {142, 143}
    assert {(r.law, r.grown_shard) for r in got} == {("rows", None)}


def test_same_again_and_empty(spark, docs_of):
    docs = docs_of([(i, "t") for i in range(50)])
    one, two = ({(r.doc_id, r.shard, r.slot) for r in shard_documents(docs, 3, seed).collect()} for seed in (1, 1))
    assert one == two != {(r.doc_id, r.shard, r.slot) for r in shard_documents(docs, 3, 2).collect()}
    assert shard_documents(docs.limit(0)).count() == 0


def test_matrix_has_exact_sums():
    before, sizes = np.array([0, 5, 5, 40, 41, 100]), np.array([34, 33, 33])
    rows = [matrix_row(before, sizes, 9, p) for p in range(5)]
    assert (sum(r[0] for r in rows) == sizes).all()
    assert [int(r[0].sum()) for r in rows] == [5, 0, 35, 1, 59]
    for p in range(1, 5):
        assert (rows[p][1] == sum(r[0] for r in rows[:p])).all()


def test_uniform_over_shards():
    # a row's shard is uniform whichever partition it is in
    before, sizes = np.array([0, 10, 100]), np.array([50, 30, 20])
    mean = np.mean([matrix_row(before, sizes, seed, 0)[0] for seed in range(2000)], axis=0)
    assert np.abs(mean - [5, 3, 2]).max() < 0.15


def test_large_hypergeometric_like_the_small_one(monkeypatch):
    rng = np.random.default_rng(0)
    small = [hypergeometric(rng, 3000, 5000, 700) for _ in range(3000)]
    monkeypatch.setattr(sharding, "_LARGE", 10)
    large = [hypergeometric(rng, 3000, 5000, 700) for _ in range(3000)]
    assert abs(np.mean(small) - np.mean(large)) < 1 and abs(np.std(small) - np.std(large)) < 0.7


def test_bijection():
    for n in (1, 2, 3, 17, 1000):
        assert sorted(permuted(np.arange(n), n, [1, 2, 3]).tolist()) == list(range(n))


def test_few_rows_and_long_text(spark, docs_of):
    rows = [(1, "x" * 3_000_000), (2, None), (None, "é")]
    got = shard_documents(docs_of(rows), n_shards=40).collect()
    assert sorted((r.size, r.slot) for r in got) == [(16, 0), (18, 0), (3_000_016, 0)]
    assert len({r.shard for r in got}) == 3 and all(0 <= r.shard < 40 for r in got)


def test_permutations_of_few_rows_are_uniform():
    # every order of five rows is as likely: 119 degrees of freedom, 0.001 of chance beyond 173
    seen = Counter(tuple(permuted(np.arange(5), 5, [7, k]).tolist()) for k in range(6000))
    assert len(seen) == 120 and sum((n - 50) ** 2 / 50 for n in seen.values()) < 173
    for n in (2, 16, 40, 4096, 5000):
        assert sorted(permuted(np.arange(n), n, [3, n]).tolist()) == list(range(n))
    gaps = Counter()
    for k in range(4000):
        first, second = permuted(np.arange(2), 16, [9, k]).tolist()
        gaps[(second - first) % 16 // 4] += 1
    assert sum((gaps[g] - e) ** 2 / e for g, e in enumerate((800, 1066.7, 1066.7, 1066.7))) < 16.3


def test_slots_of_the_query_are_uniform(spark, docs_of):
    """Each row is as likely in each shard and slot, over many seeds: the place of one row of nine in three shards."""
    docs = docs_of([(i, f"t{i}") for i in range(9)], 3).cache()
    places = Counter()
    for seed in range(40):
        for r in shard_documents(docs, 3, seed).collect():
            places[(r.doc_id, r.shard * 3 + r.slot)] += 1
    expected = 40 / 9
    # 64 degrees of freedom, 0.001 of chance beyond 105
    assert sum((places[(i, p)] - expected) ** 2 / expected for i in range(9) for p in range(9)) < 105
