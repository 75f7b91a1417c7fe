import random

import numpy as np
import pytest

import corpus_pipeline
from cairn.llm import near_dedup


def brute_kept(rows):
    sets = []
    for _, t in rows:
        words = "".join(c.lower() if c.isascii() else c for c in t or "").split()
        sets.append({" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a == b or 5 * len(a & b) >= 4 * len(a | b):
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return sorted(min(i for (i, _), s in zip(rows, root, strict=True) if s == r) for r in set(root))


def changed(rng, text, k):
    words = text.split()
    for i in rng.sample(range(len(words)), k):
        words[i] = f"new{rng.randrange(10**6)}"
    return " ".join(words)


@pytest.mark.parametrize("family,held,compared", [(0, 20_000, 50_000_000), (80, 20_000, 50_000_000), (150, 7, 300)])
def test_stage_against_brute_jaccard(spark, docs_of, monkeypatch, family, held, compared):
    monkeypatch.setattr(near_dedup, "HELD", held)
    monkeypatch.setattr(near_dedup, "COMPARED", compared)
    rng = random.Random(family)
    word = lambda: f"w{rng.randrange(5000)}"
    rows = [(i, " ".join(word() for _ in range(rng.randint(3, 250)))) for i in range(120)]
    rows += [(1000 + i, changed(rng, rows[i][1], rng.randint(0, max(1, len(rows[i][1].split()) // 35)))) for i in range(120)]
    base = " ".join(word() for _ in range(200))
    rows += [(2000 + i, changed(rng, base, rng.randint(1, 6) if family < 100 else rng.randint(1, 16))) for i in range(family)]
    rows += [(2500 + i, changed(rng, dict(rows)[2000 + i], 1)) for i in range(family // 3)]
    rows += [(3000, ""), (3001, None), (3002, " \n"), (3003, "One two"), (3004, "one  TWO")]
    want = brute_kept(rows)
    assert sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs_of(rows), "").collect()) == want
    assert len(want) < len(rows) - 60 - family // 2


def test_copies_of_one_text_and_no_rows(spark, docs_of):
    rows = [(None, "no id"), (1, "first text"), (1, "another text"), (2, "third text")] * 2
    got = near_dedup.one_of_each(docs_of(rows)).collect()
    assert len(got) == 4
    assert near_dedup.one_of_each(docs_of(rows).limit(0)).count() == 0


def test_index_is_of_simhash_and_deletion_variants():
    rng = np.random.default_rng(3)
    shingled = [np.unique(rng.integers(0, 1 << 64, 30, np.uint64)) for _ in range(400)]
    shingled += [np.unique(np.concatenate([s[:28], rng.integers(0, 1 << 64, 1, np.uint64)])) for s in shingled[:200]]
    for length, count in (near_dedup.segments_of(1000), (6, 9), (22, 85)):
        words = near_dedup.words_of(length, count)
        factors, terms = near_dedup._FACTORS[:words], near_dedup._TERMS[:words]
        prints = np.stack([near_dedup.simhash(s, factors, terms) for s in shingled])
        for s, found in zip(shingled[:5], prints, strict=False):  # bit by bit: the majority of the shingles' hashes
            for k in (0, 63, 64, 64 * words - 1):
                ones = sum(int(near_dedup._mixed(h * factors[k // 64 :][:1] + terms[k // 64 :][:1])[0]) >> (k % 64) & 1 for h in s)
                assert int(found[k // 64]) >> (k % 64) & 1 == (2 * ones > len(s))
        whole = [int.from_bytes(p.tobytes(), "little") for p in prints]
        cut = [[(w >> (128 + j * length)) & ((1 << length) - 1) for j in range(count)] for w in whole]
        want = set()
        for i, a in enumerate(cut):
            for j in range(i):
                if ((whole[i] ^ whole[j]) & ((1 << 128) - 1)).bit_count() <= near_dedup.CHECK_DIFFERS and any((x ^ y).bit_count() <= 1 for x, y in zip(a, cut[j], strict=True)):
                    want.add((j, i))
        place = near_dedup.places(prints, length, count)
        node = np.repeat(np.arange(len(prints)), 2 * count)
        order = np.lexsort((node, place.ravel()))
        u, v, family = near_dedup.joined(place.ravel()[order], node[order], prints[node[order], : near_dedup.CHECK], length)
        assert {(min(p), max(p)) for p in zip(u.tolist(), v.tolist(), strict=True)} == want and not len(family)
        assert len(want) >= 199


def test_families_are_marked_and_recall_at_the_bound():
    rng = np.random.default_rng(4)
    length, count = near_dedup.segments_of(200_000)
    words = near_dedup.words_of(length, count)
    factors, terms = near_dedup._FACTORS[:words], near_dedup._TERMS[:words]
    for both, one in ((4, (0, 1)), (8, (1, 1)), (80, (10, 10)), (80, (0, 20))):
        missed = 0
        for _ in range(500):
            h = rng.integers(0, 1 << 64, both + sum(one), np.uint64)
            a, b = (near_dedup.simhash(np.unique(s), factors, terms) for s in (h[: both + one[0]], np.concatenate([h[:both], h[both + one[0] :]])))
            met = (np.bitwise_count(np.bitwise_xor(*near_dedup.places(np.stack([a, b]), length, count)))[::2] <= 1).any()
            missed += not (met and near_dedup._differing(a[:2], b[:2]) <= near_dedup.CHECK_DIFFERS)
        assert missed <= 3  # at a Jaccard similarity of 0.8
    base = rng.integers(0, 1 << 64, 100, np.uint64)
    prints = np.stack([near_dedup.simhash(np.concatenate([base[:98], rng.integers(0, 1 << 64, 2, np.uint64)]), factors, terms) for _ in range(300)])
    place = near_dedup.places(prints, length, count).ravel()
    node = np.repeat(np.arange(300), 2 * count)
    order = np.lexsort((node, place))
    u, v, family = near_dedup.joined(place[order], node[order], prints[node[order], : near_dedup.CHECK], length)
    assert family.tolist() == list(range(300))  # all are compared again
    assert len({(min(p), max(p)) for p in zip(u.tolist(), v.tolist(), strict=True)}) < 300 * 40


def test_loose_family_makes_rows_by_its_size_not_its_square(spark, docs_of, monkeypatch):
    rows_of = {}

    def counted(df, name, write=near_dedup.written):
        out = write(df, name)
        rows_of[name] = max(rows_of.get(name, 0), out.count())
        return out

    monkeypatch.setattr(near_dedup, "written", counted)
    rng = random.Random(12)
    base = " ".join(f"w{k}" for k in range(404))
    n = 300  # most pairs are just below 0.8, some at it
    rows = [(i, changed(rng, base, 6)) for i in range(n)]
    want = brute_kept(rows)
    assert n / 4 < len(want) < n - 10
    assert sorted(r.doc_id for r in near_dedup.one_of_each(docs_of(rows)).collect()) == want
    # a text is in 14 blocks, held and passing by
    assert rows_of["near-crossed"] < n * 2 and max(rows_of.values()) <= n * 28, rows_of


def test_blocks_hold_few_sets_at_once_and_lose_nothing(spark, docs_of, monkeypatch):
    monkeypatch.setattr(near_dedup, "HELD_BYTES", 10_000)
    rng = random.Random(13)
    base = " ".join(f"w{k}" for k in range(404))
    rows = [(i, changed(rng, base, 6)) for i in range(200)]  # three sets at once
    assert sorted(r.doc_id for r in near_dedup.one_of_each(docs_of(rows)).collect()) == brute_kept(rows)


def test_carried_words_and_sizes_rule_pairs_out_inside_the_task():
    rng = np.random.default_rng(6)
    length, count = near_dedup.segments_of(200_000)
    words = near_dedup.words_of(length, count)
    factors, terms = near_dedup._FACTORS[:words], near_dedup._TERMS[:words]

    def met(sets, carried):
        prints = np.stack([near_dedup.simhash(s, factors, terms) for s in sets])
        place = near_dedup.places(prints, length, count).ravel()
        node = np.repeat(np.arange(len(sets)), 2 * count)
        order = np.lexsort((node, place))
        n = np.array([len(s) for s in sets])[node[order]] if carried else None
        u, v, _ = near_dedup.joined(place[order], node[order], prints[node[order], : near_dedup.CARRIED if carried else near_dedup.CHECK], length, n)
        return {(min(p), max(p)) for p in zip(u.tolist(), v.tolist(), strict=True)}

    base = rng.integers(0, 1 << 64, 57, np.uint64)
    loose = [np.unique(np.concatenate([base, rng.integers(0, 1 << 64, 43, np.uint64)])) for _ in range(40)]  # 0.4
    assert len(met(loose, False)) > 200 and len(met(loose, True)) < 60
    uneven = [np.unique(np.concatenate([base, rng.integers(0, 1 << 64, k, np.uint64)])) for k in (0, 15) * 5]
    assert {(i - j) % 2 for i, j in met(uneven, False)} == {0, 1} and {(i - j) % 2 for i, j in met(uneven, True)} == {0}
    for both, one in ((4, (0, 1)), (8, (1, 1)), (80, (10, 10)), (80, (0, 20))):  # a Jaccard similarity of 0.8
        found = []
        for _ in range(300):
            h = rng.integers(0, 1 << 64, both + sum(one), np.uint64)
            found += [np.unique(h[: both + one[0]]), np.unique(np.concatenate([h[:both], h[both + one[0] :]]))]
        pairs = met(found, True)
        assert sum((k, k + 1) not in pairs for k in range(0, 600, 2)) <= 2
