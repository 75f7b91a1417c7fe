import random
import re

import numpy as np
import xxhash

from cairn.llm import simhash
from cairn.llm.components import components
from cairn.llm.simhash import fingerprint, links, near_duplicates


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    root = list(range(len(fps)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(len(fps))]


def texts(n, seed):
    rng = random.Random(seed)
    base = [[rng.choice("a be sea De Éa four five sixth".split()) + str(rng.randint(0, 40)) for _ in range(rng.choice([1, 2, 3, 50, 700]))] for _ in range(n // 4)]
    out = []
    for i in range(n):
        words = list(base[i % len(base)])
        if rng.random() < 0.6:
            words[rng.randrange(len(words))] = "new"
        out.append(rng.choice([" ", "\t", "\n "]).join(words))
    return out


def test_query_against_brute_force(spark, docs_of):
    rows = list(enumerate(texts(200, 1), 10)) + [(5, None), (6, ""), (7, " \n"), (300, "one"), (300, "one"), (None, "one"), (3, "x y"), (301, "w " * 70_000)]
    fps = [brute_fingerprint(t or "") for _, t in rows]
    root = brute_components(fps)
    least = {r: min(i for (i, _), s in zip(rows, root, strict=True) if s == r and i is not None) for r in set(root)}
    want = sorted(((i, f"{f:016x}", least[r]) for (i, _), f, r in zip(rows, fps, root, strict=True)), key=str)
    assert len(set(root)) < len(set(fps))
    assert sorted((tuple(r) for r in near_duplicates(docs_of(rows)).collect()), key=str) == want
    assert near_duplicates(docs_of(rows).limit(0)).count() == 0


def family(rng, n):
    """Fingerprints in dense neighbourhoods, so that keys are shared by many."""
    centres = [rng.getrandbits(64) for _ in range(4)]
    out = set()
    while len(out) < n:
        f = rng.choice(centres)
        for _ in range(rng.randint(0, 4)):
            f ^= 1 << rng.randrange(64)
        out.add(f)
    return sorted(out)


def test_links_of_dense_families(spark, monkeypatch):
    for paired, held in ((10**6, 10**6), (8, 10**6), (2, 10**6), (2, 20)):
        monkeypatch.setattr(simhash, "PAIRED", paired)
        monkeypatch.setattr(simhash, "HELD", held)
        # the workers import the module anew, so the limits are also checked in this process
        fps = family(random.Random(paired + held), 300)
        keys = []
        for f in fps:
            for i in range(66):
                part = f & 0xFFFFFFFF if i < 33 else f >> 32
                keys.append(((i << 32) | (part if i % 33 == 32 else part & ~(1 << i % 33)), f))
        keys.sort()
        import pyarrow as pa

        key = np.array([k for k, _ in keys], np.int64)
        fp = np.array([f for _, f in keys], np.uint64).view(np.int64)
        step = 50 if held == 20 else 700
        batches = [pa.RecordBatch.from_arrays([pa.array(key[a : a + step]), pa.array(fp[a : a + step])], names=["key", "fp"]) for a in range(0, len(key), step)]
        found, long_runs = [], []
        for b in simhash._meet(iter(batches)):
            for r in b.to_pylist():
                (long_runs if r["v"] is None else found).append(r)
        assert bool(long_runs) == (held == 20)
        if long_runs:
            frame = spark.createDataFrame([(r["u"], r["key"]) for r in long_runs], "u long, key long")
            found += [r.asDict() for r in simhash._exchanged_stars(frame).collect()]
        place = {f: i for i, f in enumerate(np.array(fps, np.uint64).view(np.int64).tolist())}
        want = brute_components(fps)
        root = list(range(len(fps)))
        for _ in range(len(fps)):
            before = list(root)
            for r in found:
                a, b = place[r["u"]], place[r["v"]]
                root[a] = root[b] = min(root[a], root[b])
            if root == before:
                break
        assert root == want


def test_links_through_spark(spark):
    fps = family(random.Random(9), 200)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    got = {r.node: r.root for r in components(links(spark.createDataFrame([(f,) for f in signed], "fp long"))).collect()}
    want = brute_components(fps)
    groups = {}
    for f, r in zip(signed, want, strict=True):
        groups.setdefault(r, set()).add(f)
    mine = {}
    for f in signed:
        mine.setdefault(got.get(f, f), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_components_of_a_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 100), (200, 201), (201, 200)], "u long, v long")
    assert {r.node: r.root for r in components(chain).collect()} == {i: 0 for i in range(61)} | {200: 200, 201: 200}
    assert components(chain.where("u > 999")).count() == 0


def test_fingerprint():
    for t in [*texts(30, 4), "", "one", "one two", "ÀB Ça", "w x " * 40_000]:
        assert fingerprint(t) == brute_fingerprint(t)
