import hashlib
import random
from collections import Counter

import pytest

from cairn.llm import substring_dedup
from cairn.llm.substring_dedup import removal_digests, repeated, without_repeats

SPAN, GRAM = 20, 4


def brute_spans(texts, span):
    """(from, to) runs of removed bytes of each text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + span] for d in data for i in range(len(d) - span + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - span + 1):
            if seen[d[i : i + span]] > 1:
                gone[i : i + span] = [True] * span
        edges = [k for k in range(len(d) + 1) if (k > 0 and gone[k - 1]) != (k < len(d) and gone[k])]
        out.append(list(zip(edges[::2], edges[1::2], strict=True)))
    return out


def brute(rows, span):
    out = []
    for (i, t), spans in zip(rows, brute_spans([t for _, t in rows], span), strict=True):
        d = (t or "").encode()
        kept = b"".join(d[a:b] for a, b in zip([0, *[h for _, h in spans]], [*[w for w, _ in spans], len(d)], strict=True))
        out.append((i, len(d), sum(h - w for w, h in spans), len(spans), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=120):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k))
    shared = [prose(rng.randint(5, 30)) for _ in range(6)]
    texts = []
    for i in range(n):
        t = prose(rng.randint(0, 60))
        if i % 3 == 0:
            t += rng.choice(["", " "]) + rng.choice(shared) + rng.choice(["", " "]) + prose(rng.randint(0, 20))
        if i % 10 == 0:
            t = texts[rng.randrange(len(texts))] if texts else t
        if i % 7 == 0 and t:
            k = rng.randrange(len(t))
            t = t[:k] + "x" + t[k:]
        texts.append(t)
    texts += ["a" * 100, "a" * 19, "a" * 20, "ab" * 60, "abc" * 30 + "d" + "abc" * 30, "", " ", "é" * 50, "q" * 9 + shared[0] + "z" * 9, shared[0], shared[0]]
    return texts


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


@pytest.mark.parametrize("held", [512, 3, 0])
def test_query_against_brute_force(spark, docs_of, monkeypatch, held):
    monkeypatch.setattr(substring_dedup, "HELD", held)
    monkeypatch.setattr(substring_dedup, "BUCKET_BYTES", 2000)
    passage = "a passage in many documents, with other neighbours everywhere"
    rows = list(enumerate(corpus(held + 1))) + [(5, "twice the same id " * 3), (5, "twice the same id " * 3), (None, None), (None, "null id, and a text of its own")]
    rows += [(1000 + i, f"{i * 7919 % 101:03d}"[:: i % 2 * 2 - 1] + passage[i % 5 :] + f"{i * 31 % 97:02d}") for i in range(30)]
    # texts for which polynomial hashes modulo a power of two collide
    rows += [(2000, thue_morse(3000)), (2001, "x" + thue_morse(900)), (2002, thue_morse(2048).translate({97: 98, 98: 97}))]
    assert sorted((tuple(r) for r in removal_digests(docs_of(rows), SPAN, GRAM).collect()), key=str) == brute(rows, SPAN)


def test_long_texts_in_pieces():
    rng = random.Random(3)
    base = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    texts = [base, base[500:900] + "!" + base[1200:1900], "x" * 300]
    import numpy as np

    data = b"".join(t.encode() for t in texts)
    ends = np.cumsum([len(t) for t in texts]).tolist()
    found = substring_dedup.phrases(np.frombuffer(data, np.uint8), ends, SPAN, GRAM)
    # phrases tile the strings of every text, in order
    at = [k for f, c in zip(found["first"], found["cnt"], strict=True) for k in range(f, f + c)]
    assert at == [k for s, e in zip([0, *ends], ends, strict=False) for k in range(s, e - SPAN + 1)]
    # equal strings have equal trigger grams, wherever the text was cut
    keys = {}
    for f, c, k in zip(found["first"], found["cnt"], found["key"], strict=True):
        for p in range(f, f + c):
            keys.setdefault(data[p : p + SPAN], set()).add(int(k))
    assert all(len(v) == 1 for v in keys.values())


def test_repeated_against_brute_force():
    for seed in range(15):
        segments = [t.encode() for t in corpus(seed, 60)]
        segments = [s for s in segments if len(s) >= SPAN]
        seen = Counter(s[i : i + SPAN] for s in segments for i in range(len(s) - SPAN + 1))
        if seed == 0:
            segments += [thue_morse(2000).encode(), b"x" + thue_morse(700).encode()]
            seen = Counter(s[i : i + SPAN] for s in segments for i in range(len(s) - SPAN + 1))
        for density in (2, 16):
            got = repeated(segments, SPAN, overlap=4, density=density)
            assert [m.tolist() for m in got] == [[seen[s[i : i + SPAN]] > 1 for i in range(len(s) - SPAN + 1)] for s in segments]


def test_texts_after_removal(spark, docs_of):
    rows = [(1, "unique one " + "é the shared passage é" * 2), (2, "é the shared passage é" * 2 + " unique two"), (3, None), (4, "short")]
    got = {r.doc_id: r for r in without_repeats(docs_of(rows), SPAN, GRAM).collect()}
    assert got[1].text.strip() == "unique one" and got[2].text.strip() == "unique two"
    assert got[3].text == "" and got[4].text == "short" and got[1].n_chars == len(got[1].text)
    assert got[1].asDict().keys() == docs_of(rows).first().asDict().keys() and got[1].key == "x"
    assert removal_digests(docs_of(rows).limit(0)).count() == 0
