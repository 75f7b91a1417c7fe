import random
import zlib
from itertools import combinations

import numpy as np

from cairn.llm import toxicity
from cairn.llm.toxicity import DECAY, Kernel, logistic, toxic_documents, train_svm, words_of


def brute_kernel(s, t):
    """Sum over shared subsequences of three of the decay to the power of both stretches."""
    places = lambda x: [(tuple(x[i] for i in c), c[-1] - c[0] + 1) for c in combinations(range(len(x)), 3)]
    return sum(DECAY ** (a + b) for u, a in places(s) for v, b in places(t) if u == v)


def test_kernel_against_brute_force():
    marks = ["idiot", "worthless", "véju"]
    kernel = Kernel(marks)
    words = ["idiot", "i.d.i.o.t", "xidiotx", "idi", "", "worth-less", "vejuvéju", "woorrtthhlleessss", "aaaa", "日idiot"]
    got = kernel.shares(words)
    for i, w in enumerate(words):
        for j, t in enumerate(marks):
            share = brute_kernel(w, t) / brute_kernel(t, t)
            table = [[0] * (len(t) + 1) for _ in range(len(w) + 1)]
            for a in range(len(w)):
                for b in range(len(t)):
                    table[a + 1][b + 1] = table[a][b] + 1 if w[a] == t[b] else max(table[a][b + 1], table[a + 1][b])
            want = min(share, 1) if table[-1][-1] >= np.ceil(0.85 * len(t)) and share >= toxicity.LEAST else 0
            assert abs(got[i, j] - want) < 1e-5
    assert got[1, 0] > 0.35 and got[0, 0] == 1 and got[3, 0] == 0


def test_words():
    assert words_of("You I D I O T, a b no") == ["you", "i", "d", "i", "o", "t,", "a", "b", "no", "idiotab"]
    assert words_of("You i d i o t a")[-1] == "idiota"
    assert words_of("an i. d. i. o. t. he is")[-1] == "idiot"


def test_svm_and_logistic():
    rng = np.random.default_rng(0)
    x = np.vstack([rng.normal(1.5, 1, (200, 3)), rng.normal(-1.5, 1, (600, 3))])
    y = np.repeat([1.0, -1.0], [200, 600])
    w = train_svm(x, y)
    f = x @ w[:-1] + w[-1]
    assert ((f > 0) == (y > 0)).mean() > 0.97
    a, c = logistic(f, (y > 0).astype(float), np.ones(800))
    assert abs((1 / (1 + np.exp(-(a * f + c)))).mean() - 0.25) < 0.02


def corpus(n=900):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "ti", "es", "ed"]) for _ in range(rng.randint(1, 4)))
    insults = ["blockhead", "nitwit", "zounder"]
    docs, labels = [], []
    for i in range(n):
        text = ". ".join(" ".join(word() for _ in range(rng.randint(4, 12))) for _ in range(rng.randint(1, 8)))
        bad = rng.random() < 0.2
        if bad:
            text += ". you " + rng.choice(insults) + rng.choice(["", "!", "..."]) + " " + word()
        docs.append((i, text))
        labels.append((i, 1, int(bad)))
    return docs, labels


def test_held_out_accuracy_and_disguises(spark, docs_of):
    docs, labels = corpus()
    odd = [(5000, "you nit-wit now"), (5001, "so b.l.o.c.k.h.e.a.d it is"), (5002, "a z o u n d e r you"), (5003, None), (5004, ""), (5005, "th er on an " * 30_000), (5005, "th"), (None, "you nitwit")]
    frame = spark.createDataFrame(labels + [(1, 1, labels[1][2]), (7777, 0, 1), (None, 1, 1), (2, None, None)], "doc_id long, quality int, toxic int")
    got = toxic_documents(docs_of(docs + odd), frame).collect()
    assert len(got) == len(docs) + len(odd)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) and r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    truth = {i: t for i, _, t in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.98
    by = {r.doc_id: r for r in got}
    assert [by[i].predicted for i in (5000, 5001, 5002, None, 5003, 5004)] == [1, 1, 1, 1, 0, 0]


def test_held_out_labels_change_nothing(spark, docs_of):
    docs, labels = corpus(300)
    flipped = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in labels]
    one, two = (sorted(tuple(r) for r in toxic_documents(docs_of(docs), spark.createDataFrame(x, "doc_id long, quality int, toxic int")).collect()) for x in (labels, flipped))
    assert one == two


def test_no_labels(spark, docs_of):
    frame = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert [r.predicted for r in toxic_documents(docs_of([(1, "a"), (2, None)]), frame).collect()] == [0, 0]
    assert toxic_documents(docs_of([(1, "a")]).limit(0), frame.limit(0)).count() == 0
