import random
import re
from collections import Counter

import pytest

import corpus_pipeline
from cairn.llm._common import written
from tests.llm.test_near_dedup import brute_kept
from tests.llm.test_substring_dedup import brute_spans


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice(["th", "er", "on", "an", "re", "ti", "es", "ed"]) for _ in range(rng.randint(1, 5)))
    prose = lambda k: " ".join(word() + ("." if j % 8 == 7 else "") for j in range(k))
    passage = prose(60)
    out = [(i, prose(rng.randint(30, 200))) for i in range(150)]
    out += [(200 + i, out[i][1].replace(" ", "  \n" if i % 2 else " ", 3)) for i in range(20)]
    out += [(300 + i, re.sub(r"^\w+", "changed", out[i + 30][1])) for i in range(20)]
    out += [(400 + i, prose(40) + " " + passage + " " + prose(30)) for i in range(5)]
    out += [(500 + i, " ".join(w + "$$$" for w in prose(60).split())) for i in range(30)]
    return [*out, (3, out[3][1]), (600, None), (601, ""), (None, "a text whose id is null, and which has words of its own"), (700, "x" * 50_000)]


def test_stages(spark, docs_of, rows):
    docs = docs_of(rows)
    stages = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "exact_dedup", "near_dedup", "substring_dedup", "packing"]
    kept = written(stages["quality"](spark, docs, ""), "t")
    got = {(r.doc_id, r.text) for r in kept.collect()}
    assert not any((r.doc_id or 0) in range(500, 530) for r in kept.collect()) and len([i for i, _ in got if i is not None and i < 500]) >= 193
    assert kept.columns == docs.columns

    exact = written(stages["exact_dedup"](spark, docs, ""), "t")
    low = {}
    for i, t in rows:
        k = re.sub("[\x20\x09-\x0d]+", " ", t or "")
        low[k] = min([x for x in (low.get(k, i), i) if x is not None], default=None) if None not in (low.get(k, i), i) else None
    assert Counter((r.doc_id, re.sub("[\x20\x09-\x0d]+", " ", r.text or "")) for r in exact.collect()) == Counter((i, k) for k, i in low.items())
    assert exact.columns == docs.columns

    numbered = [(i, t) for i, t in rows if i is not None]
    near = stages["near_dedup"](spark, docs_of(numbered), "").collect()
    assert sorted(r.doc_id for r in near) == brute_kept(numbered)

    cut = stages["substring_dedup"](spark, exact, "")
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert len(texts) == exact.count() and all(len(texts[400 + i]) < len(dict(rows)[400 + i]) - 200 for i in range(5))
    assert cut.columns == docs.columns
    kept_rows = [(r.doc_id, r.text) for r in exact.collect()]
    for (i, t), spans in zip(kept_rows, brute_spans([t for _, t in kept_rows], 200), strict=True):
        data = t.encode() if t else b""
        assert texts[i] == b"".join(data[a:b] for a, b in zip([0, *[h for _, h in spans]], [*[w for w, _ in spans], len(data)], strict=True)).decode("utf-8", "ignore")


def test_whole_run_and_empty_stages(spark, docs_of, rows, tmp_path):
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(got.columns) and got.count() > 100
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs_of(rows).limit(0), "").count() == 0
