import random
import re
from collections import Counter

from cairn.llm.quality_rules import BASE, CURRENT, POLICIES, RULES, ablation, judged, ledger


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    m = {"n_words": len(words), "word_chars": sum(map(len, words)), "n_symbols": sum(text.count(c) for c in "#*$%&|<>"), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(hit)}
    upper, shout = sum(c.isupper() for c in text), text.count("!")
    bits = [m["n_words"] < 20, 100 * m["n_repeat_words"] > 30 * m["n_words"], 10 * m["n_symbols"] > m["n_words"], 2 * upper > m["word_chars"] and m["n_words"] >= 5, 100 * m["n_dup_lines"] > 40 * len(lines), m["word_chars"] > 15 * m["n_words"], 2 * shout > m["n_words"] and m["n_words"] >= 5]
    mask = sum(1 << r.bit for r, b in zip(RULES, bits, strict=True) if b)
    base = bool(mask & 3)
    return *m.values(), base, not base and not mask & CURRENT.mask, mask


def texts():
    rng = random.Random(1)
    prose = lambda k: " ".join(rng.choice("a bé the of Sentence words, long.word x".split()) + str(rng.randint(0, 99)) for _ in range(k))
    out = [prose(rng.randint(0, 60)) for _ in range(30)]
    line = prose(12)
    out += ["\n".join([line, prose(9), line, "  ", line, prose(30)]), "spam " * 100, "A B\x0bC\fD\r\nE\t", "ÉCRIRE TOUT EN MAJUSCULES " * 9 + prose(40), "$% " * 30 + prose(40), "wow!! " * 25 + prose(3), None, "", " \n\n ", "x" * 100_000, prose(20_000), " nbsp words " * 3, (prose(11) + " ") * 2, " ".join(map(str, range(7))), " ".join(map(str, range(8))) + " ", "日本 " * 30]
    return out


def test_against_brute_force(spark, docs_of):
    rows = [*enumerate(texts()), (1, "same id"), (None, "no id")]
    assert sorted((tuple(r) for r in judged(docs_of(rows)).collect()), key=str) == sorted(((i, *brute(t)) for i, t in rows), key=str)
    assert judged(docs_of(rows).limit(0)).count() == 0


def test_no_python_and_no_shuffle(spark, docs_of):
    plan = judged(docs_of([(1, "x")], 1))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Window" not in plan


def test_ablation(spark, docs_of):
    rows = list(enumerate(texts()))
    masks = [brute(t)[-1] for _, t in rows]
    for policy in POLICIES.values():
        got = {r.rule: r for r in ablation(ledger(docs_of(rows)), policy).collect()}
        assert set(got) == set(policy.rules)
        for r in RULES:
            if r.name in policy.rules:
                assert got[r.name].failed == sum(m >> r.bit & 1 for m in masks)
                assert got[r.name].alone == sum(m & policy.mask == 1 << r.bit for m in masks)
                assert got[r.name].rejected == sum(m & policy.mask != 0 for m in masks)
    assert BASE.mask == 3 and ablation(ledger(docs_of(rows).limit(0)), BASE).first().documents == 0
