import hashlib

import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cairn.llm.bpe import WordBpe, encode_digests

PATH = public_tokenizers.path("word_bpe_49k.json")
OURS, THEIRS = WordBpe(PATH), Tokenizer.from_file(PATH)
ODD = ["", "  ", "a\x1cb c\x1d d", "ΑΣ ΟΔΟΣ", "İstanbul", "<|endoftext|> hi<|startoftext|>x", "école 한글 ½ ²", "it's we'LL x\u0085z", "🤣🤣 !!!", "a" * 3000, "﻿x​y", "i̇ ǅ ﬁ", "_a_ __ 1234"]


def same(text):
    ids = THEIRS.encode(text, add_special_tokens=False).ids
    assert OURS.encode(text) == ids
    assert OURS.encode_pairs(text)[1] == OURS.decode(ids) == THEIRS.decode(ids, skip_special_tokens=False)


def test_odd_texts():
    for text in ODD:
        same(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("abcdeéßΣσ '!?.019 \n\tñth"), max_size=60))
def test_same_as_the_library(text):
    same(text)


def test_query_rows(spark, docs_of):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(3, "twice"), (3, "twice"), (None, None)]
    got = sorted((tuple(r) for r in encode_digests(docs_of(rows), PATH).collect()), key=str)

    def want(i, text):
        ids = THEIRS.encode(text or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        return i, len(ids), sha(" ".join(map(str, ids))), sha(THEIRS.decode(ids, skip_special_tokens=False))

    assert got == sorted((want(i, t) for i, t in rows), key=str)
    assert encode_digests(docs_of(rows).limit(0), PATH).count() == 0
