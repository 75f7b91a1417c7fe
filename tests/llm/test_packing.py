import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from cairn.llm import packing
from cairn.llm.packing import assign, pack_documents, sequence_lengths, tokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")
THEIRS = Tokenizer.from_file(PATH)
ODD = ["", "a", "<|endoftext|> x", " " * 5000 + "x", "한글 and ½", "it's  we'll\n\n x\x1cz\x85", "word " * 3000, "é" * 900]


def test_same_ids_as_the_library():
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("abcé '!?19 \n\tñ’") for _ in range(200)) for _ in range(200)]
    for text in texts:
        assert tokenizer(PATH).ids(text).tolist() == THEIRS.encode(text, add_special_tokens=False).ids


def test_pieces(spark, docs_of, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_DOCUMENTS", 20)
    rows = [(i % 40, f"{ODD[i % 8]} {i}" if i % 9 else ODD[i % 8]) for i in range(120)] + [(None, None), (7, ""), (7, "")]
    got = pack_documents(docs_of(rows), PATH, length=256).collect()
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for pieces in by_sequence.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at and n > 0
            at += n
        assert at <= 256 and at & (at - 1) == 0  # no padding at all
    ids = {i: np.array([*THEIRS.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in enumerate([t for _, t in rows])}
    assert sum(r.length for r in got) == sum(map(len, ids.values()))
    # every piece's checksum is that of its document's ids there
    texts = defaultdict(list)
    for k, (i, _) in enumerate(rows):
        texts[i].append(ids[k])
    for r in got:
        assert any(len(x) == r.doc_tokens and zlib.crc32(x[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for x in texts[r.doc_id])
    whole = Counter((r.doc_id, r.doc_tokens) for r in got if r.start == 0)
    assert whole == Counter((i, len(ids[k])) for k, (i, _) in enumerate(rows))
    assert pack_documents(docs_of(rows).limit(0), PATH).count() == 0


def test_costs_are_balanced():
    rng = random.Random(2)
    lengths = [rng.randint(1, 255) for _ in range(400)]
    rooms = sequence_lengths(sum(lengths), 256)
    pieces = assign(lengths, rooms, 256)
    used, cost = Counter(), Counter()
    for _, _, n, s, _ in pieces:
        used[s] += n
        cost[s] += n + n * n / 256
    assert [used[s] for s in range(len(rooms))] == rooms
    full = [cost[s] for s in range(len(rooms)) if rooms[s] == 256]
    assert max(full) < 1.45 * sum(full) / len(full)
    assert len(pieces) <= len(lengths) + len(rooms)  # a cut fills a sequence


def test_table_smaller_than_a_sequence(spark, docs_of):
    got = pack_documents(docs_of([(1, "a few words"), (2, None)]), PATH).collect()
    assert sum(r.length for r in got) == len(THEIRS.encode("a few words").ids) + 2
    assert {r.doc_id for r in got} == {1, 2} and max(r.offset + r.length for r in got) < 2048
