"""Near-duplicates by SimHash and deletion variants at a Jaccard similarity of 0.8 of five-word shingle sets.

``simhash`` links 64-bit fingerprints within two bits. Sets at a similarity of 0.8 differ in about 15 % of a SimHash's
bits, so here a fingerprint is longer, and so many segments are cut from it that one of them differs by one bit at
most: 43 of 16 bits for up to a million texts, longer and more ones beyond (``segments_of``). The chance is 1 - (1 - 0.2785)^43
= 0.999999 at 0.8, more above, and 0.9997 for sets of four and five shingles, whose bits differ most. Segments meet by
equality, as they are or with one bit taken out. A row moves twice a segment: a variant keeps one half of its
segment whole, so rows are dealt by either half, and the variants of the other half are made inside the task. Of what meets,
pairs whose first 128 bits, which are no segment's, differ in over 42 are dropped, and pairs whose first 256 bits
differ by 4.5 standard deviations more than such pairs do or whose sets' sizes rule 0.8 out, all inside the task. The whole
fingerprints rule out more in the same way; all others are verified on the two sets themselves, so no link is below the bound.

Texts of which many meet (a family of near copies) aren't compared pair by pair at first: each text meets a few others,
such as the one nearest to the bits that most have, as the original of a family is. What the links so found
leave in different components is compared in blocks within tasks by 2048 more bits of SimHash, under short pieces of these,
again so many that one is the same. Pairs that differ in few enough bits (99.9 % of pairs at 0.8 do), each under one piece, don't
leave the task either: the texts that are in any have their sets sent to the same blocks, which verify there and only give links
that join components. So a loose family costs comparisons in the tasks, but not rows, by the square of its size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm._common import _ARROW, _kinds, by_batch, lean, sieved, text_key, text_or_empty, written
from cairn.llm.components import components
from cairn.llm.simhash import without_copies

Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]

#: Words in a shingle.
WIDTH = 5
#: A bit of the SimHashes of two sets at 0.8 differs with this chance, and at least one of the segments must
#: meet but for a chance of e^-MISSED.
DIFFERS, MISSED = 0.1515, 14
#: That chance for sets of fewer than SMALL shingles; standard deviations beyond it that whole fingerprints may differ.
SMALL, SMALL_DIFFERS, BEYOND = 6, 0.19, 4.5
#: Texts for each value of a segment that its length allows for, and the shortest one.
OCCUPIED, SHORTEST = 16, 16
#: Words of 64 bits that belong to no segment, and how many of their bits may differ.
CHECK, CHECK_DIFFERS = 2, 42
#: Words of a fingerprint that go with every segment, those first, so that few pairs that can't be similar leave a task.
CARRIED = 4
#: Texts of one value of a segment that are compared pair by pair, and those that a text meets under a key before it is in a family;
#: and the segments under which pairs within a family are made.
PAIRED, MET, LINKED = 64, 3, 4
#: Words of a sketch, those that are looked at first, and how many bits of either may differ; in a set of fewer than SMALL.
SKETCH, GLANCE = 32, 4
SKETCH_DIFFERS, GLANCE_DIFFERS = 360, 61
SMALL_SKETCH_DIFFERS, SMALL_GLANCE_DIFFERS = 440, 72
#: Texts of families for each value of a piece of a sketch that its length allows for, the shortest and longest one,
#: and as MISSED for pieces.
CROWD, PIECES, PIECES_MISSED = 512, (4, 14), 10
#: Texts of a block that are held against the others, and comparisons that a task makes at most.
HELD, COMPARED = 20_000, 50_000_000
#: Bytes of sets that a block holds, and that pass by at once.
HELD_BYTES = 1 << 23
#: Rows of whole keys that a task joins at once, pairs of them, and pairs whose carried words are looked at together.
ROWS, AT_ONCE, LOOKED_AT = 50_000, 2_000_000, 1 << 18
_FACTORS, _TERMS = np.random.default_rng(5).integers(0, 1 << 64, (2, 256), np.uint64)
_FACTORS |= np.uint64(1)
_MORE = np.random.default_rng(7).integers(0, 1 << 64, (2, SKETCH), np.uint64)
_MORE[0] |= np.uint64(1)


def shingles(text: str) -> np.ndarray:
    """The distinct hashes of a text's shingles, in order; none without words.

    Words are as in ``simhash.fingerprint``; fewer words than WIDTH make one shingle."""
    words = text.encode("utf-8").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= WIDTH:
        return np.array([digest(joined, 42)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts, view = (ends - sizes + 1).tolist(), memoryview(joined)
    hashes = [digest(view[s:e], 42) for s, e in zip(starts, ends[WIDTH - 1 :].tolist(), strict=False)]
    return np.unique(np.fromiter(hashes, np.uint64, len(hashes)))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def simhash(found: np.ndarray, factors: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """A set's SimHash, 64 bits for each of the factors; zero for no shingles.

    A bit is set where more than half of the shingles' hashes have it, as in ``simhash.fingerprint``."""
    counts = np.zeros(64 * len(factors), np.int64)
    for at in range(0, len(found), 255):
        octets = _mixed(found[at : at + 255, None] * factors + terms).view(np.uint8)
        counts += np.add.reduce(np.unpackbits(octets, axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * counts > len(found), bitorder="little").view("<u8")


def segments_of(n: int) -> tuple[int, int]:
    """The length and number of segments for ``n`` texts."""
    length = SHORTEST
    while length < 32 and n > OCCUPIED << length:
        length += 2
    same = 1 - DIFFERS
    meets = same**length + length * DIFFERS * same ** (length - 1)
    return length, int(np.ceil(-MISSED / np.log1p(-meets)))


def words_of(length: int, count: int) -> int:
    return CHECK + -(-length * count // 64)


def places(prints: np.ndarray, length: int, count: int) -> np.ndarray:
    """For each fingerprint (a row of words) two longs a segment: the number of segment and half, that half, the other half."""
    bits = np.unpackbits(np.ascontiguousarray(prints[:, CHECK:]).view(np.uint8), axis=1, bitorder="little")[:, : length * count]
    value = bits.reshape(-1, count, length).astype(np.int64) @ (1 << np.arange(length, dtype=np.int64))
    half = length // 2
    turned = ((value & ((1 << half) - 1)) << half) | (value >> half)
    return (np.arange(2 * count) << 32) | np.stack([value, turned], axis=2).reshape(-1, 2 * count)


def pieces_of(n: int) -> tuple[int, int]:
    """The length and number of a sketch's pieces for ``n`` texts of families."""
    length = PIECES[0]
    while length < PIECES[1] and n > CROWD << length:
        length += 1
    return length, int(np.ceil(-PIECES_MISSED / np.log1p(-((1 - DIFFERS) ** length))))


def pieces(marks: np.ndarray, length: int, count: int) -> np.ndarray:
    """For each sketch (a row of words) a long a piece: its number and its bits."""
    bits = np.unpackbits(np.ascontiguousarray(marks).view(np.uint8), axis=1, bitorder="little")[:, : length * count]
    return (np.arange(count) << 32) | bits.reshape(-1, count, length).astype(np.int64) @ (1 << np.arange(length, dtype=np.int64))


def _differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _sizes_allow(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Where sets of n and m shingles may have a Jaccard similarity of 0.8 or more."""
    return 5 * np.minimum(n, m) >= 4 * np.maximum(n, m)


def _bits_allow(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Where words of the fingerprints of sets of n and m shingles don't rule out 0.8."""

    def most(chance: float) -> float:
        bits = 64 * a.shape[1]
        return bits * chance + BEYOND * (bits * chance * (1 - chance)) ** 0.5

    return _differing(a, b) <= np.where(np.minimum(n, m) < SMALL, most(SMALL_DIFFERS), most(DIFFERS))


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets, not both empty, have a Jaccard similarity of 0.8 or more."""
    if not _sizes_allow(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 9 * both >= 4 * (len(a) + len(b))


def _signed(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, key (the text's digest), node (the digest of its set of shingles), n (its shingles), print (its SimHash)."""

    def rows(batch: dict[str, list]) -> dict[str, list]:
        sets = [shingles(t) for t in batch["text"]]
        nodes = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
        prints = [simhash(s, _FACTORS[:words], _TERMS[:words]).tobytes() for s in sets]
        return {"doc_id": batch["doc_id"], "key": batch["key"], "node": pa.array(nodes), "n": [len(s) for s in sets], "print": prints}

    chosen = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"), text_key().alias("key"))
    return by_batch(chosen, "doc_id long, key binary, node long, n long, print binary", rows)


def _words(prints: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(prints), np.uint64).reshape(len(prints), -1)


_CARRIED = [f"w{k}" for k in range(CARRIED)]


def _spread(length: int, count: int) -> Batches:
    """Rows (place, node, n, w0 and so on: the carried words) from rows (node, n, print)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                prints = _words(part.column(2).to_pylist())
                again = [np.repeat(c, 2 * count) for c in (part.column(0).to_numpy(), part.column(1).to_numpy(), *prints[:, :CARRIED].view(np.int64).T)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (places(prints, length, count).ravel(), *again)], names=["place", "node", "n", *_CARRIED])

    return lean(run)


def _products(x: np.ndarray, nx: np.ndarray, y: np.ndarray, ny: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows of runs that start at x and y and have nx and ny rows, some at once."""
    ends = np.cumsum(nx * ny)
    cuts = np.unique(np.searchsorted(ends, np.arange(AT_ONCE, ends[-1] + AT_ONCE, AT_ONCE), "left") + 1) if len(ends) else []
    for a, b in zip([0, *cuts], cuts, strict=False):
        n = (nx * ny)[a:b]
        k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        wide = np.repeat(ny[a:b], n)
        yield np.repeat(x[a:b], n) + k // wide, np.repeat(y[a:b], n) + k % wide


def joined(place: np.ndarray, node: np.ndarray, words: np.ndarray, length: int, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """u, v: rows of one segment, equal or with one bit taken out, whose checks agree; and the nodes of families, of
    which not all pairs are made. Rows are in the order of places and hold whole halves.

    ``words`` are the check and, with ``n`` (the sets' sizes), the other carried words; then neither they nor the sizes
    rule a pair out. Equal segments meet under their first half only, others under the half that doesn't differ."""
    check = words[:, :CHECK]
    start = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, np.int64)
    value, size = place[start], np.diff(np.concatenate([start, [len(place)]]))
    left, right, crowded = [], [], np.zeros(len(place), bool)

    def meet(a: np.ndarray, b: np.ndarray) -> None:
        good = np.flatnonzero((node[a] != node[b]) & (_differing(check[a], check[b]) <= CHECK_DIFFERS))
        if n is not None:
            good = good[_sizes_allow(n[a[good]], n[b[good]])]
            parts = [good[at : at + LOOKED_AT] for at in range(0, len(good), LOOKED_AT)]
            good = np.concatenate([good[:0], *(g[_bits_allow(words[a[g]], words[b[g]], n[a[g]], n[b[g]])] for g in parts)])
        left.append(a[good])
        right.append(b[good])

    def star(a: np.ndarray, b: np.ndarray) -> None:
        """A few rows of the many b for each of a: the one nearest to the bits that most of b have, and that of the least node."""
        crowded[a] = crowded[b] = True
        if place[a[0]] >> 33 >= LINKED:
            return
        most = np.packbits(2 * np.unpackbits(check[b].view(np.uint8), axis=1).sum(axis=0, dtype=np.int64) > len(b)).view(np.uint64)
        for pivot in {int(b[_differing(check[b], most).argmin()]), int(b[node[b].argmin()])}:
            meet(a, np.full(len(a), pivot))

    first = (value >> 32) % 2 == 0
    own = np.flatnonzero(first & (size > 1) & (size <= PAIRED))
    for a, b in _products(start[own], size[own], start[own], size[own]):
        meet(a[a < b], b[a < b])
    for k in np.flatnonzero(first & (size > PAIRED)):
        rows = np.arange(start[k], start[k] + size[k])
        star(rows, rows)
    for bit in range(length // 2):
        low = np.flatnonzero((value >> bit) & 1 == 0)
        at = np.searchsorted(value, value[low] | (1 << bit))
        there = (at < len(value)) & (value[np.minimum(at, len(value) - 1)] == value[low] | (1 << bit))
        x, y = low[there], at[there]
        few = size[x] * size[y] <= PAIRED * PAIRED
        for a, b in _products(start[x[few]], size[x[few]], start[y[few]], size[y[few]]):
            meet(a, b)
        for i, k in zip(x[~few], y[~few], strict=True):
            i, k = sorted((i, k), key=size.__getitem__)
            star(np.arange(start[i], start[i] + size[i]), np.arange(start[k], start[k] + size[k]))

    a, b = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (left, right))
    crowded |= np.bincount(a, minlength=len(place)) + np.bincount(b, minlength=len(place)) > MET
    family = crowded[a] & crowded[b]
    # of the pairs within a family each row's nearest one under some segments
    some = np.flatnonzero(family & (place[a] >> 33 < LINKED))
    one, near = np.concatenate([a[some], b[some]]), _differing(check[a[some]], check[b[some]])
    ranked = np.lexsort((np.tile(near, 2), one))
    best = ranked[np.diff(one[ranked], prepend=-1) != 0]
    kept = np.unique(np.concatenate([np.flatnonzero(~family), np.tile(some, 2)[best]]))
    return node[a[kept]], node[b[kept]], np.unique(node[crowded])


def _meet(length: int) -> Batches:
    """``joined`` of rows (place, node, n, w0 and so on) in the order of places: u, v, and the nodes of families as u alone."""

    def out(held: list[np.ndarray]) -> pa.RecordBatch:
        u, v, family = joined(held[0], held[1], np.stack(held[3:], axis=1).view(np.uint64), length, held[2])
        columns = [pa.array(np.concatenate([u, family])), pa.concat_arrays([pa.array(v), pa.nulls(len(family), pa.int64())])]
        return pa.RecordBatch.from_arrays(columns, names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [[np.zeros(0, np.int64)] for _ in range(3 + CARRIED)]
        n = 0
        for batch in batches:
            for at, column in zip(held, batch.columns, strict=True):
                at.append(column.to_numpy())
            n += batch.num_rows
            if n >= ROWS:
                rows = [np.concatenate(c) for c in held]
                half = rows[0] >> (length // 2)
                last = int(np.searchsorted(half, half[-1]))  # the last half may go on in the next batch
                if last:
                    yield out([c[:last] for c in rows])
                held, n = [[c[last:].copy()] for c in rows], n - last
        yield out([np.concatenate(c) for c in held])

    return lean(run)


def _sets(docs: DataFrame, nodes: DataFrame, met: DataFrame) -> DataFrame:
    """node, found (hashes of its shingles) of all nodes of ``met`` (u, v); ``nodes`` (node, key) tells a text of each."""

    def sets_of(batch: dict[str, list]) -> dict[str, list]:
        return {"node": batch["node"], "found": [shingles(t).tobytes() for t in batch["text"]]}

    some = met.select(F.explode(F.array("u", "v")).alias("node")).where("node IS NOT NULL").distinct()
    wanted = written(nodes.select("node", "key").join(some, "node"), "near-candidates")
    texts = sieved(docs.select(text_or_empty().alias("text"), text_key().alias("key")), "key", wanted).join(wanted, "key").select("node", "text")
    return written(by_batch(texts.dropDuplicates(["node"]), "node long, found binary", sets_of), "near-sets")


def _likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The ``pairs`` (u, v) that sizes of sets and whole fingerprints don't rule out."""

    def check(batch: dict[str, list]) -> dict[str, list]:
        n, m, a, b = np.array(batch["n"]), np.array(batch["m"]), _words(batch["a"]), _words(batch["b"])
        at = np.flatnonzero(_sizes_allow(n, m) & _bits_allow(a, b, n, m))
        return {k: [batch[k][i] for i in at] for k in ("u", "v")}

    left = pairs.join(nodes.select(F.col("node").alias("u"), "n", F.col("print").alias("a")), "u")
    both = left.join(nodes.select(F.col("node").alias("v"), F.col("n").alias("m"), F.col("print").alias("b")), "v").select("u", "v", "n", "m", "a", "b")
    return written(by_batch(both, "u long, v long", check), "near-likely")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The ``pairs`` (u, v) whose sets are similar."""

    def check(batch: dict[str, list]) -> dict[str, list]:
        at = [i for i, (a, b) in enumerate(zip(batch["a"], batch["b"], strict=True)) if similar(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64))]
        return {k: [batch[k][i] for i in at] for k in ("u", "v")}

    left = pairs.join(sets.withColumnsRenamed({"node": "u", "found": "a"}), "u")
    both = left.join(sets.withColumnsRenamed({"node": "v", "found": "b"}), "v").select("u", "v", "a", "b")
    return written(by_batch(both, "u long, v long", check), "near-links")


#: Rows of blocks: of the texts that are held (role 0) and of those that pass by (role 1).
_BLOCK = "band long, c int, s int, h int, role int, node long, root long, apart boolean"
Block = tuple[int, int, int, int]
#: What a block does with the texts that it holds and some of those that pass by; the last is its own while it lasts.
Settle = Callable[[Block, tuple, tuple, dict], list[tuple]]


def _crossing_in(band: int, here: tuple, passing: tuple) -> Iterator[tuple[int, np.ndarray]]:
    """For the places of texts in ``here`` the places in ``passing`` of texts of other components that may well be similar,
    each pair in one block. Both are columns node, root, apart, n, bands, sketch."""
    v_node, v_root, v_apart, v_n, v_bands, v_marks = passing[:6]
    for i, (node, root, _, n, bands, marks) in enumerate(zip(*here[:6], strict=True)):
        # two texts that stand apart meet once
        open_ = np.flatnonzero((v_root != root) & (~v_apart | (v_node > node)) & _sizes_allow(v_n, n))
        tiny = np.minimum(v_n[open_], n) < SMALL
        open_ = open_[_differing(v_marks[open_, :GLANCE], marks[:GLANCE]) <= np.where(tiny, SMALL_GLANCE_DIFFERS, GLANCE_DIFFERS)]
        tiny = np.minimum(v_n[open_], n) < SMALL
        open_ = open_[_differing(v_marks[open_], marks) <= np.where(tiny, SMALL_SKETCH_DIFFERS, SKETCH_DIFFERS)]
        if len(open_):  # under the first band that both share
            first = (v_bands[open_] == bands).argmax(axis=1)
            open_ = open_[bands[first] == band]
        if len(open_):
            yield i, open_


def _who_cross(block: Block, here: tuple, passing: tuple, told: dict) -> list[tuple]:
    """The rows of a block's texts that ``_crossing_in`` gives partners, each once."""
    theirs = np.zeros(len(passing[0]), bool)
    mine = set()
    for i, open_ in _crossing_in(block[0], here, passing):
        mine.add(i)
        theirs[open_] = True
    new = sorted(mine - told.keys())
    told.update(dict.fromkeys(new))
    row = lambda role, of, k: (*block, role, int(of[0][k]), int(of[1][k]), bool(of[2][k]))
    return [row(0, here, i) for i in new] + [row(1, passing, int(k)) for k in np.flatnonzero(theirs)]


def _links_across(block: Block, here: tuple, passing: tuple, parent: dict) -> list[tuple]:
    """Verified links (u, v) that join all components which similar texts of a block join: one less than these at most."""

    def top(root: int) -> int:
        while (up := parent.get(root, root)) != root:
            parent[root] = parent.get(up, up)
            root = up
        return root

    out = []
    for i, open_ in _crossing_in(block[0], here, passing):
        for k in open_.tolist():
            a, b = top(int(here[1][i])), top(int(passing[1][k]))
            if a != b and similar(here[6][i], passing[6][k]):
                parent[max(a, b)] = min(a, b)
                out.append((int(here[0][i]), int(passing[0][k])))
    return out


def _blocks(length: int, count: int, schema: str, settle: Settle) -> Batches:
    """Rows of ``settle`` from rows (those of _BLOCK, n, sketch, found or null) in the order of blocks and roles."""
    names = [c.strip().split(" ")[0] for c in schema.split(",")]

    def columns(rows: list[tuple]) -> tuple:
        node, root, apart, n, marks, found = zip(*rows, strict=True)
        sketches = _words(marks)
        sets = [None if f is None else np.frombuffer(f, np.uint64) for f in found]
        return np.array(node), np.array(root), np.array(apart), np.array(n), pieces(sketches, length, count), sketches, sets

    def settled(block: Block, here: tuple | None, passing: list[tuple], own: dict) -> pa.RecordBatch:
        out = settle(block, here, columns(passing), own) if here else []
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], _ARROW[kind]) for k, kind in enumerate(_kinds(schema))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, here, passing, size, own = None, [], None, [], 0, {}
        parts = (batch.slice(at, 1024) for batch in batches for at in range(0, batch.num_rows, 1024))
        for part in parts:
            for *now, role, node, root, apart, n, marks, found in zip(*(col.to_pylist() for col in part.columns), strict=True):
                if tuple(now) != block:
                    if passing:
                        yield settled(block, here, passing, own)
                    block, held, here, passing, size, own = tuple(now), [], None, [], 0, {}
                row = (node, root, apart, n, marks, found)
                if role == 0:
                    held.append(row)
                    continue
                if held:
                    here, held = columns(held), []
                passing.append(row)
                size += len(found or b"")
                if len(passing) == 512 or size >= HELD_BYTES:
                    yield settled(block, here, passing, own)
                    passing, size = [], 0
        if passing:
            yield settled(block, here, passing, own)

    return lean(run)


def _bands(length: int, count: int) -> Batches:
    """Rows (band, node, root) from rows (node, root, sketch): a band is a piece of a sketch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bands = pieces(_words(batch.column(2).to_pylist()), length, count)
                again = [pa.array(np.repeat(batch.column(k).to_numpy(), count)) for k in range(2)]
                yield pa.RecordBatch.from_arrays([pa.array(bands.ravel()), *again], names=["band", "node", "root"])

    return lean(run)


def _crossing(family: DataFrame, sets: DataFrame, roots: DataFrame) -> DataFrame:
    """u, v: verified links that join all components which similar texts of ``family`` (node) join.

    Blocks first tell, by sketches, who meets a text of another component at all. The sets of these alone go to the same
    blocks, which verify inside the task and give no more links than join what they hold, however many pairs they look at."""

    def sketches(batch: dict[str, list]) -> dict[str, list]:
        found = [np.frombuffer(b, np.uint64) for b in batch["found"]]
        return {"node": batch["node"], "n": [len(s) for s in found], "sketch": [simhash(s, *_MORE).tobytes() for s in found]}

    def settled(rows: DataFrame, schema: str, settle: Settle) -> DataFrame:
        key = ["band", "c", "s", "h"]
        rows = rows.select(*key, "role", "node", "root", "apart", "n", "sketch", "found")
        return rows.repartition(*key).sortWithinPartitions(*key, "role").mapInArrow(_blocks(length, count, schema, settle), schema)

    length, count = pieces_of(family.count())
    marks = written(by_batch(sets.join(family, "node", "left_semi"), "node long, n long, sketch binary", sketches), "near-sketches")
    known = marks.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "sketch")
    rooted = written(known.mapInArrow(_bands(length, count), "band long, node long, root long"), "near-rooted")
    parts = rooted.groupBy("band", "root").agg(F.count("*").alias("n"))
    bands = parts.groupBy("band").agg(F.max(F.struct("n", "root"))["root"].alias("main"), F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("n_apart")).where("n_apart > 0")
    bands = bands.select("band", "main", F.expr(f"cast(ceil(n_apart / {HELD}) as int)").alias("cs"), F.expr(f"cast(ceil(n * least(n_apart, {HELD}) / {COMPARED}) as int)").alias("ss"))
    rows = written(rooted.join(written(bands, "near-open-bands"), "band").withColumn("apart", F.col("root") != F.col("main")), "near-open")
    every = lambda k: F.explode(F.sequence(F.lit(0), F.col(k) - 1))
    own = lambda k, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(k)).cast("int")
    held = rows.where("apart").select("band", own("cs", 1).alias("c"), every("ss").alias("s"), F.lit(0).alias("role"), "node", "root", "apart")
    passing = rows.select("band", every("cs").alias("c"), own("ss", 2).alias("s"), F.lit(1).alias("role"), "node", "root", "apart")
    dealt = held.unionByName(passing).withColumn("h", F.lit(0)).join(marks, "node").withColumn("found", F.lit(None).cast("binary"))
    meet = written(settled(dealt, _BLOCK, _who_cross), "near-meet").drop("h").join(marks, "node")
    hs = meet.where("role = 0").groupBy("band", "c", "s").agg(F.expr(f"cast(ceil(sum(8 * n) / {HELD_BYTES}) as int)").alias("hs"))
    meet = meet.join(hs, ["band", "c", "s"])
    held = meet.where("role = 0").withColumn("h", own("hs", 3))
    passing = meet.where("role = 1").withColumn("h", every("hs"))
    return settled(held.unionByName(passing).join(sets, "node"), "u long, v long", _links_across)


def links(docs: DataFrame, signed: DataFrame, length: int, count: int) -> DataFrame:
    """u, v: verified links that connect all nodes which candidates at 0.8 or more connect."""
    nodes = written(signed.groupBy("node").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("print").alias("print")), "near-nodes")
    dealt = nodes.select("node", "n", "print").mapInArrow(_spread(length, count), "place long, node long, n long, " + ", ".join(f"{w} long" for w in _CARRIED))
    dealt = dealt.repartition(F.shiftright("place", length // 2)).sortWithinPartitions("place", "node")
    ordered = [F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")]
    met = written(dealt.mapInArrow(_meet(length), "u long, v long").select(ordered[0], F.when(F.col("v").isNotNull(), ordered[1]).alias("v")).distinct(), "near-met")
    family, pairs = met.where("v IS NULL"), _likely(met.where("v IS NOT NULL"), nodes)
    sets = _sets(docs, nodes, pairs.unionByName(family))
    found = _verified(pairs, sets)
    if family.isEmpty():
        return found
    return found.unionByName(written(_crossing(family.select(F.col("u").alias("node")), sets, components(found)).select(*ordered).distinct(), "near-crossed"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The row of the smallest doc_id of each component, with all columns as they are; of several rows
    of that id, the one whose text has the smallest digest.

    Rows are in one component if a chain of similar texts joins them. Texts without words are alike."""
    length, count = segments_of(docs.count())
    signed = written(_signed(docs, words_of(length, count)), "near-signed")
    roots = components(links(docs, signed, length, count))
    found = signed.drop("n", "print").join(roots, "node", "left").select("doc_id", "key", F.coalesce("root", "node").alias("root"))
    return without_copies(docs, written(found, "near-groups"))
