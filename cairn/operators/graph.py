"""Operators on object graphs: dominators, retained sizes, forests, descent.

A graph is three tables: nodes (obj_id, shallow, class_row, repr_row), edges (src, dst) and roots (obj_id). The
virtual root that all roots hang from is -1; unreachable nodes have no immediate dominator (null).

Only immediate dominators are kept, no paths, so a tree of any depth costs the same for each node. What depends
on whole paths (depth, retained size, numbering) is found by pointer doubling: each round, a node's sums take in those of
the nodes 2^k below it and its pointer moves 2^k up, so a chain of a million nodes takes twenty rounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.plans.tables import by_real_size, written

VROOT = -1
#: Where pointers end that don't lead to a root.
DEAD = -2
#: Parts that the children of one node, or the nodes of one class, are numbered in, so that no task sorts them all.
PARTS = 1024
#: Numbers of the tree in a block are 2 to this power; what lies between blocks is looked up in a table of blocks.
BLOCK_BITS = 16
#: A table of so many ids at most is broadcast.
FEW = 200_000
#: So many children of one node are numbered by one task.
SIBLINGS = 1 << 20


def union_edges(*tables: DataFrame) -> DataFrame:
    """Distinct (src, dst) of several edge tables; edges from or to nothing are dropped."""
    out = tables[0].select("src", "dst")
    for t in tables[1:]:
        out = out.unionByName(t.select("src", "dst"))
    return out.where("src IS NOT NULL AND dst IS NOT NULL").distinct()


def transposed(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def _between(rows: DataFrame, ends: DataFrame, *columns: str) -> DataFrame:
    """``rows`` whose ``columns`` are within the least and the greatest id that ``ends`` says: what is beyond needn't be exchanged."""
    least, greatest = ends.first()
    for c in columns:
        rows = rows.where(F.col(c).between(least, greatest))
    return rows


def _few(rows: DataFrame) -> DataFrame:
    """``rows``, a written table, to be broadcast if it is short: then what it is joined with isn't exchanged."""
    return F.broadcast(rows) if rows.count() <= FEW else rows


def immediate_dominators(edges: DataFrame, roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """obj_id, idom of reachable nodes with successors; and the edges (src, dst) that count.

    Roots hang from the virtual root, so edges into roots and loops change nothing and go first; that removes
    the edges of most hubs. A node with one predecessor is dominated by it. Only where a node with successors has
    several predecessors do the edges among such nodes go to the kernel. Nodes without successors dominate
    nothing: theirs is the nearest common dominator of their predecessors, found in the tree of the others.
    """
    starts = written(roots.select("obj_id").distinct(), "starts")
    live = edges.where("src != dst").select("src", "dst").join(_few(starts).withColumnRenamed("obj_id", "dst"), "dst", "left_anti")
    # both ends of an edge meet in one exchange: what leads to a node, and whether it leads anywhere
    ends = live.select(F.col("dst").alias("obj_id"), "src", F.lit(False).alias("inner")).unionByName(live.select(F.col("src").alias("obj_id"), F.lit(None).cast("long").alias("src"), F.lit(True).alias("inner")))
    ends = _between(ends, live.agg(F.min("src"), F.max("src")), "obj_id")
    before = ends.groupBy("obj_id").agg(F.min("src").alias("src"), F.max("src").alias("other"), F.max("inner").alias("inner"))
    inner = written(before.where("inner AND src IS NOT NULL").drop("inner"), "predecessors")
    if inner.where("src != other").isEmpty():
        hung = inner.select("obj_id", F.col("src").alias("idom"))
    else:
        hung = kernel_dominators(live.join(inner.select(F.col("obj_id").alias("dst")), "dst", "left_semi"), starts)
    hung = written(hung.unionByName(starts.select("obj_id", F.lit(VROOT).cast("long").alias("idom"))), "inner-dominators")
    return hung, live


def kernel_dominators(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """obj_id, idom of nodes behind ``starts``: one task holds the edges among nodes with successors, whose number is its
    limit (some 250 bytes each), and finds semidominators and nearest common ancestors."""

    def run(rows: pa.Table) -> pa.Table:
        src, dst = rows.column("src").to_numpy(), rows.column("dst").to_numpy()
        ids, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
        s, d = at[: len(src)], at[len(src) :]
        top = int(np.searchsorted(ids, VROOT))
        order = np.argsort(s, kind="stable")
        begin = np.searchsorted(s[order], np.arange(len(ids) + 1))
        found = semidominators(begin.tolist(), d[order].tolist(), top)
        nodes = np.fromiter((v for v in range(len(ids)) if found[v] >= 0 and v != top), np.int64)
        doms = np.fromiter((found[v] for v in nodes.tolist()), np.int64, len(nodes))
        return pa.table({"obj_id": pa.array(ids[nodes]), "idom": pa.array(ids[doms] if len(doms) else doms)})

    both = edges.select("src", "dst").unionByName(starts.select(F.lit(VROOT).cast("long").alias("src"), F.col("obj_id").alias("dst")))
    found = written(both.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(run, "obj_id long, idom long"), "kernel")
    return found.join(starts, "obj_id", "left_anti")


def semidominators(begin: list[int], after: list[int], top: int) -> list[int]:
    """For nodes 0 to n - 1, of which v's successors are after[begin[v]:begin[v + 1]]: the immediate dominator, -1
    where ``top`` doesn't lead. Ancestors are shortened on the way, as in the simple form of the published method."""
    n = len(begin) - 1
    number, parent, order = [-1] * n, [-1] * n, []  # by depth first
    todo = [(top, -1)]
    while todo:
        v, p = todo.pop()
        if number[v] < 0:
            number[v], parent[v] = len(order), p
            order.append(v)
            todo += [(w, v) for w in reversed(after[begin[v] : begin[v + 1]]) if number[w] < 0]
    # from here on nodes go by their depth-first numbers
    m = len(order)
    up = [0] + [number[parent[v]] for v in order[1:]]
    before: list[list[int]] = [[] for _ in range(m)]
    for k, v in enumerate(order):
        for w in after[begin[v] : begin[v + 1]]:
            before[number[w]].append(k)
    semi, label, above = list(range(m)), list(range(m)), [-1] * m
    for w in range(m - 1, 0, -1):
        least = w
        for v in before[w]:
            if above[v] < 0:
                least = min(least, semi[v])
                continue
            way = []
            x = v
            while above[above[x]] >= 0:
                way.append(x)
                x = above[x]
            for y in reversed(way):
                a = above[y]
                if semi[label[a]] < semi[label[y]]:
                    label[y] = label[a]
                above[y] = above[a]
            least = min(least, semi[label[v]])
        semi[w] = least
        above[w] = up[w]
    idom = up
    for w in range(1, m):
        d = idom[w]
        while d > semi[w]:
            d = idom[d]
        idom[w] = d
    out = [-1] * n
    for k in range(m):
        out[order[k]] = order[idom[k]]
    return out


def immediate_dominators_of(roots: list[int], edges: list[tuple[int, int]]) -> dict[int, int]:
    """Immediate dominators of the nodes reachable from roots, all held in memory."""
    ids = sorted({VROOT, *roots, *(x for e in edges for x in e)})
    at = {v: k for k, v in enumerate(ids)}
    after: list[list[int]] = [[] for _ in ids]
    for a, b in [*((VROOT, r) for r in roots), *edges]:
        after[at[a]].append(at[b])
    begin = np.concatenate([[0], np.cumsum([len(x) for x in after])]).tolist()
    found = semidominators(begin, [w for x in after for w in x], at[VROOT])
    return {ids[v]: ids[d] for v, d in enumerate(found) if d >= 0 and ids[v] != VROOT}


def _doubled(rows: DataFrame, sums: list[str], along: list[str], name: str) -> tuple[DataFrame, list[DataFrame]]:
    """``rows`` (obj_id, up, measures) with ``sums`` added up over all below and ``along`` added up over the way to the
    top, and the tables of each round before. At last ``up`` says where the way ends: VROOT, or DEAD.

    Nodes that nothing hangs from are most of a broad tree: they are added to what they hang from first and told the
    end of its way at last, and only the others are in the rounds' tables. Rings of nodes that nothing leads into have
    no end; they are given up when no chain could be as long."""
    columns = rows.columns
    below = rows.groupBy(F.col("up").alias("obj_id")).agg(F.count("*").alias("hanging"))
    rows = written(rows.join(below, "obj_id", "left"), name)
    tips, rows = rows.where("hanging IS NULL").select(*columns), rows.where("hanging IS NOT NULL").select(*columns)
    if sums:
        more = tips.groupBy(F.col("up").alias("obj_id")).agg(*[F.sum(c).alias(f"more_{c}") for c in sums])
        added = {c: (F.col(c) + F.coalesce(f"more_{c}", F.lit(0))).alias(c) for c in sums}
        rows = rows.join(more, "obj_id", "left").select(*[added.get(c, F.col(c)) for c in columns])
    rows = written(rows, name)
    most, rounds = rows.count(), []
    ended = F.col("up").isin(VROOT, DEAD)
    moved = F.when(ended, F.col("up")).otherwise(F.coalesce("next", F.lit(DEAD)))
    while (1 << len(rounds)) <= 2 * most and not rows.where(~ended).isEmpty():
        rounds.append(rows)
        met = rows.join(_ways_on(rows, along), "up", "left")
        new = {c: F.col(c) + F.coalesce(f"over_{c}", F.lit(0)) for c in along}
        if sums:
            more = rows.where(~ended).groupBy(F.col("up").alias("obj_id")).agg(*[F.sum(c).alias(f"more_{c}") for c in sums])
            met = met.join(more, "obj_id", "left")
            new |= {c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in sums}
        rows = written(met.select(*[moved.alias("up") if c == "up" else new.get(c, F.col(c)).alias(c) for c in columns]), name)
    new = {c: F.col(c) + F.coalesce(f"over_{c}", F.lit(0)) for c in along}
    tips = tips.join(_ways_on(rows, along), "up", "left").select(*[moved.alias("up") if c == "up" else new.get(c, F.col(c)).alias(c) for c in columns])
    return written(rows.unionByName(tips), name), rounds


def _ways_on(rows: DataFrame, along: list[str]) -> DataFrame:
    return rows.select(F.col("obj_id").alias("up"), F.col("up").alias("next"), *[F.col(c).alias(f"over_{c}") for c in along])


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (obj_id, idom, size) with ahead: 1 and the sizes of the siblings before, added up in parts where they are many."""
    own = lambda *by: F.coalesce(F.sum("size").over(W.partitionBy(*by).orderBy("obj_id").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    if (rows.groupBy("idom").count().agg(F.max("count")).first()[0] or 0) <= SIBLINGS:
        return rows.withColumn("ahead", 1 + own("idom"))
    rows = rows.withColumn("part", F.pmod(F.xxhash64("obj_id"), F.lit(PARTS)))
    parts = rows.groupBy("idom", "part").agg(F.sum("size").alias("s"))
    before = parts.withColumn("parts_ahead", F.coalesce(F.sum("s").over(W.partitionBy("idom").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("s")
    return rows.withColumn("own_ahead", own("idom", "part")).join(before, ["idom", "part"]).withColumn("ahead", 1 + F.col("own_ahead") + F.col("parts_ahead")).drop("part", "own_ahead", "parts_ahead")


def _least_of_blocks(blocks: DataFrame) -> DataFrame:
    """level, block, least: of ``blocks`` (block, own; one for 2^BLOCK_BITS numbers) the least own of 2^level blocks from each on."""
    rows = sorted((r.block, tuple(r.own)) for r in blocks.collect())
    table, level = [], [own for _, own in rows]
    while level:
        table.append(level)
        half = 1 << (len(table) - 1)
        level = [min(level[i], level[i + half]) for i in range(len(level) - half)]
    flat = [(k, rows[0][0] + i, own) for k, level in enumerate(table) for i, own in enumerate(level)]
    return blocks.sparkSession.createDataFrame(flat, "level int, block long, least struct<depth: long, at: long, idom: long>")


def _nearest_common(ends: DataFrame, inner: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """dst, idom, at, depth for ``ends`` (dst, a, b: the least and the greatest number of what leads to it; a <= b): the nearest
    node of ``inner`` (obj_id, idom, depth, pre, pre_end, at) that is over or at both, its number, and the depth below it.

    Where a isn't over b, that node is the dominator of the least deep node numbered from a + 1 to b. If a and b are in
    different blocks of numbers, this is the least of a's block behind a, b's block up to b, and the blocks between. No
    key there is a node near the root, below which most may meet. Within a block, a goes up by 2^k while it isn't over b."""
    own = F.struct("depth", F.coalesce("at", F.lit(VROOT)).alias("at"), "idom")
    rows = inner.select("obj_id", "depth", "pre", "pre_end", F.shiftright("pre", BLOCK_BITS).alias("block"), own.alias("own"))
    within = W.partitionBy("block")
    behind = F.min("own").over(within.orderBy(F.desc("pre")).rowsBetween(W.unboundedPreceding, -1))
    rows = written(rows.withColumn("behind", behind).withColumn("upto", F.min("own").over(within.orderBy("pre").rowsBetween(W.unboundedPreceding, 0))), "tree-blocks")
    between = _least_of_blocks(rows.groupBy("block").agg(F.min("own").alias("own")))

    low = rows.select(F.col("pre").alias("a"), F.col("obj_id").alias("a_id"), F.col("depth").alias("a_depth"), "pre_end", "behind")
    at = ends.join(low, "a").join(rows.select(F.col("pre").alias("b"), "upto"), "b")
    at = at.withColumn("from_", F.shiftright("a", BLOCK_BITS) + 1).withColumn("to_", F.shiftright("b", BLOCK_BITS))
    level = (F.length(F.bin(F.col("to_") - F.col("from_"))) - 1).cast("int")
    at = at.withColumn("level", F.when((F.col("b") >= F.col("pre_end")) & (F.col("to_") > F.col("from_")), level))
    one = between.select("level", F.col("block").alias("from_"), F.col("least").alias("one"))
    two = between.select("level", (F.col("block") + F.expr("shiftleft(1L, level)")).alias("to_"), F.col("least").alias("two"))
    at = at.join(F.broadcast(one), ["level", "from_"], "left").join(F.broadcast(two), ["level", "to_"], "left")
    over, apart = F.col("b") < F.col("pre_end"), F.col("to_") >= F.col("from_")
    itself = F.struct((F.col("a_depth") + 1).alias("depth"), F.col("a").alias("at"), F.col("a_id").alias("idom"))
    found = F.when(over, itself).when(apart, F.least("behind", "upto", "one", "two"))
    met = written(at.select("dst", found.alias("f"), F.when(~over & ~apart, F.col("a_id")).alias("a"), F.when(~over & ~apart, F.col("b")).alias("b")), "leaf-meetings")

    done = met.where("a IS NULL").select("dst", "f.idom", F.when(F.col("f.at") != VROOT, F.col("f.at")).alias("at"), "f.depth")
    left = met.where("a IS NOT NULL").select("dst", "a", "b")
    spans = inner.select(F.col("obj_id").alias("up"), "pre", "pre_end")
    for table in [inner.select("obj_id", F.col("idom").alias("up")), *reversed(rounds)]:  # up by 1, then by 2^k, while still not over b
        jump = table.where(~F.col("up").isin(VROOT, DEAD)).select(F.col("obj_id").alias("a"), "up").join(spans, "up")
        beyond = F.col("up").isNotNull() & ~((F.col("pre") <= F.col("b")) & (F.col("b") < F.col("pre_end")))
        left = left.join(jump, "a", "left").select("dst", F.when(beyond, F.col("up")).otherwise(F.col("a")).alias("a"), "b")
    return done.unionByName(left.join(inner.select(F.col("obj_id").alias("a"), "idom", "at", "depth"), "a").select("dst", "idom", "at", "depth"))


def dominator_tree(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """``nodes`` with idom, depth, retained, below (objects it dominates, itself included), same_class, and at, pre,
    pre_end; all but same_class null where unreachable.

    same_class says that a proper dominator has the node's class, or is the class object of it. Nodes with
    successors are numbered in the tree's order: those that v dominates have ``pre`` from v's to below its pre_end; ``at``
    is the dominator's number. Nodes without successors have no numbers of their own.
    """
    hung, live = immediate_dominators(edges, roots)
    first = hung.select("obj_id", F.col("idom").alias("up"), "idom", F.lit(1).cast("long").alias("size"), F.lit(1).cast("long").alias("depth"))
    sized, rounds = _doubled(first, ["size"], ["depth"], "tree-sizes")
    inner = sized.where(F.col("up") == VROOT).select("obj_id", "idom", "size", "depth")
    ahead = F.col("ahead").cast("long")
    numbers, _ = _doubled(_numbered(inner).select("obj_id", F.col("idom").alias("up"), "idom", "size", "depth", ahead.alias("pre"), ahead.alias("ahead")), [], ["pre"], "tree-numbers")
    inner = numbers.select("obj_id", "idom", "depth", "pre", (F.col("pre") + F.col("size")).alias("pre_end"), F.when(F.col("idom") != VROOT, F.col("pre") - F.col("ahead")).alias("at"))

    # of a leaf's predecessors the first and the last in the tree's order say where all of them meet
    ends = live.join(inner.select(F.col("obj_id").alias("src"), "pre"), "src").groupBy("dst").agg(F.min("pre").alias("a"), F.max("pre").alias("b"))
    leaves = _nearest_common(ends.join(inner.select(F.col("obj_id").alias("dst")), "dst", "left_anti"), inner, rounds)
    none = F.lit(None).cast("long")
    leaves = leaves.withColumnRenamed("dst", "obj_id").withColumn("pre", none).withColumn("pre_end", none)
    columns = ["obj_id", "idom", "depth", "at", "pre", "pre_end"]  # what is joined to the nodes
    hanging = inner.select(*columns).unionByName(leaves.select(*columns))
    placed = written(nodes.join(hanging.withColumn("depth", F.col("depth").cast("int")), "obj_id", "left"), "placed-nodes")

    known = placed.where("idom IS NOT NULL").select("obj_id", "idom", "shallow", "class_row", "repr_row", "at", "pre", "pre_end")
    own = known.where("pre IS NOT NULL").select("obj_id", F.col("idom").alias("up"), "shallow")
    held = known.where("pre IS NULL").groupBy(F.col("idom").alias("obj_id")).agg(F.sum("shallow").alias("leaf_bytes"), F.count("*").alias("leaves"))
    start = own.join(held, "obj_id", "left").select("obj_id", "up", (F.col("shallow") + F.coalesce("leaf_bytes", F.lit(0))).alias("retained"), (1 + F.coalesce("leaves", F.lit(0))).alias("below"))
    sums, _ = _doubled(start, ["retained", "below"], [], "tree-sums")
    # a leaf of a class that spans nothing retains itself and is below nothing of its class, so it isn't exchanged again
    spanning = F.broadcast(_spans(known).select(F.col("cls").alias("class_row"), F.lit(True).alias("spanning")).distinct())
    out = placed.join(spanning, "class_row", "left").withColumn("asked", F.col("pre").isNotNull() | (F.col("at").isNotNull() & F.coalesce("spanning", F.lit(False)))).drop("spanning")
    asked = out.where("asked").join(sums.select("obj_id", "retained", "below"), "obj_id", "left").join(_below_own_class(known), "obj_id", "left")
    out = out.where("NOT asked").withColumn("retained", none).withColumn("below", none).withColumn("same_class", F.lit(False)).unionByName(asked).drop("asked")
    alive = F.col("idom").isNotNull()
    out = out.withColumn("retained", F.when(alive, F.coalesce("retained", "shallow"))).withColumn("below", F.when(alive, F.coalesce("below", F.lit(1))))
    out = out.withColumn("same_class", F.coalesce("same_class", F.lit(False)))
    return written(out.select(*placed.columns, "retained", "below", "same_class"), "tree")


def _spans(known: DataFrame) -> DataFrame:
    """cls, p, pre_end: the numbers below each node, for its class and for the class that it is the object of."""
    inner = known.where("pre IS NOT NULL")
    return inner.select(F.col("class_row").alias("cls"), F.col("pre").alias("p"), "pre_end").unionByName(inner.where("repr_row IS NOT NULL").select(F.col("repr_row").alias("cls"), F.col("pre").alias("p"), "pre_end"))


def _below_own_class(known: DataFrame) -> DataFrame:
    """obj_id, same_class (true) of nodes that a node of their class, or their class's object, dominates.

    Such a node's numbers span the dominator's: of each class, spans and places are put in order, and the furthest end
    so far tells. Each class is gone through in parts by number, which know the furthest end before them."""
    spans = _spans(known)
    classes = F.broadcast(spans.select("cls").distinct())  # as many as the heap has classes
    places = known.where("at IS NOT NULL").select(F.col("class_row").alias("cls"), F.col("at").alias("p"), F.col("obj_id").alias("id")).join(classes, "cls")
    rows = spans.withColumn("id", F.lit(None).cast("long")).unionByName(places.withColumn("pre_end", F.lit(None).cast("long")))
    rows = rows.withColumn("part", F.expr("p div 1048576"))
    ends = rows.groupBy("cls", "part").agg(F.max("pre_end").alias("far"))
    ends = ends.withColumn("carried", F.max("far").over(W.partitionBy("cls").orderBy("part").rowsBetween(W.unboundedPreceding, -1))).drop("far")
    within = F.max("pre_end").over(W.partitionBy("cls", "part").orderBy("p", F.col("id").isNotNull()).rowsBetween(W.unboundedPreceding, 0))
    far = rows.withColumn("within", within).join(ends, ["cls", "part"])
    return far.where("id IS NOT NULL AND greatest(within, carried) > p").select(F.col("id").alias("obj_id"), F.lit(True).alias("same_class"))


def children(tree: DataFrame) -> DataFrame:
    """idom, n_children, children_retained."""
    return tree.where("idom IS NOT NULL").groupBy("idom").agg(F.count("*").alias("n_children"), F.sum("retained").alias("children_retained"))


def unreachable_forest(tree: DataFrame, edges: DataFrame) -> DataFrame:
    """The dominator tree of what is unreachable, from nodes that no unreachable node refers to.

    A cycle that nothing leads into has no such node: its nodes hang from nothing and retain themselves."""
    dead = written(tree.where("idom IS NULL").select("obj_id", "class_row", "repr_row", "shallow"), "unreachable")
    ids = dead.select("obj_id")
    inside = _between(edges, ids.agg(F.min("obj_id"), F.max("obj_id")), "src", "dst")
    inside = inside.join(ids.withColumnRenamed("obj_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("obj_id", "dst"), "dst", "left_semi").where("src != dst")
    inside = written(inside.select("src", "dst").distinct(), "unreachable-edges")
    tops = ids.join(inside.select(F.col("dst").alias("obj_id")).distinct(), "obj_id", "left_anti")
    forest = dominator_tree(dead, inside, tops)
    return forest.withColumn("retained", F.coalesce("retained", "shallow"))


def merged_paths(tree: DataFrame, name: str = "class_name", depth: int = 30) -> DataFrame:
    """For reachable nodes: each way of up to ``depth`` class names from the virtual root, with the objects behind it.

    Nodes at one level and on one way are a node of a tree of names: each stands for all that it dominates, so
    only sums go on, level by level, and no object carries its path."""
    rows = written(tree.where(F.col("idom").isNotNull() & (F.col("depth") <= depth)).select("obj_id", "idom", "depth", F.col(name).alias("label"), "below", "retained"), "way-nodes")
    at = rows.where("depth = 1").select("obj_id", F.col("label").alias("path"), "below", "retained")
    out, level = None, 1
    while True:
        level += 1
        sums = at.groupBy("path").agg(F.sum("below").alias("objects"), F.sum("retained").alias("retained"))
        out = sums if out is None else out.unionByName(sums)
        following = rows.where(F.col("depth") == level)
        if level > depth or following.isEmpty():
            return out
        # a way's name goes with its nodes to the next level only
        at = written(following.join(at.select(F.col("obj_id").alias("idom"), F.col("path").alias("before")), "idom").select("obj_id", F.concat_ws(" > ", "before", "label").alias("path"), "below", "retained"), "ways")


def ways_to(tree: DataFrame, points: DataFrame, depth: int = 30) -> DataFrame:
    """obj_id, over, depth: each point's (column obj_id) dominators and itself, those ``depth`` nearest to the root."""
    points = written(points.select("obj_id"), "points")
    up = tree.where("idom IS NOT NULL").select("obj_id", F.col("idom").alias("up"), "depth")
    own = written(up.join(_few(points), "obj_id"), "points-up")
    far = own.agg(F.max("depth")).first()[0] or 0
    found = own.where(F.col("up") != VROOT).select("obj_id", F.col("up").alias("over"), (F.col("depth") - 1).alias("depth"))
    own = own.select("obj_id", F.col("obj_id").alias("over"), "depth")
    # further up are only nodes that something is below
    step, jumps = 1, tree.where("below > 1").select("obj_id", F.col("idom").alias("up")).where(F.col("up") != VROOT)
    while step < far:  # as many steps up as the bits of the way's length say, and all ways between
        more = found.join(jumps.withColumnRenamed("obj_id", "over"), "over").select("obj_id", F.col("up").alias("over"), (F.col("depth") - step).alias("depth"))
        found = written(found.unionByName(more), "ways")
        jumps = written(jumps.join(jumps.select(F.col("obj_id").alias("up"), F.col("up").alias("next")), "up").select("obj_id", F.col("next").alias("up")), "jumps")
        step *= 2
        # what lies deeper than asked for only matters as the start of longer jumps
    return found.unionByName(own).where(F.col("depth") <= depth)


def accumulation_points(tree: DataFrame, suspects: DataFrame, ratio: float = 0.7) -> DataFrame:
    """obj_id, point, hops: descent from each suspect while its largest child retains ``ratio`` of it.

    Steps from object to heavy child are doubled, so long ways take few rounds. The rows are written, so that what they
    are joined with is chosen by their number and not by that of the tree."""
    heavy = tree.where("idom >= 0").groupBy("idom").agg(F.max(F.struct("retained", (-F.col("obj_id")).alias("minus_id"))).alias("c"))
    down = tree.where("below > 1").select("obj_id", "retained").join(heavy.withColumnRenamed("idom", "obj_id"), "obj_id").where(F.col("c.retained") >= ratio * F.col("retained"))
    down = written(down.select("obj_id", (-F.col("c.minus_id")).alias("point"), F.lit(1).alias("hops")), "heavy-children")
    while True:
        on = down.select(F.col("obj_id").alias("point"), F.col("point").alias("next"), F.col("hops").alias("more"))
        met = down.join(on, "point", "left")
        with by_real_size(tree.sparkSession):
            if met.where("next IS NOT NULL").isEmpty():
                break
        down = written(met.select("obj_id", F.coalesce("next", "point").alias("point"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops")), "heavy-children")
    found = suspects.select("obj_id").join(down, "obj_id", "left").select("obj_id", F.coalesce("point", "obj_id").alias("point"), F.coalesce("hops", F.lit(0)).alias("hops"))
    return written(found, "accumulation-points")


def subtree(tree: DataFrame, top: int, depth: int = 20) -> DataFrame:
    """The nodes that ``top`` dominates, down to ``depth`` below it, with their level."""
    head = F.broadcast(tree.where(F.col("obj_id") == top).select(F.col("pre").alias("from_"), F.col("pre_end").alias("to_"), F.col("depth").alias("top_depth")))
    held = (F.col("obj_id") == top) | (F.col("at") >= F.col("from_")) & (F.col("at") < F.col("to_"))
    rows = tree.crossJoin(head).where(held).withColumn("level", F.col("depth") - F.col("top_depth"))  # one row
    return rows.where(F.col("level") <= depth).drop("from_", "to_", "top_depth")
