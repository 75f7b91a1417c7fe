import random
import re

import pytest
from pyspark.sql import functions as F

from cairn.operators import graph, views
from cairn.operators.graph import VROOT, dominator_tree, immediate_dominators_of


def brute(roots, edges, nodes):
    """Immediate dominators: the nodes whose removal cuts a node off, the nearest of them."""
    after = {}
    for a, b in edges:
        after.setdefault(a, []).append(b)

    def reach(without):
        seen, todo = set(), [r for r in roots if r != without]
        while todo:
            v = todo.pop()
            if v not in seen:
                seen.add(v)
                todo += [w for w in after.get(v, []) if w != without]
        return seen

    everything = reach(None)
    doms = {v: set() for v in everything}
    for d in everything:
        for v in everything - reach(d) - {d}:
            doms[v].add(d)
    out = {v: max(doms[v], key=lambda d: len(doms[d]), default=VROOT) for v in everything}
    return out


CASES = [
    ("diamond", [0], [(0, 1), (0, 2), (1, 3), (2, 3)], 4, {0: -1, 1: 0, 2: 0, 3: 0}),
    ("chain", [0], [(0, 1), (1, 2)], 3, {0: -1, 1: 0, 2: 1}),
    ("two roots", [0, 1], [], 2, {0: -1, 1: -1}),
    ("bypass", [0], [(0, 1), (0, 2), (1, 2), (1, 3), (2, 3)], 4, {0: -1, 1: 0, 2: 0, 3: 0}),
    ("meet below roots", [0, 1], [(0, 2), (1, 3), (3, 2)], 4, {0: -1, 1: -1, 3: 1, 2: -1}),
    ("one left out", [0], [(0, 1)], 3, {0: -1, 1: 0}),
    ("loop and root below root", [0, 1], [(0, 1), (1, 1), (1, 2), (2, 1)], 3, {0: -1, 1: -1, 2: 1}),
]


def tree_of(spark, roots, edges, n, shallow=None, rows=None, reprs=None):
    nodes = spark.createDataFrame([(i, (rows or [0] * n)[i], (reprs or {}).get(i), (shallow or [1] * n)[i]) for i in range(n)], "obj_id long, class_row long, repr_row long, shallow long")
    e = spark.createDataFrame(edges, "src long, dst long")
    return nodes, e, dominator_tree(nodes, e, spark.createDataFrame([(r,) for r in roots], "obj_id long"))


@pytest.mark.parametrize("name,roots,edges,n,want", CASES, ids=[c[0] for c in CASES])
def test_small_graphs(spark, name, roots, edges, n, want):
    got = {r.obj_id: r.idom for r in tree_of(spark, roots, edges, n)[2].collect() if r.idom is not None}
    assert got == want == immediate_dominators_of(roots, edges)


def test_semidominators_against_brute_force():
    rng = random.Random(7)
    for _ in range(400):
        n = rng.randint(2, 14)
        edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(rng.randint(1, 3 * n))]
        roots = rng.sample(range(n), rng.randint(1, min(3, n)))
        assert immediate_dominators_of(roots, edges) == brute(roots, edges, n)


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_random_cyclic_graph(spark, seed):
    rng = random.Random(seed)
    n = 40
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range(70)]
    shallow = [rng.randint(1, 90) for _ in range(n)]
    want = brute([0, 5], edges, n)
    rows = [rng.randrange(6) for _ in range(n)]
    reprs = {7: 2, 8: 3}
    tree = tree_of(spark, [0, 5], edges, n, shallow, rows, reprs)[2].collect()
    assert {r.obj_id: r.idom for r in tree if r.idom is not None} == want
    below = {v: 0 for v in want}
    for v in want:
        u = v
        while u != VROOT:
            below[u] += shallow[v]
            u = want[u]
    assert {r.obj_id: r.retained for r in tree if r.idom is not None} == below
    above = {}
    for v in want:
        u, above[v] = want[v], []
        while u != VROOT:
            above[v].append(u)
            u = want[u]
    assert {r.obj_id: r.depth for r in tree if r.idom is not None} == {v: len(a) + 1 for v, a in above.items()}
    assert {r.obj_id: r.below for r in tree if r.idom is not None} == {v: 1 + sum(v in a for a in above.values()) for v in want}
    assert {r.obj_id: r.same_class for r in tree if r.idom is not None} == {v: any(rows[v] in (rows[u], reprs.get(u)) for u in a) for v, a in above.items()}


def test_deep_list_with_values_and_a_hub(spark):
    """A linked list of 3000 entries with a value each, all known to a hub besides; and a plain list."""
    n = 3000
    plain = [(0, 1)] + [(i, i + 1) for i in range(1, n)] + [(i, 10_000 + i) for i in range(1, n + 1)]
    edges = spark.createDataFrame(plain, "src long, dst long")
    ids = sorted({x for e in plain for x in e})
    nodes = spark.createDataFrame([(i, i // 10_000, None, 1) for i in ids], "obj_id long, class_row long, repr_row long, shallow long")
    got = {r.obj_id: r for r in dominator_tree(nodes, edges, spark.createDataFrame([(0,)], "obj_id long")).collect()}
    assert all(got[i].idom == i - 1 and got[i].depth == i + 1 and got[i].retained == 2 * (n - i + 1) and got[i].same_class for i in range(1, n + 1))
    assert all(got[10_000 + i].idom == i and not got[10_000 + i].same_class for i in range(1, n + 1))
    both = plain + [(0, i) for i in range(1, n + 1)] + [(i + 1, i) for i in range(1, n)]
    got = {r.obj_id: r for r in dominator_tree(nodes, spark.createDataFrame(both, "src long, dst long"), spark.createDataFrame([(0,)], "obj_id long")).collect()}
    assert all(got[i].idom == 0 and got[i].retained == 2 for i in range(1, n + 1)) and got[0].retained == 2 * n + 1


def test_ways_and_merged_paths(spark):
    _, _, tree = tree_of(spark, [0], [(0, 1), (1, 2), (2, 3), (3, 4), (0, 5), (5, 6)], 7)
    tree = tree.withColumn("class_name", F.concat(F.lit("c"), F.col("obj_id") % 3))
    found = graph.ways_to(tree, tree.where("obj_id IN (4, 6)").select("obj_id"), 3)
    assert {(r.obj_id, r.over, r.depth) for r in found.collect()} == {(4, 0, 1), (4, 1, 2), (4, 2, 3), (6, 0, 1), (6, 5, 2), (6, 6, 3)}
    got = {(r.path, r.objects, r.retained) for r in graph.merged_paths(tree).collect()}
    assert got == {("c0", 7, 7), ("c0 > c1", 4, 4), ("c0 > c2", 2, 2), ("c0 > c1 > c2", 3, 3), ("c0 > c2 > c0", 1, 1), ("c0 > c1 > c2 > c0", 2, 2), ("c0 > c1 > c2 > c0 > c1", 1, 1)}


def test_retained_and_same_class(spark):
    chain = [(0, 1), (1, 2)]
    rows = {r.obj_id: r for r in tree_of(spark, [0], chain, 3, [10, 20, 30], [0, 1, 0])[2].collect()}
    assert [rows[i].retained for i in range(3)] == [60, 50, 30] and [rows[i].same_class for i in range(3)] == [False, False, True]
    rows = {r.obj_id: r for r in tree_of(spark, [0], chain, 3, [10, 20, 30], [0, 1, 0], {0: 1})[2].collect()}
    assert [rows[i].same_class for i in range(3)] == [False, True, True]
    fan = {r.obj_id: r for r in tree_of(spark, [0], [(0, 1), (0, 2), (1, 3), (2, 3)], 4, [1, 2, 3, 4])[2].collect()}
    assert [fan[i].retained for i in range(4)] == [10, 2, 3, 4] and [fan[i].depth for i in range(4)] == [1, 2, 2, 2]


def test_unreachable_forest(spark):
    nodes, e, tree = tree_of(spark, [0], [(2, 3), (3, 4), (5, 6), (6, 5)], 7, [10] * 2 + [10, 20, 30] + [7, 8], [0, 0, 1, 2, 3, 4, 4])
    got = {r.obj_id: (r.idom, r.retained) for r in graph.unreachable_forest(tree, e).collect()}
    assert got == {1: (-1, 10), 2: (-1, 60), 3: (2, 50), 4: (3, 30), 5: (None, 7), 6: (None, 8)}


def test_descent_and_subtree(spark):
    _, _, tree = tree_of(spark, [0], [(0, 1), (1, 2), (1, 3), (2, 4)], 5, [1, 1, 1, 50, 60])
    tree = tree.withColumnRenamed("class_row", "c")
    got = graph.accumulation_points(tree, tree.where("obj_id = 0").select("obj_id")).first()
    assert (got.point, got.hops) == (1, 1)
    assert {(r.obj_id, r.level) for r in graph.subtree(tree, 1, 1).collect()} == {(1, 0), (2, 1), (3, 1)}


def test_descent_joins_the_tree_without_sending_it(spark):
    _, _, tree = tree_of(spark, [0], [(0, 1), (1, 2), (1, 3), (2, 4)], 5, [1, 1, 1, 50, 60])
    found = views.suspects_descent(tree.withColumn("class_name", F.lit("c")).withColumn("loader", F.lit("l")))
    joins = re.findall("BroadcastHashJoin .*", found._jdf.queryExecution().sparkPlan().toString())
    assert [(r.obj_id, r.point, r.hops) for r in found.collect()] == [(0, 1, 1)]
    assert len(joins) == 1 and "BuildLeft" in joins[0]  # the points are left, the tree is right


def test_no_range_of_addresses_holds_many_arrays(spark):
    arrays = spark.range(600_000).select((F.col("id") * 16).alias("addr"), F.lit(0).cast("long").alias("elements"))
    assert views._address_ranges(arrays).groupBy("bucket").count().agg(F.max("count")).first()[0] <= 262_144
    assert not views.compressed_references(arrays).first()[0]
    tight = spark.createDataFrame([((1 << 22) - 24, 1), (1 << 22, 0), ((1 << 28) - 20, 1), (1 << 28, 0)], "addr long, elements long")
    assert not views.compressed_references(tight.limit(2)).first()[0] and views.compressed_references(tight).first()[0]


@pytest.mark.parametrize("seed", [6, 7])
def test_leaves_that_meet_across_blocks_of_numbers(spark, seed, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK_BITS", 2)
    rng = random.Random(seed)
    n, leaves = 60, 200
    edges = [(rng.randrange(max(0, i - 9), i), i) for i in range(1, n) if i % 20] + [(rng.randrange(n), n + i) for i in range(leaves) for _ in range(rng.randint(1, 3))]
    want = brute([0, 20, 40], edges, n + leaves)
    depth = lambda v: 1 if want[v] == VROOT else 1 + depth(want[v])
    got = tree_of(spark, [0, 20, 40], edges, n + leaves)[2].collect()
    assert {r.obj_id: (r.idom, r.depth) for r in got if r.idom is not None} == {v: (d, depth(v)) for v, d in want.items()}
    number = {r.obj_id: r.pre for r in got}
    assert all(r.at == number.get(r.idom) for r in got if r.idom is not None)


def test_rounds_leave_out_nodes_that_nothing_hangs_from(spark):
    star = spark.createDataFrame([(0, -1, 1, 1)] + [(i, 0 if i < 90 else 7, 1, 1) for i in range(1, 100)] + [(100, 555, 1, 1), (101, 100, 1, 1)], "obj_id long, up long, size long, depth long")
    rows, rounds = graph._doubled(star, ["size"], ["depth"], "star")
    got = {r.obj_id: (r.up, r.size, r.depth) for r in rows.collect()}
    assert got[0] == (VROOT, 100, 1) and got[7] == (VROOT, 11, 2) and got[99] == (VROOT, 1, 3) and got[8] == (VROOT, 1, 2)
    assert got[100][0] == got[101][0] == graph.DEAD and len(got) == 102
    assert all(t.count() == 3 for t in rounds) and rounds


def test_children_are_numbered_in_parts_only_where_they_are_many(spark, monkeypatch):
    rows = spark.createDataFrame([(i, i % 3, 1 + i % 4) for i in range(60)], "obj_id long, idom long, size long")
    for most in (5, 100):
        monkeypatch.setattr(graph, "SIBLINGS", most)
        found = graph._numbered(rows)
        for idom in range(3):
            spans = sorted((r.ahead, r.ahead + r["size"]) for r in found.where(f"idom = {idom}").collect())
            assert spans[0][0] == 1 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))


def test_views_join_no_more_of_the_tree_than_they_need(spark, monkeypatch):
    _, _, tree = tree_of(spark, [0], [(0, i) for i in range(1, 300)] + [(1, 400)], 401)
    tree = tree.withColumn("class_name", F.concat(F.lit("c"), F.col("obj_id") % 2))
    kept, write = {}, views.written
    monkeypatch.setattr(views, "written", lambda df, name: kept.setdefault(name, write(df, name)))
    assert [tuple(r) for r in views.big_drops(tree).collect()] == [(0, "c0", 301, 2, 299)]
    assert kept["heavy-objects"].count() == 1
    assert {r.of_class: r.path for r in views.root_path(tree).collect()} == {"c0": "c0", "c1": "c0 > c1"}
    assert kept["steps"].count() == 3
    doms = views.immediate_dominators(tree)
    assert {tuple(r) for r in doms.collect()} == {("c0", 1, 1, 299, 299), ("c1", 1, 1, 1, 1)}
    assert "below" in doms._jdf.queryExecution().sparkPlan().toString()
