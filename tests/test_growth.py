from cairn.operators import growth as G
from cairn.sinks import render


def test_verdict(spark):
    rows = spark.createDataFrame([("a.B", 500), ("a.C", 20)], "class_name string, delta_retained long")
    assert G.verdict(rows, 1000, 1250, 1) == "Heap grew 25.0% (+250 bytes shallow); largest driver `a.B` (+500 bytes retained). 1 new suspect."
    assert G.verdict(rows, 1000, 900, 2) == "Heap shrank 10.0% (-100 bytes shallow); no net growth. 2 new suspects."
    assert G.verdict(rows, 0, 0) == "Heap size is unchanged."


def test_histories_and_changes(spark):
    rows = [("a", 0, 5, 1), ("a", 0, 1, 1), ("a", 2, 9, 3), ("b", 1, 7, 1), ("c", 2, 4, 2), ("d", 0, 3, 1)]
    reports = spark.createDataFrame(rows, "class_name string, report int, retained long, instances long")
    found = {r.class_name: (r.state, r.retained, r.instances, r.delta_retained) for r in G.histories(reports).collect()}
    assert found == {"a": ("kept", [6, 0, 9], [2, 0, 3], 3), "b": ("passing", [0, 7, 0], [0, 1, 0], 0), "c": ("new", [0, 0, 4], [0, 0, 2], 4), "d": ("gone", [3, 0, 0], [1, 0, 0], -3)}
    # the last report has no row at all
    assert {r.class_name: r.state for r in G.changes(reports, 3).collect()} == {"a": "gone", "b": "passing", "c": "passing", "d": "gone"}
    assert G.histories(reports.limit(0)).count() == 0 and G.changes(reports.limit(0), 1).count() == 0


def test_drawn_tree():
    columns = ["obj_id", "idom", "class_name", "retained"]
    rows = [[1, -1, "A", 30], [2, 1, "B", 9], [3, 1, "C", 20], [4, 3, "D", 5], [5, -1, "E", 7]]
    assert render.drawn_tree(columns, rows, 9) == ["A 0x1 30 B", "├─ C 0x3 20 B", "│  └─ D 0x4 5 B", "└─ B 0x2 9 B", "E 0x5 7 B"]
    assert len(render.drawn_tree(columns, rows, 2)) == 2


def test_bands_of_shown_sizes(spark):
    rows = spark.createDataFrame([("5 MB",), ("1.2 GB",), ("1,024 B",), ("0 B",), ("much",), (None,)], "t string")
    got = [r.b and (r.b.low, r.b.high) for r in rows.select(G.display_band("t").alias("b")).collect()]
    assert got[0] == (4.5 * 2**20, 5.5 * 2**20) and got[2] == (1023.5, 1024.5) and got[3] == (0.0, 0.5) and got[4:] == [None, None]
    assert abs(got[1][0] - 1.15 * 2**30) < 1 and abs(got[1][1] - 1.25 * 2**30) < 1


def test_package_gap_is_void_off_the_chain(spark):
    ours = spark.createDataFrame([("", 3, 90), ("java.lang", 1, 10), ("org", 2, 80)], "package string, objects long, retained long")
    theirs = [("", 4, 95), ("java.lang", 2, 15), ("org", 2, 80), ("org.Leaf", 1, 8)]
    outcome = lambda rows: {r.package: r.outcome for r in G.packages_compared(ours, spark.createDataFrame(rows, ours.schema)).collect()}
    assert outcome(theirs) == {"": "explained", "java.lang": "explained", "org": "match", "org.Leaf": "skipped"}
    assert outcome([*theirs[:2], ("org", 3, 81)]) == {"": "differs", "java.lang": "differs", "org": "differs"}
    assert outcome([("java.lang", 1, 15)]) == {"java.lang": "differs"}
