import base64
import json
import re
import zlib

import pytest

from cairn import cli
from cairn.rules import triage
from cairn.sinks import render
from cairn.sources import exports
from tests.dump_writer import sample


@pytest.fixture(scope="module")
def saved(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("r")
    dump = sample().write(folder / "a.hprof")
    out = str(folder / "a.json")
    assert cli.main(["analyse", dump, out, "--collections", "--find-duplicates", "--detail", "minimal"]) == 0
    return folder, out


def test_report_and_its_formats(saved, capsys):
    folder, out = saved
    report = cli.load(out)
    s = report["sections"]
    hist = {r[s["histogram"]["columns"].index("class_name")]: r for r in s["histogram"]["rows"]}
    assert hist["java.lang.String"][s["histogram"]["columns"].index("instances")] == 6
    assert s["threads"]["rows"][0][1] == "main" and s["collections"]["rows"][0][0] == "List"
    assert [r[1] for r in s["triage"]["rows"]][:2] == ["headline-retainer", "concentration"]
    text = render.markdown(report)
    assert all(f"## {x['title']}" in text for x in s.values())
    for block in re.findall(r"(?:^\|.*\n)+", text, re.M):  # every row of a table has as many cells
        assert len({len(re.findall(r"(?<!\\)\|", line)) for line in block.splitlines()}) == 1
    assert "█" in render.markdown(report, bars=True)
    page = render.page(report)
    assert "http" not in page and page == render.page(report)
    packed = re.search(r'id="report"[^>]*>([^<]+)<', page)[1]
    assert json.loads(zlib.decompress(base64.b64decode(packed), -15)) == report
    assert cli.main(["analyse", out, str(folder / "again.md.gz")]) == 0
    with pytest.raises(SystemExit, match="only go with a dump"):
        cli.main(["analyse", out, "--collections"])
    (folder / "no.txt").write_text("x")
    with pytest.raises(SystemExit, match="neither"):
        cli.main(["analyse", str(folder / "no.txt")])
    report["version"] = 99
    (folder / "v.json").write_text(json.dumps(report))
    with pytest.raises(SystemExit, match="version 99"):
        cli.main(["analyse", str(folder / "v.json")])


def test_growth_of_reports_and_stream(spark, saved):
    folder, out = saved
    report = cli.load(out)
    k = report["sections"]["histogram"]["columns"]
    for r in report["sections"]["histogram"]["rows"]:
        if r[k.index("class_name")] == "Sub":
            r[k.index("retained")] += 1000
    (folder / "s").mkdir()
    (folder / "s" / "b.json").write_text(json.dumps(report))
    target = str(folder / "growth.json")
    assert cli.main(["compare-reports", out, str(folder / "s" / "b.json"), "-o", target]) == 0
    rows = json.loads(open(target).read())["sections"]["growth"]
    grown = {r[rows["columns"].index("class_name")]: r[rows["columns"].index("delta_retained")] for r in rows["rows"]}
    assert grown["Sub"] == 1000 and sum(grown.values()) == 1000
    sections = json.loads(open(target).read())["sections"]
    assert sections["verdict"]["rows"] == [["Heap size is unchanged."]]
    history = {r[0]: r for r in sections["histories"]["rows"]}["Sub"]
    assert history[2][1] - history[2][0] == 1000 and history[1] == "kept" and {r[1] for r in sections["suspect_changes"]["rows"]} <= {"kept"}
    from cairn.streaming.growth import report_stream, streamed_growth

    q = streamed_growth(report_stream(spark, str(folder / "s"))).writeStream.format("memory").queryName("grown").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("grown").where("class_name = 'Sub'").first().reports == 1


def test_export_compare_and_sweep(spark, saved, tmp_path):
    folder, out = saved
    report = cli.load(out)
    k = report["sections"]["histogram"]["columns"]
    sums = {}
    for r in report["sections"]["histogram"]["rows"]:
        sums[r[k.index("class_name")]] = sums.get(r[k.index("class_name")], 0) + r[k.index("instances")]
    rows = "".join(f"<tr><td>{c}</td><td>{n:,}</td><td>&gt;= 1</td></tr>" for c, n in sums.items())
    (tmp_path / "p.html").write_text(f"<table><tr><th>Class Name</th><th>Objects</th><th>Retained Heap</th></tr>{rows}</table><table><tr><td>Objects:</td><td>5</td></tr></table>")
    assert exports.overview(str(tmp_path))["Objects"] == "5"
    assert cli.main(["compare-export", str(tmp_path), out, str(tmp_path / "one.diff.json")]) == 0
    (tmp_path / "p.html").write_text("<table><tr><th>Class</th><th>Instances</th></tr><tr><td>Missing</td><td>3</td></tr></table>")
    assert cli.main(["compare-export", str(tmp_path), out, str(tmp_path / "two.diff.json")]) == 2
    assert cli.main(["sweep", str(tmp_path), "--least", "1"]) == 2
    (tmp_path / "two.diff.json").unlink()
    assert cli.main(["sweep", str(tmp_path), "--least", "1"]) == 0 and cli.main(["sweep", str(tmp_path)]) == 2


def fired(spark, **facts):
    frame = spark.createDataFrame([tuple(facts.values())], ", ".join(f"{k} {triage.FACTS[k]}" for k in facts))
    return {r.rule: r.severity for r in triage.evaluate(frame).collect()}


def test_rules_fire_at_their_thresholds(spark):
    assert len(triage.RULES) == 39 and len({r.name for r in triage.RULES}) == 39
    assert set(fired(spark, total=1000)) == {"headline-retainer", "concentration"}
    cases = [
        ("gc-root-type", {"top_root_bp": 5000}, {"top_root_bp": 4999}), ("metaspace-pressure", {"classes": 50_000}, {"classes": 49_999}), ("threadlocal-leak", {"null_key_entries": 1}, {"null_key_entries": 0}),
        ("thread-pinning", {"total": 1000, "max_thread_retained": 200}, {"total": 1000, "max_thread_retained": 199}), ("thread-pinning", {"total": 1000, "max_thread_retained": 100, "max_thread_locals": 100}, {"total": 1000, "max_thread_retained": 100, "max_thread_locals": 99}),
        ("gc-waste", {"fragmentation_bp": 1000}, {"fragmentation_bp": 999}), ("off-heap", {"direct_buffer_bytes": 64 << 20}, {"direct_buffer_bytes": (64 << 20) - 1}), ("jni-global-ref-leak", {"total": 100, "jni_globals": 5000, "jni_retained": 5}, {"total": 100, "jni_globals": 4999, "jni_retained": 5}),
        ("duplicate-strings", {"total": 100, "string_waste": 5}, {"total": 100, "string_waste": 4}), ("char-array-slack", {"char_waste": 16 << 20, "wasteful_char_arrays": 1000}, {"char_waste": 16 << 20, "wasteful_char_arrays": 999}),
        ("big-drop-concentration", {"total": 1 << 30, "top_drop": 64 << 20}, {"total": 1 << 30, "top_drop": (64 << 20) - 1}), ("empty-collection-cemetery", {"collections": 10, "empty_collections": 6}, {"collections": 10, "empty_collections": 5}), ("large-unbounded-collection", {"largest_collection": 1_000_000}, {"largest_collection": 999_999}),
        ("proxy-lambda-bloat", {"classes": 200, "anonymous_classes": 100}, {"classes": 200, "anonymous_classes": 99}), ("heap-composition-skew", {"top_kind_bp": 7000}, {"top_kind_bp": 6999}), ("fixed-per-object-overhead", {"total": 120, "objects": 2, "header": 12}, {"total": 121, "objects": 2, "header": 12}),
    ]
    for name, yes, no in cases:
        assert name in fired(spark, **yes) and name not in fired(spark, **no), name
    assert fired(spark, total=100, suspect_retained=50, suspect_name="x")["headline-retainer"] == "Critical"
    assert fired(spark, total=100, suspect_retained=49, suspect_name="x")["headline-retainer"] == "Warning"


def test_formats():
    assert render.size(0) == "0 B" and render.size(1536) == "1.50 KiB" and render.signed_size(-1024) == "-1.00 KiB"
    assert render.bar(0.5, 4) == "██  " and render.sparkline([0, 4, 8]) == "▁▅█" and render.tree_prefix([False, True]) == "│  └─ "
    assert render.percent(1234) == "12.34%" and render.signed_count(5) == "+5" and render.fill_label(10) == "full"
    assert render.format_of(None, "a.html.gz") == "html" and render.format_of(None, None) == "md"
