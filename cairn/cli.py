"""Command line: analyse a dump or render a saved report again, compare reports, and tools for development.

Exit code 2 says that a comparison failed.
"""

from __future__ import annotations

import argparse
import gzip
import json
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from cairn.operators import contents as C
from cairn.operators import growth as G
from cairn.plans import dump as D
from cairn.plans import dump_views as DV
from cairn.operators import views as V
from cairn.plans.report import DETAILS, SECTIONS, VERSION, build
from cairn.plans.tables import one_row, written
from cairn.rules import triage
from cairn.sinks import render
from cairn.sources import collections as K
from cairn.sources import exports, hprof, reports

_ANALYSE_ONLY = ("find_duplicates", "collections", "collection_config", "exclude_weak")


def session() -> SparkSession:
    return SparkSession.builder.appName("cairn").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def analyse(spark: SparkSession, path: str, args: argparse.Namespace) -> dict:
    dump = D.open_relations(spark, path)
    heap = D.heap_of_dump(dump, args.exclude_weak)
    more = {
        "threads": ("Threads", D.threads(dump, heap.tree)),
        "locals": ("Thread locals", D.locals_by_frame(dump, heap.tree, DETAILS[args.detail].thread_locals).select("thread_serial", "frame_no", "class_name", "retained")),
        "census": ("Records", dump.census),
        "alloc_sites": ("Allocation sites", DV.allocation_frames(dump, V.allocation_sites(heap.tree, DETAILS[args.detail].alloc_top)).orderBy(F.desc("objects"), F.desc("retained"), "alloc_serial")),
        "references": ("References", C.reference_histogram(DV.reference_rows(dump, heap.tree)).orderBy("kind", F.desc("objects"), "class_name")),
        "only_weak": ("Only weakly retained", C.only_weakly_retained(DV.reference_rows(dump, heap.tree)).orderBy("kind", F.desc("objects"), "class_name")),
        "fields": ("Fields by retained size", C.fields_by_size(DV.held_objects(dump, heap.tree))),
        "properties": ("System properties", DV.system_properties(dump)),
    }
    facts = [triage.facts_of(heap.tree, heap.roots, dump.id_size + dump.ref_size), DV.facts_always(dump, heap.tree)]
    if args.find_duplicates:
        facts.append(DV.facts_of_duplicates(dump))
        texts = D.java_strings(dump)
        more["strings"] = ("Duplicate strings", C.duplicate_strings(texts))
        more["string_stats"] = ("Strings", C.string_stats(texts))
        more["string_holders"] = ("Holders of strings", DV.holders_of(dump, heap.tree, texts))
        more["array_copies"] = ("Duplicate primitive arrays", DV.duplicate_primitive_arrays(dump))
        more["char_waste"] = ("Slack of strings' arrays", C.char_array_waste(texts.select(F.col("array").alias("obj_id"), "used", "capacity").distinct()))
    if args.collections:
        config = K.find_config(args.collection_config)
        own = K.parse_config(open(config, encoding="utf-8").read()) if config else []
        found = written(D.collections_of(dump, K.descriptors(spark, K.BUILT_IN, own), heap.nodes), "collections")
        held = DV.held_collections(dump, found, heap.tree)
        more["attribution"] = ("Fields by elements", C.attribution_overall(held))
        more["attribution_single"] = ("Fields by largest collection", C.attribution_single(held))
        more["biggest"] = ("Biggest collections", C.biggest_collections(found, DV.contents_of(dump, found, heap.tree)).orderBy(F.desc("elements"), "obj_id"))
        more["contents"] = ("Contents of collections", C.collection_contents(found, DV.contents_of(dump, found, heap.tree)).orderBy("kind"))
        more["array_fill"] = ("Object arrays by fill", DV.array_fill(dump, heap.nodes).orderBy("bucket"))
        more["constant_arrays"] = ("Constant arrays", DV.constant_primitive_arrays(dump).limit(100))
        facts.append(DV.facts_of_collections(dump, heap.tree, found))
        more["collections"] = ("Collections by kind", C.collections_by_kind(found).orderBy("kind"))
        more["fill"] = ("Collections by fill", C.fill_ratios(found.where("capacity IS NOT NULL"), dump.ref_size).orderBy("bucket"))
    more["triage"] = ("Triage", triage.evaluate(one_row(*facts)).orderBy("rank"))
    return build(heap, path, args.detail, more)


def load(path: str) -> dict:
    """A saved report from a file, which may be packed, or from standard input for `-`."""
    if path == "-":
        return render.from_json(sys.stdin.read(), VERSION)
    with open(path, "rb") as f:
        data = f.read()
    return render.from_json((gzip.decompress(data) if data[:2] == b"\x1f\x8b" else data).decode("utf-8"), VERSION)


def run_analyse(args: argparse.Namespace) -> int:
    if args.input != "-" and hprof.is_dump(args.input):
        report = analyse(session(), args.input, args)
    else:
        given = [f"--{n.replace('_', '-')}" for n in _ANALYSE_ONLY if getattr(args, n)]
        if given:
            raise SystemExit(f"{', '.join(given)} only go with a dump; {args.input} is a saved report")
        try:
            report = load(args.input)
        except (ValueError, UnicodeDecodeError) as e:
            raise SystemExit(f"{args.input} is neither a heap dump nor a report that can be read: {e}") from e
    render.write(render.FORMATS[render.format_of(args.format, args.output)](report), args.output)
    return 0


def run_compare_reports(args: argparse.Namespace) -> int:
    spark = session()
    given = reports.read_reports(spark, args.inputs)
    classes = reports.class_rows(given)
    rows = G.growth(classes)
    last = len(args.inputs) - 1
    suspects = G.changes(reports.suspect_rows(given), last)
    totals = reports.shallow_totals(given)
    line = G.verdict(rows, totals[0], totals[-1], suspects.where("state = 'new'").count())
    tables = {
        "growth": ("Growth by class", rows.orderBy(F.desc("delta_retained"), "class_name")),
        "histories": ("Every report by class", G.histories(classes).orderBy(F.desc("delta_retained"), "class_name")),
        "suspect_changes": ("Suspects that are new, gone or kept", suspects.orderBy("state", F.desc("last_retained"), "class_name")),
    }
    sections = {"verdict": {"title": "Verdict", "columns": ["verdict"], "rows": [[line]]}}
    sections |= {k: {"title": title, "columns": t.columns, "rows": [list(r) for r in t.collect()]} for k, (title, t) in tables.items()}
    report = {"version": VERSION, "source": " → ".join(args.inputs), "sections": sections}
    fmt = render.format_of(args.format, args.output)
    render.write(render.page(report, "growth") if fmt == "html" else render.FORMATS[fmt](report), args.output)
    return 0


def run_compare_export(args: argparse.Namespace) -> int:
    spark = session()
    theirs = exports.histogram(spark, args.export)
    ours = reports.class_rows(reports.read_reports(spark, [args.report])).drop("report")
    result = [r.asDict() for r in G.compared(ours, theirs, ["class_name"], ["instances"]).where("outcome != 'extra'").collect()]
    fails = [r for r in result if r["outcome"] != "match"]
    render.write(json.dumps({"compared": len(result), "fails": len(fails), "rows": fails}, indent=2) + "\n", args.output)
    return 2 if fails else 0


def run_sweep(args: argparse.Namespace) -> int:
    spark = session()
    diffs = spark.read.option("multiLine", True).schema("compared long, fails long").json(f"{args.folder}/*.diff.json")
    gate = G.sweep_gate(diffs, args.least).first()
    print(f"{gate.comparisons} comparisons, {gate.fails or 0} failures")
    return 0 if gate.passed else 2


def run_schema(args: argparse.Namespace) -> int:
    row = {"type": "array", "items": {}}
    section = {"type": "object", "required": ["title", "columns", "rows"], "properties": {"title": {"type": "string"}, "columns": {"type": "array", "items": {"type": "string"}}, "rows": {"type": "array", "items": row}}}
    schema = {"$schema": "https://json-schema.org/draft/2020-12/schema", "type": "object", "required": ["version", "source", "sections"], "properties": {"version": {"const": VERSION}, "source": {"type": "string"}, "sections": {"type": "object", "properties": {k: section for k, _, _ in SECTIONS}, "additionalProperties": section}}}
    render.write(json.dumps(schema, indent=2) + "\n", args.output)
    return 0


def run_census(args: argparse.Namespace) -> int:
    spark = session()
    spark.dataSource.register(hprof.HprofSource)
    rows = spark.read.format("hprof").option("relation", "census").load(args.input).collect()
    print(json.dumps({r.record: r.n for r in rows}, indent=2))
    return 0


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cairn", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, run, *inputs, **kw):
        p = sub.add_parser(name, **kw)
        for i in inputs:
            p.add_argument(*i[0], **i[1])
        p.set_defaults(run=run)
        return p

    out = (["output"], {"nargs": "?"})
    fmt = (["-f", "--format"], {"choices": list(render.FORMATS)})
    p = command("analyse", run_analyse, (["input"], {}), out, fmt)
    p.add_argument("--detail", choices=list(DETAILS), default="default")
    for flag in ("--find-duplicates", "--collections", "--exclude-weak"):
        p.add_argument(flag, action="store_true")
    p.add_argument("--collection-config")
    p = command("compare-reports", run_compare_reports, (["inputs"], {"nargs": "+"}), fmt)
    p.add_argument("-o", "--output")
    command("compare-export", run_compare_export, (["export"], {}), (["report"], {}), out)
    command("sweep", run_sweep, (["folder"], {}), (["--least"], {"type": int, "default": 15}))
    command("schema", run_schema, out)
    command("census", run_census, (["input"], {}))
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    return args.run(args)
