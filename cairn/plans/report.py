"""A report: named sections, each a small table, collected into one document."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.operators import views as V
from cairn.plans.tables import written
from cairn.rules import triage
from cairn.sources.relational import Heap

VERSION = 1


@dataclass(frozen=True)
class Detail:
    """How long the lists of a report are."""

    root_depth: int = 30
    alloc_top: int = 50
    leak_children: int = 50
    top_consumers: int = 20
    thread_locals: int = 20
    dom_nodes: int = 5000
    dom_depth: int = 20


DETAILS = {"minimal": Detail(10, 15, 15, 10, 5, 500, 10), "default": Detail(), "max": Detail(200, 500, 500, 100, 100, 100_000, 50)}

def points(heap: Heap) -> DataFrame:
    """The accumulation points, worked out once for all sections that start from them."""
    if "points" not in heap.__dict__:
        heap.__dict__["points"] = written(V.suspects_descent(heap.tree), "points")
    return heap.__dict__["points"]


#: title, rows, in the order of the report.
SECTIONS: tuple[tuple[str, str, Callable[[Heap, Detail], DataFrame]], ...] = (
    ("triage", "Triage", lambda h, d: triage.evaluate(triage.facts_of(h.tree, h.roots)).orderBy("rank")),
    ("totals", "Heap totals", lambda h, d: V.heap_totals(h.tree)),
    ("concentration", "Retention concentration", lambda h, d: V.retention_concentration(h.tree)),
    ("depth", "Dominator depth", lambda h, d: V.depth_summary(h.tree).orderBy("depth")),
    ("composition", "Composition", lambda h, d: V.composition(h.tree).orderBy("object_kind", "reachable")),
    ("roots", "GC roots", lambda h, d: V.roots_by_type(h.roots).orderBy(F.desc("roots"), "root_type")),
    ("roots_retained", "GC roots by retained size", lambda h, d: V.roots_retained(h.tree, h.roots).orderBy(F.desc("retained"), "root_type")),
    ("histogram", "Class histogram", lambda h, d: V.class_histogram(h.tree).orderBy(F.desc("retained"), "class_name", "loader")),
    ("suspects", "Leak suspects", lambda h, d: V.leak_suspects(h.tree).orderBy(F.desc("retained"), "class_name", "obj_id")),
    ("descent", "Accumulation points", lambda h, d: points(h)),
    ("point_children", "Children of accumulation points", lambda h, d: V.point_children(h.tree, points(h), d.leak_children).orderBy("point", "child_rank")),
    ("dominator_tree", "Dominator tree", lambda h, d: V.heaviest_nodes(h.tree, d.dom_nodes, d.dom_depth)),
    ("biggest_objects", "Biggest objects", lambda h, d: V.biggest_objects(h.tree, d.top_consumers)),
    ("biggest_classes", "Biggest classes", lambda h, d: V.biggest_classes(h.tree, d.top_consumers)),
    ("packages", "Packages", lambda h, d: V.package_tree(h.tree).orderBy("package")),
    ("components", "Components", lambda h, d: V.top_components(h.tree).orderBy(F.desc("component_retained"), "loader", "class_rank")),
    ("loaders", "Class loaders", lambda h, d: V.loader_rollup(h.tree, d.top_consumers)),
    ("duplicate_classes", "Duplicate classes", lambda h, d: V.duplicate_classes(h.tree, d.top_consumers)),
    ("big_drops", "Big drops", lambda h, d: V.big_drops(h.tree)),
    ("immediate_dominators", "Immediate dominators", lambda h, d: V.immediate_dominators(h.tree)),
    ("merged_paths", "Merged paths to roots", lambda h, d: V.merged_root_paths(h.tree)),
    ("top_sizes", "Sizes of top-level objects", lambda h, d: V.top_sizes(h.tree).orderBy("retained_to")),
    ("arrays", "Arrays by length", lambda h, d: V.arrays_by_size(h.tree).orderBy("object_kind", "length_to")),
    ("boxed", "Boxed numbers", lambda h, d: V.boxed_numbers(h.tree).orderBy(F.desc("shallow"))),
    ("headers", "Header overhead", lambda h, d: V.header_overhead(h.tree)),
    ("alloc_sites", "Allocation sites", lambda h, d: V.allocation_sites(h.tree, d.alloc_top)),
    ("unreachable", "Unreachable objects", lambda h, d: V.unreachable_histogram(h.forest, h.tree)),
    ("garbage", "Garbage trees", lambda h, d: V.garbage_roots(h.forest, h.tree)),
)


def build(heap: Heap, source: str, detail: str = "default", more: dict[str, tuple[str, DataFrame]] | None = None) -> dict:
    """The report as plain values: version, source and sections of title, columns and rows. All lists are bounded."""
    level, sections = DETAILS[detail], {}
    for key, title, rows in SECTIONS:
        sections[key] = (title, rows(heap, level))
    sections |= more or {}
    out = {}
    for key, (title, frame) in sections.items():
        out[key] = {"title": title, "columns": frame.columns, "rows": [list(r) for r in frame.collect()]}
    return {"version": VERSION, "source": source, "sections": out}
