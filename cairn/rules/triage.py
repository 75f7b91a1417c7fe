"""Triage: rules over one row of facts about a heap, each with a severity and what it saw.

A rule is two column expressions over the facts, so all of them are one projection; a fact that wasn't
gathered (null) fires nothing. Thresholds are stated with their rules.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions import scalars as S
from cairn.operators import views as V
from cairn.plans.tables import one_row

CRITICAL, WARNING, INFO = "Critical", "Warning", "Info"


@dataclass(frozen=True)
class Rule:
    name: str
    severity: str
    fires: str
    says: str
    severity_if: str | None = None


def _mib(n: int) -> int:
    return n << 20


def _share(part: str, percent: float) -> str:
    return f"total > 0 AND {part} * 100.0 >= total * {percent}"


RULES = (
    Rule("headline-retainer", INFO, "true", "coalesce(suspect_name, biggest_name, 'no object stands out')", f"CASE WHEN {_share('suspect_retained', 50)} THEN '{CRITICAL}' WHEN suspect_retained IS NOT NULL THEN '{WARNING}' ELSE '{INFO}' END"),
    Rule("concentration", INFO, "true", "concat('the largest object retains ', coalesce(top1_bp, 0) / 100, ' %')", f"CASE WHEN {_share('suspect_retained', 50)} THEN '{CRITICAL}' ELSE '{INFO}' END"),
    Rule("gc-root-type", WARNING, "top_root_bp >= 5000", "concat(top_root_type, ' roots retain ', top_root_bp / 100, ' %')"),
    Rule("shape", INFO, "p90_depth IS NOT NULL", "CASE WHEN p90_depth <= 3 THEN 'shallow' ELSE 'deep' END"),
    Rule("one-leak-or-many", INFO, "top1_bp > 0 OR one_percent_objects >= 1", "concat(one_percent_objects, ' objects retain 1 % or more')"),
    Rule("object-swarm", WARNING, "swarm_class IS NOT NULL", "swarm_class"),
    Rule("boxed-primitive-bloat", INFO, f"boxed_instances >= 5000000 OR {_share('boxed_shallow', 5)}", "concat(boxed_instances, ' boxed numbers')"),
    Rule("classloader-leak", WARNING, "duplicate_classes > 0", "concat(duplicate_classes, ' classes in several loaders')"),
    Rule("classloader-explosion", WARNING, "loaders >= 1000", "concat(loaders, ' loaders')"),
    Rule("metaspace-pressure", WARNING, "classes >= 50000", "concat(classes, ' classes')"),
    Rule("threadlocal-leak", WARNING, "null_key_entries > 0", "concat(null_key_entries, ' entries without a key')"),
    Rule("thread-pinning", WARNING, f"({_share('max_thread_retained', 20)}) OR (max_thread_locals >= 100 AND {_share('max_thread_retained', 10)})", "concat('a thread retains ', max_thread_retained, ' bytes')"),
    Rule("thread-swarm", WARNING, "threads >= 1000", "concat(threads, ' threads')"),
    Rule("weak-ref-escape", INFO, "only_weak >= 1000", "concat(only_weak, ' objects only weakly held')"),
    Rule("proxy-lambda-bloat", INFO, "classes >= 200 AND anonymous_classes * 2 >= classes", "concat(anonymous_classes, ' generated classes')"),
    Rule("off-heap", WARNING, f"direct_buffer_bytes >= {_mib(64)}", "concat(direct_buffer_bytes, ' bytes outside the heap')"),
    Rule("gc-waste", WARNING, "fragmentation_bp >= 1000", "concat(fragmentation_bp / 100, ' % is garbage')"),
    Rule("static-field-anchor", WARNING, f"suspect_root = 'Sticky Class' AND {_share('suspect_retained', 20)}", "suspect_name"),
    Rule("jni-global-ref-leak", WARNING, f"jni_globals >= 5000 AND {_share('jni_retained', 5)}", "concat(jni_globals, ' native references')"),
    Rule("heap-composition-skew", INFO, "top_kind_bp >= 7000", "concat(top_kind, ' take ', top_kind_bp / 100, ' %')"),
    Rule("finalizer-queue-backlog", WARNING, "finalizers >= 10000", "concat(finalizers, ' finalizers')"),
    Rule("cached-reflection-metadata", INFO, "reflection_objects >= 500000", "concat(reflection_objects, ' reflection objects')"),
    Rule("session-scope-leak", WARNING, "max_sessions >= 100000", "concat(max_sessions, ' sessions')"),
    Rule("connection-leak", WARNING, "max_connections >= 1000", "concat(max_connections, ' connections')"),
    Rule("event-listener-accumulation", WARNING, "max_listeners >= 100000", "concat(max_listeners, ' listeners')"),
    Rule("parser-output-accumulation", INFO, "parser_objects >= 100000", "concat(parser_objects, ' parser objects')"),
    Rule("interned-string-bloat", WARNING, "strings >= 2000000 AND jni_globals >= 1000", "concat(strings, ' strings')"),
    Rule("duplicate-strings", INFO, f"string_waste >= {_mib(16)} OR {_share('string_waste', 5)}", "concat(string_waste, ' bytes of copies')"),
    Rule("char-array-slack", INFO, f"char_waste >= {_mib(16)} AND wasteful_char_arrays >= 1000", "concat(char_waste, ' bytes of slack')"),
    Rule("over-capacity-collections", INFO, _share("half_empty_waste", 5), "concat(half_empty_waste, ' bytes in half-empty collections')"),
    Rule("large-unbounded-collection", WARNING, f"largest_collection >= 1000000 OR {_share('largest_collection_retained', 20)}", "concat(largest_collection, ' elements')"),
    Rule("sparse-object-arrays", INFO, f"sparse_arrays >= 10000 AND {_share('sparse_waste', 5)}", "concat(sparse_arrays, ' sparse arrays')"),
    Rule("constant-value-arrays", INFO, f"constant_array_bytes >= {_mib(8)}", "concat(constant_array_bytes, ' bytes of constant arrays')"),
    Rule("big-drop-concentration", CRITICAL, f"top_drop >= {_mib(64)} AND {_share('top_drop', 5)}", "concat('one object holds ', top_drop, ' bytes in small pieces')"),
    Rule("fixed-per-object-overhead", WARNING, _share("objects * header", 20), "concat(objects, ' headers')"),
    Rule("hash-collision-hotspot", WARNING, "maps >= 100 AND full_maps > 0", "concat(full_maps, ' maps over 90 % full')"),
    Rule("empty-collection-cemetery", INFO, "empty_collections >= 500000 OR (collections > 0 AND empty_collections * 100 >= collections * 60)", "concat(empty_collections, ' empty collections')"),
    Rule("oversized-prim-array", WARNING, f"largest_prim_array >= {_mib(64)} AND {_share('largest_prim_array', 5)}", "concat(largest_prim_array, ' bytes in one array')"),
    Rule("dup-prim-arrays", WARNING, f"array_waste >= {_mib(16)} OR {_share('array_waste', 5)}", "concat(array_waste, ' bytes of equal arrays')"),
)

FACTS = {
    **dict.fromkeys(("suspect_name", "biggest_name", "top_root_type", "swarm_class", "suspect_root", "top_kind"), "string"),
    **dict.fromkeys(
        "total suspect_retained top_root_bp p90_depth top1_bp one_percent_objects boxed_instances boxed_shallow duplicate_classes loaders classes null_key_entries max_thread_retained max_thread_locals threads only_weak anonymous_classes direct_buffer_bytes fragmentation_bp jni_globals jni_retained top_kind_bp finalizers reflection_objects max_sessions max_connections max_listeners parser_objects strings string_waste char_waste wasteful_char_arrays half_empty_waste largest_collection largest_collection_retained sparse_arrays sparse_waste constant_array_bytes top_drop objects header maps full_maps empty_collections collections largest_prim_array array_waste".split(),
        "long",
    ),
}


def evaluate(facts: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """rank, rule, severity, evidence of the rules that fire, in their order."""
    for name, kind in FACTS.items():
        if name not in facts.columns:
            facts = facts.withColumn(name, F.lit(None).cast(kind))
    each = [F.struct(F.lit(i + 1).alias("rank"), F.lit(r.name).alias("rule"), F.expr(r.severity_if or f"'{r.severity}'").alias("severity"), F.expr(f"cast({r.says} as string)").alias("evidence"), F.expr(f"coalesce({r.fires}, false)").alias("fires")) for i, r in enumerate(rules)]
    return facts.select(F.explode(F.array(*each)).alias("r")).where("r.fires").select("r.rank", "r.rule", "r.severity", "r.evidence")


# Packages whose objects are what a parser left.
PARSERS = ("org.w3c.dom.", "com.fasterxml.jackson.", "com.google.gson.", "org.dom4j.", "org.jdom.", "nu.xom.", "javax.xml.", "jakarta.xml.")


def facts_of(tree: DataFrame, roots: DataFrame, header: int = 12) -> DataFrame:
    """The facts that the objects, their classes and the dominator tree give."""
    hist = V.class_histogram(tree)
    name, n = F.col("class_name"), F.col("instances")
    most = lambda cond: F.max(F.when(cond, n))
    object_ = ~name.endswith("[]")
    total = V.reached(tree).agg(F.sum("shallow").alias("total"), F.count("*").alias("objects"), F.max(F.when(F.col("kind") == S.PRIMITIVE_ARRAY, F.col("shallow"))).alias("largest_prim_array"))
    by_class = hist.crossJoin(F.broadcast(total.select("total"))).agg(
        F.max(F.when((n >= 10_000_000) & (F.col("shallow") <= 64 * n) & (F.col("shallow") * 10 >= F.col("total")) & ~name.endswith("[]"), name)).alias("swarm_class"),
        F.sum(F.when(name.isin(*[b for b in V.BOXED if "Big" not in b]), n)).alias("boxed_instances"),
        F.sum(F.when(name.isin(*[b for b in V.BOXED if "Big" not in b]), F.col("shallow"))).alias("boxed_shallow"),
        F.countDistinct("loader").alias("loaders"), F.count("*").alias("classes"), F.count_if(S.is_anonymous(name)).alias("anonymous_classes"),
        most(name == "java.lang.ref.Finalizer").alias("finalizers"),
        F.sum(F.when(name.isin("java.lang.reflect.Method", "java.lang.reflect.Field", "java.lang.reflect.Constructor"), n)).alias("reflection_objects"),
        most(name.contains("Session") & object_).alias("max_sessions"),
        most(name.rlike("Connection|Socket") & ~name.rlike("Weak|Reference") & object_).alias("max_connections"),
        most(name.rlike("Listener|Observer|Subscriber") & object_).alias("max_listeners"),
        most(F.greatest(*[name.startswith(p) for p in PARSERS]) & object_).alias("parser_objects"),
        most(name == "java.lang.String").alias("strings"),
    )
    kinds = V.composition(tree).where("reachable").crossJoin(F.broadcast(total.select("total")))
    kind = kinds.agg(F.max_by("object_kind", "shallow").alias("top_kind"), F.max(S.basis_points("shallow", "total")).alias("top_kind_bp"))
    retained = V.roots_retained(tree, roots)
    held = retained.crossJoin(F.broadcast(total.select("total"))).agg(F.max_by("root_type", "retained").alias("top_root_type"), F.max(S.basis_points("retained", "total")).alias("top_root_bp"), F.sum(F.when(F.col("root_type") == "JNI Global", F.col("roots"))).alias("jni_globals"), F.sum(F.when(F.col("root_type") == "JNI Global", F.col("retained"))).alias("jni_retained"))
    tags = roots.groupBy("obj_id").agg(F.min("root_tag").alias("tag"))
    suspect = V.leak_suspects(tree).withColumn("k", F.row_number().over(W.orderBy(F.desc("retained"), "class_name", "obj_id"))).where("k = 1").join(tags, "obj_id", "left").select(F.col("class_name").alias("suspect_name"), F.col("retained").alias("suspect_retained"), S.root_label("tag").alias("suspect_root"))
    return one_row(
        total.withColumn("header", F.lit(header).cast("long")),
        by_class, kind, held, suspect.agg(F.first("suspect_name").alias("suspect_name"), F.first("suspect_retained").alias("suspect_retained"), F.first("suspect_root").alias("suspect_root")),
        V.retention_concentration(tree).select("top1_bp", "one_percent_objects"),
        V.depth_summary(tree).agg(F.max("p90_depth").alias("p90_depth")),
        V.heap_totals(tree).select("fragmentation_bp"),
        V.biggest_objects(tree, 1).agg(F.first("class_name").alias("biggest_name")),
        V.duplicate_classes(tree).agg(F.count("*").alias("duplicate_classes")),
        V.big_drops(tree, 1).agg(F.max("drop").alias("top_drop")),
    )
