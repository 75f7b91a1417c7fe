"""Analyses that need a dump's fields: references, collections' holders, arrays' contents, properties, allocations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.functions import scalars as S
from cairn.operators import contents as C
from cairn.plans import dump as D
from cairn.plans.tables import one_row, written

# Classes whose subclasses' objects refer weakly, and what the kind is called.
REFERENCE_KINDS = {"java/lang/ref/SoftReference": "Soft", "java/lang/ref/WeakReference": "Weak", "java/lang/ref/PhantomReference": "Phantom", "java/lang/ref/FinalReference": "Final"}
HOPS, PROPERTIES = 64, 4096


def class_kinds(dump: D.Dump, kinds: dict[str, str]) -> DataFrame:
    """class_addr, kind: the nearest of ``kinds`` among a class and those above it."""
    named = D.class_names(dump).select(F.col("class_addr").alias("over"), "raw_name")
    known = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    up = D.super_chain(dump).join(named, "over").where(F.col("raw_name").isin(*kinds)).withColumn("kind", known[F.col("raw_name")])
    return up.groupBy("class_addr").agg(F.min(F.struct("up", "kind")).alias("m")).select("class_addr", "m.kind")


def reference_rows(dump: D.Dump, tree: DataFrame) -> DataFrame:
    """kind, class_name, shallow, reachable of each referent; for the histogram and for what is only weakly held."""
    refs = dump.instances.select(F.col("addr").alias("src"), "class_addr").join(class_kinds(dump, REFERENCE_KINDS), "class_addr")
    held = D.named_field(dump, "java/lang/ref/Reference", "referent").withColumnRenamed("addr", "src")
    rows = refs.join(held, "src").select("kind", F.col("ref").alias("obj_id")).distinct()
    return rows.join(tree.select("obj_id", "class_name", "shallow", F.col("idom").isNotNull().alias("reachable")), "obj_id").drop("obj_id")


def null_key_entries(dump: D.Dump) -> DataFrame:
    """How many entries of thread-local maps have lost their key."""
    names = D.class_names(dump).where(F.col("raw_name").endswith("ThreadLocal$ThreadLocalMap$Entry")).select("class_addr")
    entries = dump.instances.join(names, "class_addr").select("addr")
    keyed = D.named_field(dump, "java/lang/ref/Reference", "referent").select("addr")
    return entries.join(keyed, "addr", "left_anti").agg(F.count("*").alias("null_key_entries"))


def number_field(dump: D.Dump, declared: str, field: str) -> DataFrame:
    """addr, number of an int or long field; negative ones count as 0."""
    plan = D.field_plan(dump).where((F.col("declared") == declared) & (F.col("field") == field) & F.col("type").isin(10, 11))
    rows = dump.instances.join(plan.select("class_addr", "offset", "type"), "class_addr")
    narrow = S.big_endian("blob", F.col("offset"), 4)
    value = F.when(F.col("type") == 10, F.when(narrow >= 2**31, 0).otherwise(narrow)).otherwise(F.greatest(S.big_endian("blob", F.col("offset"), 8), F.lit(0)))
    return rows.select("addr", value.alias("number"))


def direct_buffer_bytes(dump: D.Dump) -> DataFrame:
    """Bytes outside the heap that direct buffers stand for."""
    own = dump.instances.join(D.class_names(dump).where("raw_name = 'java/nio/DirectByteBuffer'"), "class_addr").select("addr")
    return number_field(dump, "java/nio/Buffer", "capacity").join(own, "addr", "left_semi").agg(F.coalesce(F.sum("number"), F.lit(0)).alias("direct_buffer_bytes"))


def held_collections(dump: D.Dump, found: DataFrame, tree: DataFrame) -> DataFrame:
    """holder, field, container, elements, retained, kind, type: fields of any object that lead to a collection."""
    refs = D.field_references(dump).join(found.select(F.col("obj_id").alias("dst"), "elements", "kind", F.col("class_name").alias("type")), "dst")
    holders = tree.select(F.col("obj_id").alias("src"), F.col("class_name").alias("holder"))
    sizes = tree.select(F.col("obj_id").alias("dst"), F.coalesce("retained", F.lit(0)).alias("retained"))
    return refs.join(holders, "src").join(sizes, "dst").select("holder", "field", F.col("dst").alias("container"), "elements", "retained", "kind", "type")


def held_objects(dump: D.Dump, tree: DataFrame) -> DataFrame:
    """As ``held_collections`` for every pointee: what fields hold by retained size."""
    sizes = tree.where("idom IS NOT NULL").select(F.col("obj_id").alias("dst"), "retained", F.col("class_name").alias("type"))
    holders = tree.select(F.col("obj_id").alias("src"), F.col("class_name").alias("holder"))
    return D.field_references(dump).join(sizes, "dst").join(holders, "src").select("holder", "field", F.col("dst").alias("container"), "retained", "type")


def contents_of(dump: D.Dump, found: DataFrame, tree: DataFrame) -> DataFrame:
    """obj_id, value_class of what collections' backing arrays hold."""
    slots = found.select("obj_id", F.col("array").alias("addr")).join(dump.obj_arrays.select("addr", "refs"), "addr").select("obj_id", F.explode("refs").alias("ref")).where("ref <> 0")
    return slots.join(tree.select(F.col("obj_id").alias("ref"), F.col("class_name").alias("value_class")), "ref").select("obj_id", "value_class")


def array_fill(dump: D.Dump, nodes: DataFrame) -> DataFrame:
    arrays = dump.obj_arrays.select(F.col("addr").alias("obj_id"), "refs").join(nodes.select("obj_id", "shallow"), "obj_id")
    return C.array_fill_ratios(arrays, dump.ref_size)


def primitive_contents(dump: D.Dump) -> DataFrame:
    """class_name, bytes, first (the first element's bytes), elements, owner of primitive arrays with elements."""
    width = S.element_width("elem_type")
    owners = D.field_references(dump).groupBy(F.col("dst").alias("addr")).agg(F.min(F.concat_ws("#", "declared", "field")).alias("owner"))
    rows = dump.prim_arrays.where("elements > 0").join(owners, "addr", "left")
    return rows.select(F.col("addr").alias("obj_id"), F.concat(S.element_type("elem_type"), F.lit("[]")).alias("class_name"), "bytes", F.substring(F.col("bytes"), F.lit(1), width).alias("first"), F.col("elements").cast("int").alias("elements"), "owner")


def duplicate_primitive_arrays(dump: D.Dump) -> DataFrame:
    """By type: groups of arrays of the same bytes, and what all but one of each take."""
    same = dump.prim_arrays.where("elements > 0").groupBy("elem_type", "bytes").agg(F.count("*").alias("n")).where("n > 1")
    return same.groupBy(F.concat(S.element_type("elem_type"), F.lit("[]")).alias("class_name")).agg(F.count("*").alias("groups"), F.sum("n").alias("arrays"), F.sum((F.col("n") - 1) * F.length("bytes")).alias("wasted")).orderBy(F.desc("wasted"), "class_name")


def constant_primitive_arrays(dump: D.Dump) -> DataFrame:
    """Arrays of two elements or more that are all equal: type, length, value (hex), objects, bytes, main owner."""
    # moved on by one element, an array of equal ones is itself
    width = F.length("first")
    same = F.substring(F.col("bytes"), width + 1, F.length("bytes") - width) == F.substring(F.col("bytes"), F.lit(1), F.length("bytes") - width)
    rows = primitive_contents(dump).where((F.col("elements") >= 2) & same)
    each = rows.groupBy("class_name", F.col("elements").alias("length"), F.hex("first").alias("value"), "owner").agg(F.count("*").alias("n"), F.sum(F.length("bytes")).alias("b"))
    sums = each.groupBy("class_name", "length", "value").agg(F.sum("n").alias("objects"), F.sum("b").alias("bytes"), F.min(F.struct((-F.col("n")).alias("m"), "owner")).alias("o"))
    return sums.select("class_name", "length", "value", "objects", "bytes", F.col("o.owner").alias("main_owner")).orderBy(F.desc("bytes"), F.desc("objects"), "class_name", "length", "value")


def holders_of(dump: D.Dump, tree: DataFrame, targets: DataFrame, top: int = 25) -> DataFrame:
    """Classes by how many references in their fields lead to the targets."""
    fields = D.field_references(dump).join(tree.select(F.col("obj_id").alias("src"), F.col("class_name").alias("holder")), "src").select("holder", F.col("dst").alias("ref"))
    return C.holder_ranking(fields, targets, top)


def allocation_frames(dump: D.Dump, sites: DataFrame) -> DataFrame:
    """Allocation sites (alloc_serial, measures) with the topmost frame of their stack as text."""
    texts = dump.utf8_strings
    loaded = dump.load_class.join(texts, F.col("name_id") == F.col("str_id"), "left").select(F.col("serial").alias("class_serial"), F.col("value").alias("class_text"))
    top = dump.stack_traces.where(F.size("frame_ids") > 0).select(F.col("stack_serial").cast("long").alias("alloc_serial"), F.element_at("frame_ids", 1).alias("frame_id"))
    frames = top.join(dump.stack_frames, "frame_id").join(loaded, "class_serial", "left").join(texts.select(F.col("str_id").alias("method_id"), F.col("value").alias("method")), "method_id", "left").join(texts.select(F.col("str_id").alias("source_id"), F.col("value").alias("source")), "source_id", "left")
    text = S.frame_text(F.coalesce("class_text", F.lit("?")), F.coalesce("method", F.lit("?")), "source", "line")
    return sites.join(frames.select("alloc_serial", text.alias("frame")), "alloc_serial", "left")


def system_properties(dump: D.Dump) -> DataFrame:
    """key, value of java.lang.System's properties, where they are kept in a table of chained entries.

    Chains are followed one step a round, 64 at most; at most 4096 properties."""
    names = D.class_names(dump).where("raw_name = 'java/lang/System'").select("class_addr")
    static = dump.classes.join(names, "class_addr").select(F.explode("statics").alias("s")).where("s.type = 2 AND s.value <> 0")
    props = static.join(dump.utf8_strings, F.col("s.name_id") == F.col("str_id")).where("value = 'props'").select(F.col("s.value").alias("addr"))
    table = D.named_field(dump, "java/util/Hashtable", "table").join(props, "addr", "left_semi").select(F.col("ref").alias("addr"))
    entry = "java/util/Hashtable$Entry"
    at = written(dump.obj_arrays.join(table, "addr", "left_semi").select(F.explode("refs").alias("addr")).where("addr <> 0"), "entries")
    follow = written(D.named_field(dump, entry, "next"), "next-entries")
    every = at
    for _ in range(HOPS):
        at = written(follow.join(at, "addr", "left_semi").select(F.col("ref").alias("addr")).join(every, "addr", "left_anti"), "entries")
        if at.isEmpty():
            break
        every = written(every.unionByName(at), "all-entries")
    texts = D.java_strings(dump).select(F.col("obj_id").alias("ref"), F.col("value").alias("text"))
    part = lambda f: D.named_field(dump, entry, f).join(texts, "ref").select("addr", F.col("text").alias(f))
    return every.join(part("key"), "addr").join(part("value"), "addr").select("key", "value").distinct().orderBy("key", "value").limit(PROPERTIES)


def facts_always(dump: D.Dump, tree: DataFrame) -> DataFrame:
    """The facts for triage that any analysis gathers from fields: one row."""
    weak = C.only_weakly_retained(reference_rows(dump, tree)).agg(F.coalesce(F.sum("objects"), F.lit(0)).alias("only_weak"))
    stacks = D.threads(dump, tree).agg(F.count("*").alias("threads"), F.max("retained").alias("max_thread_retained"), F.max("locals").alias("max_thread_locals"))
    return one_row(null_key_entries(dump), direct_buffer_bytes(dump), weak, stacks)


def facts_of_duplicates(dump: D.Dump) -> DataFrame:
    """The facts for triage about strings and arrays of equal contents: one row."""
    texts = D.java_strings(dump)
    slack = C.char_array_waste(texts.select(F.col("array").alias("obj_id"), "used", "capacity").distinct())
    return one_row(
        C.string_stats(texts).select(F.coalesce("wasted", F.lit(0)).alias("string_waste")),
        slack.select(F.coalesce("wasted", F.lit(0)).alias("char_waste"), F.col("wasteful").alias("wasteful_char_arrays")),
        duplicate_primitive_arrays(dump).agg(F.coalesce(F.sum("wasted"), F.lit(0)).alias("array_waste")),
    )


def facts_of_collections(dump: D.Dump, tree: DataFrame, found: DataFrame) -> DataFrame:
    """The facts for triage about collections and arrays: one row."""
    sized = found.join(tree.select("obj_id", "retained"), "obj_id")
    half = (F.col("capacity") > 0) & (F.col("elements") * 2 <= F.col("capacity"))
    held = sized.agg(
        F.count("*").alias("collections"), F.count_if(F.col("elements") == 0).alias("empty_collections"), F.max("elements").alias("largest_collection"), F.max("retained").alias("largest_collection_retained"),
        F.coalesce(F.sum(F.when(half, (F.col("capacity") - F.col("elements")) * dump.ref_size)), F.lit(0)).alias("half_empty_waste"),
        F.count_if(F.col("kind") == "Map").alias("maps"), F.count_if((F.col("kind") == "Map") & (F.col("used") * 10 > F.col("capacity") * 9)).alias("full_maps"),
    )
    sparse = array_fill(dump, tree).where("bucket <= 1").agg(F.sum("objects").alias("sparse_arrays"), F.sum("wasted").alias("sparse_waste"))
    return one_row(held, sparse, constant_primitive_arrays(dump).agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("constant_array_bytes")))
