"""From a heap dump's relations to a heap: sizes, class rows, edges, roots, threads."""

from __future__ import annotations

import functools
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cairn.functions import scalars as S
from cairn.operators.graph import dominator_tree, union_edges, unreachable_forest
from cairn.operators.views import compressed_references
from cairn.plans.tables import written
from cairn.sources.hprof import SCHEMAS, HprofSource, columns_of
from cairn.sources.relational import Heap

# Fields through which the collector doesn't keep objects alive, as (class, field).
WEAK_FIELDS = (("java/lang/ref/Reference", "referent"), ("java/lang/ref/Finalizer", "unfinalized"), ("java/lang/Runtime", "<Unfinalized>"))


@dataclass
class Dump:
    """A dump's relations, decoded once, and what is derived of its classes."""

    path: str
    tables: dict[str, DataFrame]
    id_size: int
    ref_size: int
    made: dict[str, DataFrame] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(name) from None


def open_relations(spark: SparkSession, path: str) -> Dump:
    """All relations, decoded in one pass into one table with a folder for each, so that every later scan reads only the
    folder and the columns it needs."""
    spark.dataSource.register(HprofSource)
    writers = "spark.sql.maxConcurrentOutputFileWriters"  # one for each relation: rows needn't be sorted by it
    before = spark.conf.get(writers)
    spark.conf.set(writers, len(SCHEMAS))
    try:
        decoded = written(spark.read.format("hprof").option("relation", "all").load(path), "relations", by=("record",))
    finally:
        spark.conf.set(writers, before)
    tables = {r: decoded.where(F.col("record") == r).select(*[F.col("kind").alias(c) if c == "record" else F.col(c) for c in columns_of(r)]) for r in SCHEMAS}
    for r, key in (("instances", "addr"), ("obj_arrays", "addr"), ("prim_arrays", "addr"), ("classes", "class_addr")):
        first = tables[r].groupBy(key).agg(F.min("file_off").alias("file_off"))  # of repeated addresses the first
        tables[r] = tables[r].join(first, [key, "file_off"], "left_semi")
    id_size = tables["dump_info"].first().id_size
    small = id_size == 4 or compressed_references(tables["obj_arrays"].select("addr", F.size("refs").cast("long").alias("elements")), id_size).first().compressed
    return Dump(path, tables, id_size, 4 if small else id_size)


def once(f: Callable[[Dump], DataFrame]) -> Callable[[Dump], DataFrame]:
    """Work a table of a dump out once and write it: many analyses start from it."""

    @functools.wraps(f)
    def run(dump: Dump) -> DataFrame:
        if f.__name__ not in dump.made:
            dump.made[f.__name__] = written(f(dump), f.__name__)
        return dump.made[f.__name__]

    return run


@once
def class_names(dump: Dump) -> DataFrame:
    """class_addr, raw_name: the name that was loaded for an address; the address itself where none was."""
    named = dump.load_class.groupBy("class_addr").agg(F.min("name_id").alias("str_id")).join(dump.utf8_strings, "str_id", "left").select("class_addr", "value")
    return dump.classes.join(named, "class_addr", "left").select("class_addr", F.coalesce("value", F.concat(F.lit("class@"), F.hex("class_addr"))).alias("raw_name"))


@once
def super_chain(dump: Dump) -> DataFrame:
    """class_addr, over (the class or one above it), up (steps): ways that are known are doubled each round, so
    chains of any length take few rounds."""
    known = dump.classes.select(F.col("class_addr").alias("over"))
    jumps = written(dump.classes.where("super_addr <> 0").select("class_addr", F.col("super_addr").alias("over")).join(known, "over", "left_semi").select("class_addr", "over"), "super-jumps")
    found, step = written(dump.classes.select("class_addr", F.col("class_addr").alias("over"), F.lit(0).alias("up")), "super-chain"), 1
    while not jumps.isEmpty() and step < 1 << 31:
        further = found.join(jumps.select(F.col("class_addr").alias("over"), F.col("over").alias("next")), "over")
        found = written(found.unionByName(further.select("class_addr", F.col("next").alias("over"), (F.col("up") + step).alias("up"))), "super-chain")
        jumps = written(jumps.join(jumps.select(F.col("class_addr").alias("over"), F.col("over").alias("next")), "over").select("class_addr", F.col("next").alias("over")), "super-jumps")
        step *= 2
        if step > 1 << 16:
            raise ValueError("a class is above itself")
    return found


@once
def field_plan(dump: Dump) -> DataFrame:
    """class_addr, declared (class), field, type, offset in the blob: subclasses' fields come first."""
    names, strings = class_names(dump), dump.utf8_strings
    fields = super_chain(dump).join(dump.classes.select(F.col("class_addr").alias("over"), F.posexplode("fields").alias("pos", "f")), "over")
    width = F.when(F.col("f.type") == 2, dump.id_size).otherwise(S.element_width("f.type"))
    before = W.partitionBy("class_addr").orderBy("up", "pos").rowsBetween(W.unboundedPreceding, -1)
    plan = fields.withColumn("offset", F.coalesce(F.sum(width).over(before), F.lit(0)).cast("int"))
    plan = plan.join(names.select(F.col("class_addr").alias("over"), F.col("raw_name").alias("declared")), "over").join(strings.select(F.col("str_id").alias("name_id"), F.col("value").alias("field")), F.col("f.name_id") == F.col("name_id"), "left")
    weak = F.concat_ws("#", "declared", "field").isin(*["#".join(w) for w in WEAK_FIELDS])
    return plan.select("class_addr", "declared", F.coalesce("field", F.lit("?")).alias("field"), F.col("f.type").alias("type"), "offset", weak.alias("excluded"))


@once
def instance_sizes(dump: Dump) -> DataFrame:
    """class_addr, size of its instances: each class's own fields aligned over its super class's size."""
    own = dump.classes.select(F.col("class_addr").alias("over"), F.aggregate("fields", F.lit(0), lambda a, f: a + F.when(f["type"] == 2, dump.ref_size).otherwise(S.element_width(f["type"]))).alias("own"))
    levels = super_chain(dump).join(own, "over").groupBy("class_addr").agg(F.sort_array(F.collect_list(F.struct("up", "own")), asc=False).alias("levels"))
    start = dump.id_size + dump.ref_size
    grown = F.aggregate(F.slice("levels", 2, F.size("levels")), F.lit(start).cast("long"), lambda a, x: S.align_up(a + x["own"], dump.ref_size))
    return levels.select("class_addr", S.saturated(S.align_up(grown, 8)).alias("size"))


def objects(dump: Dump) -> DataFrame:
    """obj_id, class_row, raw_name, class_name, loader, kind, shallow, repr_row, alloc_serial, elements."""
    p, r = dump.id_size, dump.ref_size
    names, sizes = class_names(dump), instance_sizes(dump)
    none = F.lit(None).cast("long")
    inst = dump.instances.join(sizes, "class_addr", "left").select(F.col("addr").alias("obj_id"), F.col("class_addr").alias("class_row"), F.lit(S.INSTANCE).alias("kind"), F.coalesce("size", F.lit(-(-(p + r) // 8) * 8)).alias("shallow"), none.alias("repr_row"), "alloc_serial", none.alias("elements"))
    arrays = dump.obj_arrays.select(F.col("addr").alias("obj_id"), F.col("class_addr").alias("class_row"), F.lit(S.OBJECT_ARRAY).alias("kind"), S.object_array_size(F.size("refs"), p, r).alias("shallow"), none.alias("repr_row"), "alloc_serial", F.size("refs").cast("long").alias("elements"))
    prims = dump.prim_arrays.select(F.col("addr").alias("obj_id"), (-F.col("elem_type").cast("long")).alias("class_row"), F.lit(S.PRIMITIVE_ARRAY).alias("kind"), S.primitive_array_size("elements", S.element_width("elem_type"), p, r).alias("shallow"), none.alias("repr_row"), "alloc_serial", "elements")
    static = lambda refs: F.aggregate("statics", F.lit(0), lambda a, s: a + (F.when(s["type"] == 2, 1).otherwise(0) if refs else F.when(s["type"] == 2, 0).otherwise(S.element_width(s["type"]))))
    classes = dump.classes.select(F.col("class_addr").alias("obj_id"), F.lit(-100).cast("long").alias("class_row"), F.lit(S.CLASS_OBJECT).alias("kind"), S.class_object_size(static(False), static(True), r).alias("shallow"), F.col("class_addr").alias("repr_row"), F.lit(0).alias("alloc_serial"), none.alias("elements"))
    rows = inst.unionByName(arrays).unionByName(prims).unionByName(classes).withColumn("shallow", S.at_least_header("shallow", "kind", p, r)).withColumn("alloc_serial", F.col("alloc_serial").cast("long"))
    raw = F.when(F.col("class_row") == -100, F.lit("java/lang/Class")).when(F.col("class_row") < 0, S.primitive_array_name(-F.col("class_row"))).otherwise(F.col("raw_name"))
    loaders = dump.classes.select(F.col("class_addr").alias("class_row"), "loader_addr")
    kinds = dump.instances.select(F.col("addr").alias("loader_addr"), F.col("class_addr").alias("k")).join(loaders.select("loader_addr").distinct(), "loader_addr", "left_semi").join(names.select(F.col("class_addr").alias("k"), F.col("raw_name").alias("loader_class")), "k").select("loader_addr", "loader_class")
    label = F.when(F.coalesce("loader_addr", F.lit(0)) == 0, "<boot>").otherwise(F.concat(F.coalesce("loader_class", F.lit("?")), F.lit("@"), F.lower(F.hex("loader_addr"))))
    out = rows.join(names.withColumnRenamed("class_addr", "class_row"), "class_row", "left").join(loaders, "class_row", "left").join(kinds, "loader_addr", "left")
    out = out.select("obj_id", "class_row", F.coalesce(raw, F.lit("?")).alias("raw_name"), label.alias("loader"), "kind", "shallow", "repr_row", "alloc_serial", "elements")
    fold = out.select("class_row", "raw_name").distinct().where(S.is_foldable("raw_name")).groupBy("raw_name").agg(F.min("class_row").alias("fold"))
    return out.join(F.broadcast(fold), "raw_name", "left").withColumn("canon_row", F.coalesce("fold", "class_row")).drop("fold").withColumn("class_name", S.pretty_class_name("raw_name"))


@once
def field_references(dump: Dump) -> DataFrame:
    """src, dst, declared, field, excluded: each non-null reference in an instance's fields."""
    plan = field_plan(dump).where("type = 2").groupBy("class_addr").agg(F.collect_list(F.struct("declared", "field", "offset", "excluded")).alias("refs"))
    rows = dump.instances.join(plan, "class_addr").select(F.col("addr").alias("src"), "blob", F.explode("refs").alias("r"))
    return rows.select("src", S.big_endian("blob", F.col("r.offset"), dump.id_size).alias("dst"), "r.declared", "r.field", "r.excluded").where("dst <> 0")


def references(dump: Dump, exclude_referents: bool = False) -> DataFrame:
    """src, dst of all references between objects of the dump; weak ones are left out on demand."""
    held = field_references(dump)
    fields = (held.where("NOT excluded") if exclude_referents else held).select("src", "dst")
    own = dump.instances.select(F.col("addr").alias("src"), F.col("class_addr").alias("dst"))
    elements = dump.obj_arrays.select(F.col("addr").alias("src"), F.explode("refs").alias("dst")).where("dst <> 0")
    array_class = dump.obj_arrays.select(F.col("addr").alias("src"), F.col("class_addr").alias("dst"))
    classes = dump.classes.select(F.col("class_addr").alias("src"), F.explode(F.array_compact(F.concat(F.array("super_addr", "loader_addr"), F.transform("statics", lambda s: F.when(s["type"] == 2, s["value"]))))).alias("dst")).where("dst <> 0")
    threads = dump.thread_objs.join(dump.thread_locals.select("thread_serial", F.col("addr").alias("dst")), "thread_serial").select(F.col("addr").alias("src"), "dst").where("src <> dst")
    return union_edges(fields, own, elements, array_class, classes, threads)


def roots_of(dump: Dump, nodes: DataFrame) -> DataFrame:
    """obj_id, root_tag, is_synthetic: roots that are objects, the least tag of each.

    Without class roots in the dump, classes of the boot loader are ones; classes of primitive arrays always are,
    and only those count as ours."""
    own = dump.gc_roots.groupBy(F.col("addr").alias("obj_id")).agg(F.min("root_tag").alias("root_tag")).join(nodes.select("obj_id"), "obj_id", "left_semi").withColumn("is_synthetic", F.lit(False))
    names = class_names(dump)
    more = names.where(names.raw_name.rlike(r"^\[[ZCFDBSIJ]$")).select(F.col("class_addr").alias("obj_id"), F.lit(0).alias("root_tag"), F.lit(True).alias("is_synthetic"))
    if dump.gc_roots.where("root_tag = 5").isEmpty():
        boot = dump.classes.where("loader_addr = 0").join(names.where(~names.raw_name.startswith("[")), "class_addr").select(F.col("class_addr").alias("obj_id"), F.lit(0).alias("root_tag"), F.lit(False).alias("is_synthetic"))
        more = boot.unionByName(more)
    return own.unionByName(more.join(own, "obj_id", "left_anti"))


def heap_of_dump(dump: Dump, exclude_referents: bool = False) -> Heap:
    nodes = written(objects(dump), "nodes")
    ids = nodes.select("obj_id")
    edges = references(dump, exclude_referents)
    edges = written(edges.join(ids.withColumnRenamed("obj_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("obj_id", "dst"), "dst", "left_semi"), "edges")
    roots = written(roots_of(dump, nodes), "roots")
    tree = dominator_tree(nodes, edges, roots)
    return Heap(nodes, edges, roots, tree, written(unreachable_forest(tree, edges), "forest"))


def named_field(dump: Dump, declared: str, field: str) -> DataFrame:
    """addr, ref: one field's references, where both the field and its declaring class match."""
    return field_references(dump).where((F.col("declared") == declared) & (F.col("field") == field)).select(F.col("src").alias("addr"), F.col("dst").alias("ref"))


@once
def java_strings(dump: Dump) -> DataFrame:
    """obj_id, value, array (address), used, capacity of each string with characters."""
    plan = field_plan(dump).where("declared = 'java/lang/String'")
    coder = plan.where("field = 'coder'").select("class_addr", F.col("offset").alias("coder_at"))
    arrays = dump.prim_arrays.select(F.col("addr").alias("array"), "elem_type", "bytes")
    rows = named_field(dump, "java/lang/String", "value").select(F.col("addr").alias("obj_id"), F.col("ref").alias("array")).join(arrays, "array")
    blobs = dump.instances.join(coder, "class_addr").select(F.col("addr").alias("obj_id"), S.big_endian("blob", F.col("coder_at"), 1).alias("coder"))
    rows = rows.join(blobs, "obj_id", "left")
    # before compact strings the array is of chars
    kind = F.when(F.col("elem_type") == 5, 1).otherwise(F.coalesce("coder", F.lit(0)))
    text = S.decoded_string("bytes", kind)
    return rows.select("obj_id", text.alias("value"), "array", F.octet_length(text).cast("long").alias("used"), F.length("bytes").cast("long").alias("capacity"))


def thread_states(dump: Dump) -> DataFrame:
    """addr, is_daemon, priority, state of each thread: its own fields, or those of the object it keeps them in."""
    holder = "java/lang/Thread$FieldHolder"
    wanted = {"daemon": 1, "priority": 4, "threadStatus": 4}
    plan = field_plan(dump).where(F.col("declared").isin("java/lang/Thread", holder) & F.col("field").isin(*wanted))
    places = F.broadcast(plan.groupBy("class_addr").agg(*[F.max(F.when(F.col("field") == f, F.col("offset"))).alias(f) for f in wanted]))  # classes of threads
    own = dump.instances.join(places, "class_addr").select("addr", *[S.big_endian("blob", F.col(f), w).alias(f) for f, w in wanted.items()])
    held = named_field(dump, "java/lang/Thread", "holder").join(own.withColumnRenamed("addr", "ref"), "ref").drop("ref")
    first = own.unionByName(held).groupBy("addr").agg(*[F.max(f).alias(f) for f in wanted])
    return first.select("addr", (F.col("daemon") != 0).alias("is_daemon"), F.col("priority").cast("int").alias("priority"), S.thread_state("threadStatus").alias("state"))


def threads(dump: Dump, tree: DataFrame) -> DataFrame:
    """Threads that have frames: serial, name, object, retained size, locals, daemon, priority, state, and the frames as text."""
    names = java_strings(dump).select(F.col("obj_id").alias("ref"), F.col("value").alias("name"))
    held = named_field(dump, "java/lang/Thread", "name").join(names, "ref", "left").select("addr", "name")
    texts = dump.utf8_strings
    loaded = dump.load_class.join(texts, F.col("name_id") == F.col("str_id"), "left").select(F.col("serial").alias("class_serial"), F.col("value").alias("class_text"))
    frames = dump.stack_frames.join(loaded, "class_serial", "left").join(texts.select(F.col("str_id").alias("method_id"), F.col("value").alias("method")), "method_id", "left").join(texts.select(F.col("str_id").alias("source_id"), F.col("value").alias("source")), "source_id", "left")
    frames = frames.select("frame_id", S.frame_text(F.coalesce("class_text", F.lit("?")), F.coalesce("method", F.lit("?")), "source", "line").alias("text"))
    stacks = dump.stack_traces.where(F.size("frame_ids") > 0).select("thread_serial", F.posexplode("frame_ids").alias("k", "frame_id")).join(frames, "frame_id", "left")
    shown = stacks.groupBy("thread_serial").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", F.coalesce("text", F.lit("?")).alias("text")))), lambda x: x["text"]).alias("frames"))
    local = dump.thread_locals.groupBy("thread_serial").agg(F.countDistinct("addr").alias("locals"))
    rows = shown.join(dump.thread_objs.groupBy("thread_serial").agg(F.min("addr").alias("addr")), "thread_serial", "left").join(held, "addr", "left").join(local, "thread_serial", "left").join(thread_states(dump), "addr", "left")
    return rows.join(tree.select(F.col("obj_id").alias("addr"), "retained"), "addr", "left").select("thread_serial", "name", F.col("addr").alias("obj_id"), "retained", F.coalesce("locals", F.lit(0)).alias("locals"), "is_daemon", "priority", F.coalesce("state", F.lit("unknown")).alias("state"), "frames").orderBy("thread_serial")


def locals_by_frame(dump: Dump, tree: DataFrame, shown: int = 20) -> DataFrame:
    """The largest local objects of each thread's frames; those of no frame come last."""
    rows = dump.thread_locals.select("thread_serial", "frame_no", F.col("addr").alias("obj_id")).distinct().join(tree.select("obj_id", "class_name", "retained"), "obj_id")
    rank = F.row_number().over(W.partitionBy("thread_serial", "frame_no").orderBy(F.desc("retained"), "obj_id"))
    rows = rows.withColumn("k", rank).where(F.col("k") <= shown)
    return rows.orderBy("thread_serial", F.when(F.col("frame_no") < 0, 1 << 30).otherwise(F.col("frame_no")), "k")


def collections_of(dump: Dump, descriptors: DataFrame, nodes: DataFrame) -> DataFrame:
    """obj_id, class_name, kind, elements, capacity, shallow of known collections.

    descriptors: name, kind, size_class, size_field, array_class, array_field, rank. A class is described by the first
    match up its super classes. Without a size field the used slots of the array count."""
    names = class_names(dump)
    up = super_chain(dump).join(names.select(F.col("class_addr").alias("over"), F.col("raw_name").alias("name")), "over").join(F.broadcast(descriptors), "name")
    first = up.groupBy("class_addr").agg(F.min(F.struct("up", "rank", "kind", "size_class", "size_field", "array_class", "array_field")).alias("d")).select("class_addr", "d.*")
    plan = field_plan(dump)
    size = first.join(plan, "class_addr").where("declared = size_class AND field = size_field AND type IN (9, 10, 11)").select("class_addr", F.col("offset").alias("size_at"), F.col("type").alias("size_type"))
    array = first.join(plan, "class_addr").where("declared = array_class AND field = array_field").select("class_addr", F.col("offset").alias("array_at"))
    rows = dump.instances.join(first.select("class_addr", "kind"), "class_addr").join(size, "class_addr", "left").join(array, "class_addr", "left").where("size_at IS NOT NULL OR array_at IS NOT NULL")
    number = F.when(F.col("size_type") == 10, S.big_endian("blob", F.col("size_at"), 4).cast("long")).when(F.col("size_type") == 9, S.big_endian("blob", F.col("size_at"), 2)).otherwise(S.big_endian("blob", F.col("size_at"), 8))
    number = F.when((F.col("size_type") == 10) & (number >= 2**31), 0).when((F.col("size_type") == 9) & (number >= 2**15), 0).otherwise(F.greatest(number, F.lit(0)))
    rows = rows.select(F.col("addr").alias("obj_id"), "kind", F.when(F.col("size_at").isNotNull(), number).alias("size"), F.when(F.col("array_at").isNotNull(), S.big_endian("blob", F.col("array_at"), dump.id_size)).alias("array"))
    backing = dump.obj_arrays.select(F.col("addr").alias("array"), F.size("refs").cast("long").alias("capacity"), S.used_slots("refs").cast("long").alias("used"))
    rows = rows.join(backing, "array", "left").join(nodes.select("obj_id", "class_name", "shallow"), "obj_id")
    return rows.select("obj_id", "class_name", F.col("kind"), F.coalesce("size", "used", F.lit(0)).alias("elements"), "capacity", "used", "shallow", "array")
