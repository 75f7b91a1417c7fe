import struct

import pytest

from cairn.plans.tables import one_row
from cairn.operators import contents as C
from cairn.operators import views
from cairn.plans import dump as D
from cairn.plans import dump_views as DV
from cairn.sources.collections import BUILT_IN, descriptors, parse_config
from cairn.sources import hprof
from cairn.sources.hprof import SCHEMAS, DumpError, HprofReader, is_dump
from tests.dump_writer import DumpWriter, sample


@pytest.fixture(scope="module", params=[8, 4])
def dump(spark, tmp_path_factory, request):
    path = sample(request.param).write(tmp_path_factory.mktemp("d") / ("a.hprof" if request.param == 8 else "a.hprof.gz"))
    return D.open_relations(spark, path)


def test_relations(dump):
    assert dump.dump_info.first().format == "JAVA PROFILE 1.0.2"
    assert {r.record: r.n for r in dump.census.collect()}["heap_segments"] == 2
    assert dump.instances.count() == 18 and dump.obj_arrays.count() == 2 and dump.prim_arrays.count() == 9
    kinds = {r.addr: r.class_addr for r in dump.instances.collect()}
    assert kinds[0x10A00] == 0x9000  # of a repeated address the first
    assert sorted((r.root_tag, r.addr) for r in dump.gc_roots.collect())[:1] == [(1, 0x10900)]
    assert dump.thread_locals.first().addr == 0x10300
    sub = {r.class_addr: r for r in dump.classes.collect()}[0x9040]
    assert [(s.type, s.value) for s in sub.statics] == [(2, 0x11000), (10, 5)] and sub.loader_addr == 0x20000


def test_field_plan_is_subclass_first(dump):
    plan = {(r.declared, r.field): r.offset for r in D.field_plan(dump).where(f"class_addr = {0x9040}").collect()}
    n = dump.id_size
    assert plan == {("Sub", "extra"): 0, ("Sub", "name"): 4, ("java/lang/Thread", "eetop"): 4 + n, ("java/lang/Thread", "name"): 12 + n}


def test_sizes(dump):
    size = {r.class_addr: r.size for r in D.instance_sizes(dump).collect()}
    p, r = dump.id_size, dump.ref_size
    up = lambda x, to: -(-x // to) * to
    base = p + r
    thread = up(base + 8 + r, r)
    assert size[0x9000] == up(base, 8) and size[0x9030] == up(thread, 8) and size[0x9040] == up(up(thread + 4 + r, r), 8)


def test_heap(dump):
    heap = D.heap_of_dump(dump)
    tree = {r.obj_id: r for r in heap.tree.collect()}
    assert tree[0x10000].idom == -1 and tree[0x10100].idom == 0x10000 and tree[0x10200].idom == 0x10100
    assert tree[0x10300].idom == 0x10000 and tree[0x10400].idom == 0x10300  # a thread's local hangs from the thread
    assert tree[0x10A00].idom == 0x10900 and tree[0x11000].idom == 0x9040 and tree[0x12000].idom is None
    assert tree[0x10300].retained == sum(tree[a].shallow for a in (0x10300, 0x10400, 0x10500, 0x10600, 0x10700, 0x10800))
    assert tree[0x10000].class_name == "Sub" and tree[0x10000].loader.startswith("java/lang/Object@")
    found = {r.obj_id: r.retained for r in heap.forest.collect()}
    garbage = {0x12000, 0x12100, 0x14000, 0x14100, 0x14200, 0x14300} | {a for a in (0xA010, 0xA020, 0xA030, 0xA040, 0xA050, 0xA060) if tree[a].idom is None}
    assert set(found) == garbage and found[0x12000] == tree[0x12000].shallow + tree[0x12100].shallow and found[0x12100] == tree[0x12100].shallow
    weak = D.heap_of_dump(dump, exclude_referents=True)
    assert {r.obj_id for r in weak.tree.where("idom IS NULL").collect()} == {0x10A00, *garbage}
    totals = views.heap_totals(heap.tree).first()
    assert totals.reachable + totals.unreachable == len(tree) and totals.unreachable == len(garbage)
    hist = {r.class_name: r.instances for r in views.class_histogram(heap.tree).collect()}
    assert hist["java.lang.String"] == 6 and hist["byte[]"] == 6 and hist["java.lang.Class"] >= 10
    assert {r.root_type: r.roots for r in views.roots_by_type(heap.roots).collect()} == {"JNI Global": 1, "Sticky Class": 10, "Thread": 1}


def test_strings_threads_collections(dump, spark):
    assert {r.value for r in D.java_strings(dump).collect()} == {"main", "café", "žluť", "xx", "os", "linux", "user"}
    heap = D.heap_of_dump(dump)
    row = D.threads(dump, heap.tree).collect()
    assert len(row) == 1 and row[0].name == "main" and row[0].locals == 1
    assert row[0].frames == ["Sub.run(Main.java:12)", "java.lang.Thread.park(Native Method)"]
    assert [r.class_name for r in D.locals_by_frame(dump, heap.tree).collect()] == ["java.util.ArrayList"]
    found = D.collections_of(dump, descriptors(spark, BUILT_IN), heap.nodes).collect()
    assert sorted((r.kind, r.elements, r.capacity, r.used) for r in found) == [("List", 2, 4, 2), ("Map", 2, 2, 1)]


def test_views_of_fields(dump, spark):
    heap = D.heap_of_dump(dump)
    assert [(r.key, r.value) for r in DV.system_properties(dump).collect()] == [("os", "linux"), ("user", "linux")]
    assert [(r.kind, r.class_name, r.reachable) for r in DV.reference_rows(dump, heap.tree).collect()] == [("Weak", "java.lang.Object", True)]
    found = D.collections_of(dump, descriptors(spark, BUILT_IN), heap.nodes)
    facts = one_row(DV.facts_always(dump, heap.tree), DV.facts_of_duplicates(dump), DV.facts_of_collections(dump, heap.tree, found)).first()
    assert (facts.null_key_entries, facts.direct_buffer_bytes, facts.only_weak, facts.collections, facts.threads, facts.maps) == (1, 4096, 0, 2, 1, 1)
    assert facts.array_waste == 16 and facts.constant_array_bytes == 32 + 2
    copies = DV.duplicate_primitive_arrays(dump).collect()
    assert [(r.class_name, r.groups, r.arrays, r.wasted) for r in copies] == [("int[]", 1, 2, 16)]
    constant = {(r.class_name, r.length, r.value): r.objects for r in DV.constant_primitive_arrays(dump).collect()}
    assert constant == {("int[]", 4, "00000007"): 2, ("byte[]", 2, "78"): 1}
    frames = DV.allocation_frames(dump, views.allocation_sites(heap.tree)).collect()
    assert [(r.alloc_serial, r.objects, r.frame) for r in frames] == [(1, 2, "Sub.run(Main.java:12)")]
    values = DV.contents_of(dump, found, heap.tree)
    assert {(r.kind, r.types) for r in C.biggest_collections(found, values).collect()} == {("List", "java.lang.String:2"), ("Map", "java.util.Hashtable$Entry:1")}
    held = {(r.holder, r.field) for r in DV.held_objects(dump, heap.tree).collect()}
    assert ("java.util.ArrayList", "elementData") in held and ("Sub", "name") in held
    assert DV.holders_of(dump, heap.tree, D.java_strings(dump)).first().refs >= 1
    assert {r.bucket: r.objects for r in DV.array_fill(dump, heap.nodes).where("objects > 0").collect()} == {4: 2}


def test_broken_files(tmp_path):
    (tmp_path / "x.txt").write_bytes(b"hello")
    with pytest.raises(DumpError, match="no heap dump"):
        HprofReader(str(tmp_path / "x.txt"), "instances").partitions()
    assert not is_dump(str(tmp_path / "x.txt"))
    data = sample().bytes()
    (tmp_path / "cut").write_bytes(data[: len(data) - 60])
    assert is_dump(str(tmp_path / "cut"))
    reader = HprofReader(str(tmp_path / "cut"), "instances")
    with pytest.raises(DumpError, match="cut off"):
        [list(reader.read(p)) for p in reader.partitions()]
    w = DumpWriter()
    w.heap.append(b"\x99abc")
    (tmp_path / "odd").write_bytes(w.bytes())
    reader = HprofReader(str(tmp_path / "odd"), "gc_roots")
    with pytest.raises(DumpError, match="unknown sub-record 0x99"):
        [list(reader.read(p)) for p in reader.partitions()]


def read(path, relation):
    reader = HprofReader(path, relation)
    return [row for part in reader.partitions() for batch in reader.read(part) for row in batch.to_pylist()]


@pytest.mark.parametrize("window", [1, 7, 64, 1 << 20])
def test_windows_and_batches(tmp_path, monkeypatch, window):
    """Records that lie across windows, batches of few rows, one pass against one for each relation, another file system."""
    path = sample().write(tmp_path / "a.hprof")
    whole = {relation: read(path, relation) for relation in SCHEMAS}
    monkeypatch.setattr(hprof, "WINDOW", window)
    monkeypatch.setattr(hprof, "BATCH_BYTES", 200)
    every = read(f"file://{path}", "all")
    for relation, rows in whole.items():
        names = ["kind" if c == "record" else c for c in hprof.columns_of(relation)]
        found = [tuple(row[c] for c in names) for row in every if row["record"] == relation]
        wanted = [tuple(row.values()) for row in rows]
        if relation == "dump_info":
            assert [r[:3] for r in found] == [r[:3] for r in wanted]
        else:
            assert found == wanted and read(path, relation) == rows
    assert len(every) == sum(map(len, whole.values()))


def test_serials_beyond_the_sign(tmp_path):
    w = DumpWriter()
    w.cls(0x9000, "A", serial=0xFFFFFFFE)
    w.instance(0x10000, 0x9000, b"", serial=0xFFFFFFFF)
    path = w.write(tmp_path / "a.hprof")
    assert read(path, "load_class")[0]["serial"] == -2 and read(path, "instances")[0]["alloc_serial"] == -1


def test_thread_states(spark, tmp_path):
    """A thread with fields of its own, one that keeps them in another object, one with none of them."""
    w = DumpWriter()
    w.cls(0x9000, "java/lang/Thread", fields=[("name", 2), ("holder", 2), ("daemon", 4), ("priority", 10), ("threadStatus", 10)])
    w.cls(0x9100, "java/lang/Thread$FieldHolder", fields=[("priority", 10), ("daemon", 4), ("threadStatus", 10)])
    w.cls(0x9200, "Worker", 0x9000, fields=[("n", 10)])
    w.instance(0x10000, 0x9000, struct.pack(">QQBii", 0, 0, 1, 5, 5))
    w.instance(0x10100, 0x9200, struct.pack(">iQQBii", 9, 0, 0x10200, 0, 0, 0))
    w.instance(0x10200, 0x9100, struct.pack(">iBi", 7, 1, 2))
    dump = D.open_relations(spark, w.write(tmp_path / "a.hprof"))
    found = {r.addr: (r.is_daemon, r.priority) for r in D.thread_states(dump).collect()}
    assert found[0x10000] == (True, 5) and found[0x10100] == (True, 7)
    states = {r.addr: r.state for r in D.thread_states(dump).collect()}
    assert states[0x10000] != "unknown" and states[0x10100] != "unknown" and states[0x10000] != states[0x10100]


def test_config():
    mine = parse_config('[[collection]]\nclass = "com/x/Bag"\nkind = "Set"\nsize_field = "com/x/Bag#n"\narray_field = "com/x/Bag#items"\n')
    assert mine == [("com/x/Bag", "Set", "com/x/Bag", "n", "com/x/Bag", "items")]
    with pytest.raises(ValueError):
        parse_config('[[collection]]\nclass = "x"\nkind = "Heap"\n')
