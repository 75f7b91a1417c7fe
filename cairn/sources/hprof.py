"""A Spark data source for Java heap dumps in the HPROF format: one table for each kind of record.

    spark.dataSource.register(HprofSource)
    spark.read.format("hprof").option("relation", "instances").load(path)

The records of a file can only be found one after the other, but their lengths are known from the top level, so
the driver lists the heap segments by skipping over them and each becomes a task; other relations take one task. A
compressed file can't be entered in the middle and is one task. The path must be readable wherever tasks run; it may
name another file system than the local one, as a URI that pyarrow knows.

The relation "all" holds the rows of all the others in one pass, with the relation's name in ``record``. Tasks read
windows of a segment and give Arrow batches, so that they hold a window and a batch, or one record if that is larger.
"""

from __future__ import annotations

import gzip
import io
import struct
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Fixed values of the dump format: top-level tags.
STRING, LOAD_CLASS, UNLOAD_CLASS, STACK_FRAME, STACK_TRACE, HEAP_DUMP, HEAP_SEGMENT, HEAP_END = 0x01, 0x02, 0x03, 0x04, 0x05, 0x0C, 0x1C, 0x2C
# Fixed values of the dump format: element widths by type code; 2 is a reference.
WIDTHS = {4: 1, 5: 2, 6: 4, 7: 8, 8: 1, 9: 2, 10: 4, 11: 8}
# Fixed values of the dump format: sub-records of roots as (tag, references, four-byte numbers).
ROOTS = {0xFF: (1, 0), 0x01: (2, 0), 0x02: (1, 2), 0x03: (1, 2), 0x04: (1, 1), 0x05: (1, 0), 0x06: (1, 1), 0x07: (1, 0), 0x08: (1, 2)}

SCHEMAS = {
    "dump_info": "format string, id_size int, created_ms long, path string",
    "utf8_strings": "str_id long, value string",
    "load_class": "serial int, class_addr long, name_id long",
    "stack_frames": "frame_id long, method_id long, source_id long, class_serial int, line int",
    "stack_traces": "stack_serial int, thread_serial int, frame_ids array<long>",
    "classes": "class_addr long, super_addr long, loader_addr long, instance_size int, fields array<struct<name_id:long,type:int>>, statics array<struct<name_id:long,type:int,value:long>>, file_off long",
    "instances": "addr long, class_addr long, alloc_serial int, blob binary, file_off long",
    "obj_arrays": "addr long, class_addr long, alloc_serial int, refs array<long>, file_off long",
    "prim_arrays": "addr long, elem_type int, alloc_serial int, elements long, bytes binary, file_off long",
    "gc_roots": "addr long, root_tag int",
    "thread_locals": "thread_serial int, frame_no int, addr long, ord long",
    "thread_objs": "thread_serial int, addr long, stack_serial int",
    "census": "record string, n long",
}
WINDOW, BATCH_BYTES, ROW_BYTES = 16 << 20, 8 << 20, 64  # a row counts as so many bytes and its record
_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}
_CENSUS = {STRING: "strings", LOAD_CLASS: "load_class", UNLOAD_CLASS: "unload_class", STACK_FRAME: "stack_frames", STACK_TRACE: "stack_traces", HEAP_DUMP: "heap_segments", HEAP_SEGMENT: "heap_segments", HEAP_END: "heap_ends"}
_HEAP = {"classes", "instances", "obj_arrays", "prim_arrays", "gc_roots", "thread_locals", "thread_objs"}


def columns_of(relation: str) -> dict[str, str]:
    """Type by name of a relation's columns; of "all", every column of every relation."""
    if relation == "all":
        return {"record": "string"} | {("kind" if c == "record" else c): t for r in SCHEMAS for c, t in columns_of(r).items()}
    return dict(c.split(" ") for c in SCHEMAS[relation].split(", "))


def arrow_type(name: str) -> pa.DataType:
    if name.startswith("array<struct<"):
        return pa.list_(pa.struct([(k, _TYPES[t]) for k, t in (f.split(":") for f in name[13:-2].split(","))]))
    return pa.list_(_TYPES[name[6:-1]]) if name.startswith("array<") else _TYPES[name]


Rows = dict[str, list[tuple]]


def batches(relation: str, chunks: Iterator[Rows]) -> Iterator[pa.RecordBatch]:
    """Arrow batches of one relation's rows, or of all, with the columns that are read."""
    types = {c: arrow_type(t) for c, t in columns_of(relation).items()}
    for chunk in chunks:
        for found, rows in chunk.items():
            if rows and relation in (found, "all"):
                given = dict(zip(columns_of(found), zip(*rows, strict=True), strict=True))
                if relation == "all":
                    given = {("kind" if c == "record" else c): v for c, v in given.items()} | {"record": [found] * len(rows)}
                yield pa.RecordBatch.from_arrays([pa.array(given[c], t) if c in given else pa.nulls(len(rows), t) for c, t in types.items()], list(types))


class DumpError(ValueError):
    """The file isn't a dump, ends early, or holds an unknown sub-record."""


def open_dump(path: str) -> BinaryIO:
    """The file, decompressed where it starts with the mark of gzip."""
    if "://" in path:
        system, at = pa.fs.FileSystem.from_uri(path)
        f = io.BufferedReader(system.open_input_file(at), 1 << 20)
    else:
        f = open(path, "rb", buffering=1 << 20)
    mark = f.read(2)
    f.seek(0)
    return gzip.GzipFile(fileobj=f) if mark == b"\x1f\x8b" else f


def is_dump(path: str) -> bool:
    """Whether a file is a heap dump by its name or its first bytes."""
    if path.endswith((".hprof", ".hprof.gz")):
        return True
    with open_dump(path) as f:
        return f.read(12) == b"JAVA PROFILE"


def header(f: BinaryIO) -> tuple[str, int, int]:
    """Format, size of ids, creation time in milliseconds."""
    name = bytearray()
    while (c := f.read(1)) not in (b"\0", b""):
        name += c
        if len(name) > 64:
            break
    rest = f.read(12)
    if not name.startswith(b"JAVA PROFILE") or len(rest) < 12:
        raise DumpError("this is no heap dump: it doesn't start with JAVA PROFILE")
    size, created = struct.unpack(">IQ", rest)
    if size not in (4, 8):
        raise DumpError(f"ids of {size} bytes are not known")
    return name.decode("ascii", "replace"), size, created


def top_records(f: BinaryIO) -> Iterator[tuple[int, int, int]]:
    """(tag, offset of the body, its length) of each record; the body may be read before going on."""
    while True:
        at = f.tell()
        head = f.read(9)
        if len(head) < 9:
            return
        tag, _, length = struct.unpack(">BII", head)
        yield tag, at + 9, length
        if tag == HEAP_END:
            return
        f.seek(at + 9 + length)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _int(x: int) -> int:
    """Serials are unsigned in a dump and signed in a table."""
    return x - (1 << 32) if x >= 1 << 31 else x


class _Short(Exception):
    """A record isn't whole in the window."""


class Segment:
    """The sub-records of one heap segment, read window by window, as rows by relation."""

    def __init__(self, f: BinaryIO, length: int, id_size: int, offset: int):
        self.f, self.left, self.n, self.offset = f, length, id_size, offset
        self.body = b""
        self.id = struct.Struct(">q" if id_size == 8 else ">I")
        self.ids = "q" if id_size == 8 else "I"
        self.instance = struct.Struct(">qiqI" if id_size == 8 else ">IiII")

    def _id(self, at: int) -> int:
        return self.id.unpack_from(self.body, at)[0]

    def _value(self, at: int, kind: int) -> tuple[int, int]:
        width = self.n if kind == 2 else WIDTHS.get(kind, 0)
        return _signed(int.from_bytes(self.body[at : at + width], "big")) if width else 0, at + width

    def _more(self, at: int) -> None:
        """Give up what is before ``at`` and read on: a window, or as much as is held if a record is longer."""
        held = self.body[at:]
        if not self.left:
            raise DumpError(f"a record goes beyond its segment at {self.offset + at}")
        wanted = min(self.left, max(WINDOW, len(held)))
        got = self.f.read(wanted)
        if len(got) < wanted:
            raise DumpError("the dump ends within a heap segment: it was cut off, or is still being written")
        self.body, self.left, self.offset = held + got, self.left - wanted, self.offset + at

    def chunks(self) -> Iterator[Rows]:
        unpack, head, at, held = self.instance.unpack_from, 2 * self.n + 9, 0, 0
        found: Rows = {relation: [] for relation in SCHEMAS}
        while self.left or at < len(self.body):
            body, end, base, instances = self.body, len(self.body), self.offset, found["instances"]
            try:
                while at < end:
                    if body[at] == 0x21:  # nearly all records are instances
                        addr, serial, cls, size = unpack(body, at + 1)
                        stop = at + head + size
                        if stop > end:
                            break
                        instances.append((addr, cls, serial, body[at + head : stop], base + at))
                    else:
                        rows, stop = self._record(at)
                        for relation, row in rows:
                            found[relation].append(row)
                    held += stop - at + ROW_BYTES
                    at = stop
                    if held > BATCH_BYTES:
                        yield found
                        found, held = {relation: [] for relation in SCHEMAS}, 0
                        instances = found["instances"]
            except (_Short, struct.error, IndexError):
                pass  # the rest of the record is in the next window
            if self.left or at < end:
                self._more(at)
                at = 0
        yield found

    def _record(self, start: int) -> tuple[list[tuple[str, tuple]], int]:
        body, n, at = self.body, self.n, start + 1
        tag = body[start]
        if tag == 0x22:
            addr, (serial, count), cls = self._id(at), struct.unpack_from(">iI", body, at + n), self._id(at + n + 8)
            at += 2 * n + 8
            end = self._whole(at + count * n)
            return [("obj_arrays", (addr, cls, serial, list(struct.unpack_from(f">{count}{self.ids}", body, at)), self.offset + start))], end
        if tag == 0x23:
            addr, (serial, count, kind) = self._id(at), struct.unpack_from(">iIB", body, at + n)
            at += n + 9
            end = self._whole(at + count * WIDTHS.get(kind, 1))
            return [("prim_arrays", (addr, kind, serial, count, body[at:end], self.offset + start))], end
        if tag == 0x20:
            row, end = self._class(at, start)
            return [("classes", row)], self._whole(end)
        if tag in ROOTS:
            ids, numbers = ROOTS[tag]
            addr, rest = self._id(at), struct.unpack_from(f">{numbers}I", body, at + ids * n)
            end = self._whole(at + ids * n + 4 * numbers)
            if tag in (0x02, 0x03, 0x04, 0x06):
                frame = rest[1] if len(rest) > 1 else 0xFFFFFFFF
                return [("thread_locals", (_int(rest[0]), frame if frame < 1 << 31 else -1, addr, self.offset + start))], end
            owner = [("thread_objs", (_int(rest[0]), addr, _int(rest[1])))] if tag == 0x08 else []
            return [("gc_roots", (addr, tag)), *owner], end
        if tag == 0xFE:  # a heap's name
            return [], self._whole(at + 4 + n)
        raise DumpError(f"unknown sub-record {tag:#x} at {self.offset + start}")

    def _whole(self, end: int) -> int:
        if end > len(self.body):
            raise _Short
        return end

    def _class(self, at: int, start: int) -> tuple[tuple, int]:
        body, n = self.body, self.n
        addr, sup, loader = self._id(at), self._id(at + n + 4), self._id(at + 2 * n + 4)
        at += 7 * n + 4
        (size, pool) = struct.unpack_from(">iH", body, at)
        at += 6
        for _ in range(pool):
            _, at = self._value(at + 3, body[at + 2])
        statics, fields = [], []
        (count,) = struct.unpack_from(">H", body, at)
        at += 2
        for _ in range(count):
            name, kind = self._id(at), body[at + n]
            value, at = self._value(at + n + 1, kind)
            statics.append((name, kind, value))
        (count,) = struct.unpack_from(">H", body, at)
        at += 2
        for _ in range(count):
            fields.append((self._id(at), body[at + n]))
            at += n + 1
        return (addr, sup, loader, size, fields, statics, self.offset + start), at


class SegmentPart(InputPartition):
    """Where a heap segment's body is, or the whole file."""

    def __init__(self, offset: int, length: int):
        self.offset, self.length = offset, length


class HprofReader(DataSourceReader):
    def __init__(self, path: str, relation: str):
        self.path, self.relation = path, relation

    def partitions(self) -> list[InputPartition]:
        with open_dump(self.path) as f:
            header(f)
            if isinstance(f, gzip.GzipFile):
                return [SegmentPart(-1, 0)]
            heap = [SegmentPart(at, n) for tag, at, n in top_records(f) if tag in (HEAP_DUMP, HEAP_SEGMENT)] if self.relation in {*_HEAP, "all"} else []
            return heap if heap and self.relation != "all" else [SegmentPart(-1, 0), *heap]

    def read(self, part: SegmentPart) -> Iterator[pa.RecordBatch]:
        return batches(self.relation, self._chunks(part))

    def _chunks(self, part: SegmentPart) -> Iterator[Rows]:
        """The rows of one segment, or of the top level; of both where the file is compressed."""
        with open_dump(self.path) as f:
            name, size, created = header(f)
            if part.offset >= 0:
                f.seek(part.offset)
                yield from Segment(f, part.length, size, part.offset).chunks()
                return
            found: Rows = {"dump_info": [(name, size, created, self.path)]}
            counts: dict[str, int] = {}
            held = 0
            for tag, at, length in top_records(f):
                kind = _CENSUS.get(tag, "other")
                counts[kind] = counts.get(kind, 0) + 1
                if tag not in (HEAP_DUMP, HEAP_SEGMENT):
                    for relation, row in self._record(f, tag, length, size):
                        found.setdefault(relation, []).append(row)
                        held += length + ROW_BYTES
                    if held > BATCH_BYTES:
                        yield found
                        found, held = {}, 0
                elif isinstance(f, gzip.GzipFile) and self.relation in {*_HEAP, "all"}:
                    yield from Segment(f, length, size, at).chunks()
            yield found | {"census": sorted(counts.items())}

    def _record(self, f: BinaryIO, tag: int, length: int, size: int) -> Iterator[tuple[str, tuple]]:
        relation = {STRING: "utf8_strings", LOAD_CLASS: "load_class", STACK_FRAME: "stack_frames", STACK_TRACE: "stack_traces"}.get(tag)
        if relation is None or self.relation not in (relation, "all"):
            return
        body = f.read(length)
        if len(body) < length:
            raise DumpError("the dump ends within a record: it was cut off, or is still being written")
        ids = lambda k, at=0: [_signed(x) for x in struct.unpack_from(f">{k}{'Q' if size == 8 else 'I'}", body, at)]
        if tag == STRING:
            yield relation, (ids(1)[0], body[size:].decode("utf-8", "replace"))
        elif tag == LOAD_CLASS:
            yield relation, (_int(struct.unpack_from(">I", body)[0]), ids(1, 4)[0], ids(1, 8 + size)[0])
        elif tag == STACK_FRAME:
            serial, line = struct.unpack_from(">Ii", body, 4 * size)
            yield relation, (*ids(1), *ids(1, size), *ids(1, 3 * size), _int(serial), line)
        else:
            serial, thread, n = struct.unpack_from(">III", body)
            yield relation, (_int(serial), _int(thread), ids(n, 12))


class HprofSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "hprof"

    def schema(self) -> str:
        relation = self.options.get("relation", "dump_info")
        if relation not in SCHEMAS and relation != "all":
            raise ValueError(f"relation {relation!r} is none of {', '.join(SCHEMAS)} or all")
        return ", ".join(f"{c} {t}" for c, t in columns_of(relation).items())

    def reader(self, schema) -> DataSourceReader:
        return HprofReader(self.options["path"], self.options.get("relation", "dump_info"))
