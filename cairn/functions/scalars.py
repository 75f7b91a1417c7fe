"""Column functions for sizes, names, labels and buckets of heap objects."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

INSTANCE, OBJECT_ARRAY, PRIMITIVE_ARRAY, CLASS_OBJECT = range(4)

# Fixed values of the dump format: element types by code, their descriptors and widths.
PRIMITIVES = {4: ("boolean", "[Z", 1), 5: ("char", "[C", 2), 6: ("float", "[F", 4), 7: ("double", "[D", 8), 8: ("byte", "[B", 1), 9: ("short", "[S", 2), 10: ("int", "[I", 4), 11: ("long", "[J", 8)}
# Fixed values of the dump format: labels of GC root tags.
ROOT_LABELS = {0xFF: "Unknown", 1: "JNI Global", 2: "JNI Local", 3: "Java Local", 4: "Native Stack", 5: "Sticky Class", 6: "Thread Block", 7: "Busy Monitor", 8: "Thread", 0: "System Class"}
# Fixed values of the virtual machine's tool interface: bits of a thread's state.
THREAD_BITS = {0x1: "alive", 0x2: "terminated", 0x4: "runnable", 0x10: "waiting indefinitely", 0x20: "waiting with timeout", 0x40: "sleeping", 0x80: "waiting", 0x100: "in Object.wait()", 0x200: "parked", 0x400: "blocked on monitor enter"}
KIND_LABELS = {INSTANCE: "Instances", OBJECT_ARRAY: "Object arrays", PRIMITIVE_ARRAY: "Primitive arrays", CLASS_OBJECT: "Class objects"}
U32_MAX = 4294967295


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _labelled(key: Column, labels: dict, otherwise: Column | None = None) -> Column:
    chain = reduce(lambda w, kv: w.when(key == kv[0], kv[1]), labels.items(), F)
    return chain.otherwise(otherwise) if otherwise is not None else chain


def align_up(n, to) -> Column:
    """``n`` raised to the next multiple of ``to``."""
    n, to = _col(n).cast("long"), to if isinstance(to, Column) else F.lit(to)
    return (n + F.pmod(-n, to)).cast("long")


def saturated(n) -> Column:
    return F.least(_col(n).cast("long"), F.lit(U32_MAX))


def instance_size(prim_bytes, refs, super_size=None, pointer: int = 8, ref: int = 4) -> Column:
    """Own fields aligned to references over the super class's size, all aligned to eight bytes."""
    base = F.lit(pointer + ref) if super_size is None else _col(super_size)
    return saturated(align_up(align_up(base + _col(prim_bytes) + _col(refs) * ref, ref), 8))


def object_array_size(length, pointer: int = 8, ref: int = 4) -> Column:
    return saturated(align_up(F.lit(pointer + ref + 4) + _col(length).cast("long") * ref, 8))


def primitive_array_size(length, width, pointer: int = 8, ref: int = 4) -> Column:
    header = -(-(pointer + ref + 4) // ref) * ref
    return saturated(align_up(F.lit(header) + _col(length).cast("long") * _col(width), 8))


def class_object_size(static_prim_bytes, static_refs, ref: int = 4) -> Column:
    return saturated(align_up(_col(static_prim_bytes) + _col(static_refs) * ref, 8))


def at_least_header(shallow, kind, pointer: int = 8, ref: int = 4) -> Column:
    """Objects other than class objects have at least a header."""
    return F.when((_col(shallow) == 0) & (_col(kind) != CLASS_OBJECT), -(-(pointer + ref) // 8) * 8).otherwise(_col(shallow)).cast("long")


def next_power_of_two(n) -> Column:
    """The smallest power of two that isn't below ``n``; 1 for 0 and 1. By bit length: no rounding."""
    n = _col(n).cast("long")
    return F.when(n <= 1, F.lit(1).cast("long")).otherwise(F.pow(F.lit(2.0), F.length(F.bin(n - 1))).cast("long"))


def ratio_bucket(points) -> Column:
    """Bucket 0 to 10 of basis points: 0 by itself with up to 10 %, half-open tenths, 10 from 100 %."""
    bp = _col(points).cast("long")
    return F.when(bp >= 10000, 10).when(bp <= 0, 0).otherwise(F.floor((bp - 1) / 1000)).cast("int")


def basis_points(part, whole) -> Column:
    """Floor of part * 10000 / whole, exact for large sizes; 0 where the whole is 0."""
    part, whole = _col(part).cast("decimal(38,0)"), _col(whole).cast("decimal(38,0)")
    scaled = part * F.lit(10000).cast("decimal(5,0)")
    return F.when(whole == 0, F.lit(0).cast("long")).otherwise(((scaled - F.pmod(scaled, whole)) / whole).cast("long"))


def percent(part, whole) -> Column:
    return F.when(_col(whole) > 0, _col(part) / _col(whole) * 100).otherwise(0.0)


def pretty_class_name(raw) -> Column:
    """`[[Lcom/a/B;` as `com.a.B[][]`, `[I` as `int[]`, and slashes as dots."""
    raw = _col(raw)
    dims = F.length(F.regexp_extract(raw, r"^(\[*)", 1))
    base = F.substring(raw, dims + 1, F.length(raw))
    primitive = _labelled(base, {d[1]: n for n, d, _ in PRIMITIVES.values()})
    named = F.when(base.startswith("L") & base.endswith(";"), F.regexp_extract(base, r"^L(.*);$", 1)).otherwise(base)
    return F.when(dims == 0, F.translate(raw, "/", ".")).otherwise(F.concat(F.coalesce(primitive, F.translate(named, "/", ".")), F.repeat(F.lit("[]"), dims)))


def binary_name(raw) -> Column:
    return F.translate(_col(raw), "/", ".")


def package_path(pretty) -> Column:
    """The package of a pretty class name; `(primitives)` and `(default)` where there is none."""
    base = F.regexp_replace(_col(pretty), r"(\[\])+$", "")
    return F.when(base.isin(*[n for n, _, _ in PRIMITIVES.values()]), "(primitives)").when(F.instr(base, ".") == 0, "(default)").otherwise(F.regexp_replace(base, r"\.[^.]*$", ""))


def package_prefixes(package) -> Column:
    """`a.b.c` as [`a`, `a.b`, `a.b.c`]."""
    parts = F.split(_col(package), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "."))


def kind_label(kind) -> Column:
    return _labelled(_col(kind), KIND_LABELS)


def root_label(tag) -> Column:
    return _labelled(_col(tag), ROOT_LABELS, F.lit("Unknown"))


def thread_state(bits) -> Column:
    """Names of the set bits, joined by commas; `unknown` for none."""
    names = F.array_compact(F.array(*[F.when(_col(bits).bitwiseAND(F.lit(b)) != 0, n) for b, n in THREAD_BITS.items()]))
    return F.when(F.size(names) == 0, "unknown").otherwise(F.array_join(names, ", "))


def element_type(code) -> Column:
    return _labelled(_col(code), {c: n for c, (n, _, _) in PRIMITIVES.items()}, F.lit("unknown"))


def element_width(code) -> Column:
    return _labelled(_col(code), {c: w for c, (_, _, w) in PRIMITIVES.items()}, F.lit(1))


def primitive_array_name(code) -> Column:
    return _labelled(_col(code), {c: d for c, (_, d, _) in PRIMITIVES.items()}, F.lit("[?"))


def is_foldable(raw) -> Column:
    """Arrays of primitives and the class of classes: rows of the same name are one in histograms."""
    return _col(raw).rlike(r"^\[[ZCFDBSIJ]$") | (_col(raw) == "java/lang/Class")


def is_anonymous(name) -> Column:
    """Anonymous, lambda, proxy and generated classes, by their names."""
    name = _col(name)
    return name.rlike(r"\$[0-9]+$") | name.rlike(r"\$\$Lambda|\$Proxy[0-9]|GeneratedMethodAccessor|GeneratedConstructorAccessor|\$\$EnhancerBy|\$\$FastClassBy|ByteBuddy")


def pointee_category(name) -> Column:
    """What a field holds, by the name of the class it points to."""
    name = _col(name)
    last = F.element_at(F.split(name, r"[.$]"), -1)
    return F.when(name.endswith("[]"), "array").when(name == "java.lang.String", "string").when(last.rlike("Map|Table|Dictionary"), "map").when(last.rlike("List|Set|Queue|Deque|Collection|Vector|Stack"), "collection").otherwise("object")


def escaped_cell(text) -> Column:
    """Text for a table cell: control characters and bars escaped."""
    out = F.replace(_col(text), F.lit("\\"), F.lit("\\\\"))
    for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t"), ("|", "\\|")):
        out = F.replace(out, F.lit(raw), F.lit(shown))
    return out


def class_and_field(text) -> Column:
    parts = F.split(_col(text), "#", 2)
    return F.struct(parts[0].alias("class_name"), F.element_at(parts, 2).alias("field"))


def bare_array_label(label) -> Column:
    """`int[12]` as `int[]`; an object's address and a trailing label go."""
    return F.regexp_replace(F.regexp_replace(_col(label), r"\[\d+\]", "[]"), r"\s*@ 0x[0-9a-f]+.*$", "")


def parsed_int(text) -> Column:
    return F.regexp_replace(_col(text), r"[^0-9-]", "").try_cast("long")


def parsed_bytes(text) -> Column:
    """`1,234 (5.6%)` as bytes and percent."""
    return F.struct(F.regexp_replace(F.regexp_extract(_col(text), r"([0-9,]+)", 1), ",", "").try_cast("long").alias("bytes"), F.regexp_extract(_col(text), r"\(([0-9.]+)%\)", 1).try_cast("double").alias("pct"))


def decoded_string(data, coder) -> Column:
    """A string's characters: one byte each for coder 0, else big-endian pairs."""
    return F.when(_col(coder) == 0, F.decode(_col(data), "ISO-8859-1")).otherwise(F.decode(_col(data), "UTF-16BE"))


def millis_label(ms) -> Column:
    """UTC time of milliseconds since the epoch; null for 0."""
    return F.when(_col(ms) != 0, F.date_format(F.timestamp_millis(_col(ms)), "yyyy-MM-dd HH:mm:ss"))


def frame_text(class_name, method, source, line) -> Column:
    line = _col(line)
    where = F.when(line > 0, F.concat(_col(source), F.lit(":"), line.cast("string"))).when(line == -2, F.concat(_col(source), F.lit("(Compiled method)"))).when(line == -3, F.lit("Native Method")).otherwise(_col(source))
    return F.concat(binary_name(class_name), F.lit("."), _col(method), F.lit("("), F.coalesce(where, F.lit("Unknown Source")), F.lit(")"))


def all_equal(values) -> Column:
    return F.forall(_col(values), lambda x: x == F.element_at(_col(values), 1))


def used_slots(refs) -> Column:
    return F.size(F.filter(_col(refs), lambda x: x != 0))


def content_hash(kind, data) -> Column:
    return F.xxhash64(_col(kind), _col(data))


def big_endian(data, offset, width: int) -> Column:
    """An unsigned big-endian number in a blob, as a long with the same bits."""
    return F.conv(F.hex(F.substring(_col(data), _col(offset) + 1, width)), 16, -10).cast("long")
