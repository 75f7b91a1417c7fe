"""A small writer of heap dumps, for tests."""

import gzip
import struct


class DumpWriter:
    def __init__(self, id_size=8):
        self.n, self.strings, self.top, self.heap = id_size, {}, [], []
        self.segments = []

    def id(self, x):
        return struct.pack(">Q" if self.n == 8 else ">I", x)

    def string(self, text):
        if text not in self.strings:
            self.strings[text] = 0x1000 + len(self.strings)
            self.top.append((1, self.id(self.strings[text]) + text.encode()))
        return self.strings[text]

    def cls(self, addr, name, super_addr=0, loader=0, fields=(), statics=(), serial=None):
        """fields: (name, type); statics: (name, type, value)."""
        self.top.append((2, struct.pack(">I", serial or addr & 0xFFFF) + self.id(addr) + struct.pack(">I", 0) + self.id(self.string(name))))
        width = {2: self.n, 4: 1, 5: 2, 6: 4, 7: 8, 8: 1, 9: 2, 10: 4, 11: 8}
        body = b"\x20" + self.id(addr) + struct.pack(">I", 0) + self.id(super_addr) + self.id(loader) + self.id(0) * 4 + struct.pack(">I", 0)
        body += struct.pack(">H", 1) + struct.pack(">HB", 1, 10) + struct.pack(">I", 7)  # a constant pool entry
        body += struct.pack(">H", len(statics)) + b"".join(self.id(self.string(n)) + bytes([t]) + v.to_bytes(width[t], "big") for n, t, v in statics)
        body += struct.pack(">H", len(fields)) + b"".join(self.id(self.string(n)) + bytes([t]) for n, t in fields)
        self.heap.append(body)

    def instance(self, addr, cls, blob, serial=0):
        self.heap.append(b"\x21" + self.id(addr) + struct.pack(">I", serial) + self.id(cls) + struct.pack(">I", len(blob)) + blob)

    def array(self, addr, cls, refs, serial=0):
        self.heap.append(b"\x22" + self.id(addr) + struct.pack(">II", serial, len(refs)) + self.id(cls) + b"".join(map(self.id, refs)))

    def prims(self, addr, kind, data, count, serial=0):
        self.heap.append(b"\x23" + self.id(addr) + struct.pack(">IIB", serial, count, kind) + data)

    def root(self, tag, addr, *numbers):
        self.heap.append(bytes([tag]) + self.id(addr) + (self.id(0) if tag == 1 else b"") + b"".join(struct.pack(">I", x & 0xFFFFFFFF) for x in numbers))

    def frame(self, frame, method, source, serial, line):
        self.top.append((4, b"".join(map(self.id, (frame, self.string(method), self.string("()V"), self.string(source)))) + struct.pack(">Ii", serial, line)))

    def trace(self, serial, thread, frames):
        self.top.append((5, struct.pack(">III", serial, thread, len(frames)) + b"".join(map(self.id, frames))))

    def cut_segment(self):
        self.segments.append(b"".join(self.heap))
        self.heap = []

    def bytes(self, end=True):
        self.cut_segment()
        out = b"JAVA PROFILE 1.0.2\0" + struct.pack(">IQ", self.n, 1700000000000)
        for tag, body in self.top + [(0x1C, s) for s in self.segments if s] + ([(0x2C, b"")] if end else []):
            out += struct.pack(">BII", tag, 0, len(body)) + body
        return out

    def write(self, path):
        data = self.bytes()
        with (gzip.open if str(path).endswith(".gz") else open)(path, "wb") as f:
            f.write(data)
        return str(path)


def sample(id_size=8):
    """Objects 0x10000 and up; a thread with a local, a list of two strings, a weak reference, garbage."""
    w = DumpWriter(id_size)
    obj, cls_, string, thread, sub, lst, ref, weak, objs, byts = (0x9000 + 0x10 * i for i in range(10))
    w.cls(obj, "java/lang/Object")
    w.cls(cls_, "java/lang/Class", obj)
    w.cls(string, "java/lang/String", obj, fields=[("value", 2), ("coder", 8)])
    w.cls(thread, "java/lang/Thread", obj, fields=[("eetop", 11), ("name", 2)])
    w.cls(sub, "Sub", thread, loader=0x20000, fields=[("extra", 10), ("name", 2)], statics=[("held", 2, 0x11000), ("n", 10, 5)])
    w.cls(lst, "java/util/ArrayList", obj, fields=[("size", 10), ("elementData", 2)])
    w.cls(ref, "java/lang/ref/Reference", obj, fields=[("referent", 2)])
    w.cls(weak, "java/lang/ref/WeakReference", ref)
    w.cls(objs, "[Ljava/lang/Object;", obj)
    w.cls(byts, "[B", obj)
    w.instance(0x20000, obj, b"")
    i = w.id
    w.instance(0x10000, sub, struct.pack(">i", 3) + i(0) + struct.pack(">q", 1) + i(0x10100), serial=1)
    w.instance(0x10100, string, i(0x10200) + b"\0")
    w.prims(0x10200, 8, "main".encode(), 4)
    w.instance(0x10300, lst, struct.pack(">i", 2) + i(0x10400), serial=1)
    w.array(0x10400, objs, [0x10500, 0x10600, 0, 0])
    w.cut_segment()
    w.heap.append(b"\xfe" + struct.pack(">I", 1) + i(w.string("app")))
    w.instance(0x10500, string, i(0x10700) + b"\0")
    w.instance(0x10600, string, i(0x10800) + b"\1")
    w.prims(0x10700, 8, b"caf\xe9", 4)
    w.prims(0x10800, 8, "žluť".encode("utf-16-be"), 8)
    w.instance(0x10900, weak, i(0x10A00))
    w.instance(0x10A00, obj, b"")
    w.instance(0x11000, obj, b"")
    w.instance(0x12000, string, i(0x12100) + b"\0")  # garbage
    w.prims(0x12100, 8, b"xx", 2)
    w.instance(0x10A00, string, i(0) + b"\0")  # a repeated address
    w.root(8, 0x10000, 7, 1)
    w.root(3, 0x10300, 7, 0)
    w.root(5, sub)
    w.root(1, 0x10900)
    for c in (obj, cls_, string, thread, lst, ref, weak, objs):
        w.root(5, c)
    # system properties: a table with one chain of two entries
    system, tab, ent, props, buf, direct, loc = (0xA000 + 0x10 * k for k in range(7))
    w.cls(tab, "java/util/Hashtable", obj, fields=[("count", 10), ("table", 2)])
    w.cls(ent, "java/util/Hashtable$Entry", obj, fields=[("key", 2), ("value", 2), ("next", 2)])
    w.cls(props, "java/util/Properties", tab)
    w.cls(system, "java/lang/System", obj, statics=[("props", 2, 0x13000)])
    w.instance(0x13000, props, struct.pack(">i", 2) + i(0x13100))
    w.array(0x13100, objs, [0, 0x13200])
    w.instance(0x13200, ent, i(0x15000) + i(0x15100) + i(0x13300))
    w.instance(0x13300, ent, i(0x15200) + i(0x15100) + i(0))
    for at, text in ((0x15000, "os"), (0x15100, "linux"), (0x15200, "user")):
        w.instance(at, string, i(at + 0x80) + b"\0")
        w.prims(at + 0x80, 8, text.encode(), len(text))
    w.cls(buf, "java/nio/Buffer", obj, fields=[("capacity", 10)])
    w.cls(direct, "java/nio/DirectByteBuffer", buf)
    w.instance(0x14000, direct, struct.pack(">i", 4096))
    w.cls(loc, "java/lang/ThreadLocal$ThreadLocalMap$Entry", weak, fields=[("value", 2)])
    w.instance(0x14100, loc, i(0) + i(0))
    w.prims(0x14200, 10, struct.pack(">4i", 7, 7, 7, 7), 4)
    w.prims(0x14300, 10, struct.pack(">4i", 7, 7, 7, 7), 4)
    w.root(5, system)
    w.frame(0x501, "run", "Main.java", sub & 0xFFFF, 12)
    w.frame(0x502, "park", "Unsafe.java", thread & 0xFFFF, -3)
    w.trace(1, 7, [0x501, 0x502])
    w.trace(2, 8, [])
    return w
