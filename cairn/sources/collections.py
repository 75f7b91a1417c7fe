"""Which classes are collections, and where their size and backing array are: built in, or from a TOML file."""

from __future__ import annotations

import os
import tomllib

from pyspark.sql import DataFrame, SparkSession

KINDS = ("List", "Map", "Set", "Tree", "Deque", "Plain")

# Known collection classes as "class kind size_field array_field"; "-" for no field, and a field of
# another class is written with it. Classes that only wrap another collection have neither and aren't counted.
_KNOWN = """
java/util/HashMap Map size table
java/util/LinkedHashMap Map java/util/HashMap#size java/util/HashMap#table
java/util/Hashtable Map count table
java/util/concurrent/ConcurrentHashMap Map - table
java/util/TreeMap Tree size -
java/util/ArrayList List size elementData
java/util/Vector List elementCount elementData
java/util/LinkedList List size -
java/util/ArrayDeque Deque - elements
java/util/HashSet Set - -
java/util/TreeSet Set - -
scala/collection/mutable/HashMap Map contentSize table
scala/collection/mutable/ArrayBuffer List size0 array
org/eclipse/collections/impl/map/mutable/UnifiedMap Map occupied table
org/eclipse/collections/impl/list/mutable/FastList List size items
org/eclipse/collections/impl/set/mutable/UnifiedSet Set occupied table
gnu/trove/map/hash/THashMap Map gnu/trove/impl/hash/THash#_size gnu/trove/impl/hash/TObjectHash#_set
gnu/trove/set/hash/THashSet Set gnu/trove/impl/hash/THash#_size gnu/trove/impl/hash/TObjectHash#_set
gnu/trove/map/hash/TIntObjectHashMap Map gnu/trove/impl/hash/THash#_size _values
gnu/trove/THashMap Map gnu/trove/THash#_size gnu/trove/TObjectHash#_set
gnu/trove/THashSet Set gnu/trove/THash#_size gnu/trove/TObjectHash#_set
com/google/common/collect/ImmutableList List - array
com/google/common/collect/ImmutableMap Map - table
com/google/common/collect/ImmutableSet Set - elements
com/google/common/collect/ImmutableMultimap Map - -
com/google/common/collect/ArrayListMultimap Map - -
com/google/common/collect/HashMultimap Set - -
com/google/common/collect/LinkedHashMultimap Map - -
com/google/common/collect/TreeMultimap Map - -
com/google/common/collect/HashBiMap Map size hashTableKToV
"""

Descriptor = tuple[str, str, str | None, str | None, str | None, str | None]


def _field(text: str | None, owner: str) -> tuple[str | None, str | None]:
    if not text or text == "-":
        return None, None
    cls, _, field = text.rpartition("#")
    return cls or owner, field


BUILT_IN: list[Descriptor] = [(c, k, *_field(s, c), *_field(a, c)) for c, k, s, a in (x.split() for x in _KNOWN.strip().splitlines())]


def parse_config(text: str) -> list[Descriptor]:
    """[[collection]] entries with class, kind, size_field and array_field as `Class#field`."""
    out = []
    for entry in tomllib.loads(text).get("collection", []):
        if entry.get("kind") not in KINDS:
            raise ValueError(f"kind {entry.get('kind')!r} is none of {', '.join(KINDS)}")
        out.append((entry["class"], entry["kind"], *_field(entry.get("size_field"), entry["class"]), *_field(entry.get("array_field"), entry["class"])))
    return out


def find_config(explicit: str | None = None, name: str = "cairn-collections.toml") -> str | None:
    """The file that was named, else one in the working folder, else one in the home folder."""
    if explicit:
        return explicit
    return next((p for p in (name, os.path.join(os.path.expanduser("~"), f".{name}")) if os.path.exists(p)), None)


def descriptors(spark: SparkSession, known: list[Descriptor], own: list[Descriptor] = ()) -> DataFrame:
    """One row a class; the user's own come first and win."""
    rows = {d[0]: d for d in [*known, *reversed(own)]}
    order = [*dict.fromkeys([d[0] for d in own]), *[d[0] for d in known if d[0] not in {o[0] for o in own}]]
    return spark.createDataFrame([(*rows[c], i) for i, c in enumerate(order)], "name string, kind string, size_class string, size_field string, array_class string, array_field string, rank int")
