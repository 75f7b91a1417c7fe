"""Another analyser's exported HTML pages (a folder, a zip, or one page) as tables to compare with."""

from __future__ import annotations

import os
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser

from pyspark.sql import DataFrame, SparkSession


def pages(path: str) -> Iterator[tuple[str, str]]:
    """(name, text) of each page."""
    if os.path.isdir(path):
        for folder, _, names in sorted(os.walk(path)):
            for name in sorted(names):
                if name.endswith((".html", ".htm")):
                    with open(os.path.join(folder, name), encoding="utf-8", errors="replace") as f:
                        yield os.path.relpath(os.path.join(folder, name), path), f.read()
    elif zipfile.is_zipfile(path):
        with zipfile.ZipFile(path) as z:
            for name in sorted(z.namelist()):
                if name.endswith((".html", ".htm")):
                    yield name, z.read(name).decode("utf-8", "replace")
    else:
        with open(path, encoding="utf-8", errors="replace") as f:
            yield os.path.basename(path), f.read()


class _Tables(HTMLParser):
    def __init__(self):
        super().__init__()
        self.tables: list[list[list[str]]] = []
        self.cell: list[str] | None = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self.tables.append([])
        elif tag == "tr" and self.tables:
            self.tables[-1].append([])
        elif tag in ("td", "th") and self.tables and self.tables[-1]:
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "th") and self.cell is not None:
            self.tables[-1][-1].append(" ".join("".join(self.cell).split()))
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def tables_of(text: str) -> list[list[list[str]]]:
    parser = _Tables()
    parser.feed(text)
    return [[r for r in t if r] for t in parser.tables]


def number(text: str) -> int | None:
    """A whole number with any grouping marks, also after a sign for "at least"."""
    digits = re.sub(r"[^0-9]", "", text)
    return int(digits) if digits else None


def histogram(spark: SparkSession, path: str) -> DataFrame:
    """class_name, instances, shallow, retained of the first table that has such columns."""
    wanted = {"class_name": r"class( name)?", "instances": r"(objects|instances)", "shallow": r"shallow.*", "retained": r"retained.*"}
    for _, text in pages(path):
        for t in tables_of(text):
            heads = [h.lower() for h in t[0]] if t else []
            place = {k: next((i for i, h in enumerate(heads) if re.fullmatch(p, h)), None) for k, p in wanted.items()}
            if place["class_name"] is not None and place["instances"] is not None:
                rows = [(r[place["class_name"]], *[number(r[i]) if i is not None and i < len(r) else None for i in (place["instances"], place["shallow"], place["retained"])]) for r in t[1:] if len(r) > place["instances"] and number(r[place["instances"]]) is not None]
                return spark.createDataFrame(rows, "class_name string, instances long, shallow long, retained long")
    return spark.createDataFrame([], "class_name string, instances long, shallow long, retained long")


def overview(path: str) -> dict[str, str]:
    """What two-column tables say, by their first column."""
    return {r[0].rstrip(":"): r[1] for _, text in pages(path) for t in tables_of(text) for r in t if len(r) == 2}
