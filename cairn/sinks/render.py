"""Reports as JSON, Markdown (plain or with bars) and one self-contained HTML page; gzip by the name."""

from __future__ import annotations

import base64
import gzip
import html
import json
import zlib

_EIGHTHS = " ▏▎▍▌▋▊▉█"
_LEVELS = "▁▂▃▄▅▆▇█"


def count(n: int) -> str:
    return f"{n:,}"


def size(n: int) -> str:
    """Bytes in the largest binary unit that leaves a number of 1 or more."""
    value, unit = float(n), "B"
    for unit in ("B", "KiB", "MiB", "GiB", "TiB"):
        if abs(value) < 1024 or unit == "TiB":
            break
        value /= 1024
    return f"{int(value)} B" if unit == "B" else f"{value:.2f} {unit}"


def signed_size(n: int) -> str:
    return ("+" if n > 0 else "-" if n < 0 else "") + size(abs(n))


def signed_count(n: int) -> str:
    return f"{n:+,}" if n else "0"


def percent(bp: int) -> str:
    return f"{bp / 100:.2f}%"


def bar(share: float, width: int = 20) -> str:
    eighths = round(max(0.0, min(1.0, share)) * width * 8)
    return ("█" * (eighths // 8) + _EIGHTHS[eighths % 8]).rstrip().ljust(width)


def sparkline(values: list[float]) -> str:
    top = max(values, default=0) or 1
    return "".join(_LEVELS[min(7, int(8 * v / top))] for v in values)


def tree_prefix(last: list[bool]) -> str:
    """The lines before a node of a tree, from whether it and those above are the last of their siblings."""
    return "".join("   " if x else "│  " for x in last[:-1]) + ("└─ " if last[-1] else "├─ ") if last else ""


def fill_label(bucket: int) -> str:
    return "empty to 10%" if bucket == 0 else "full" if bucket == 10 else f"{bucket * 10}–{bucket * 10 + 10}%"


def cell(value, column: str) -> str:
    if value is None:
        return ""
    if isinstance(value, bool):
        return "yes" if value else "no"
    if isinstance(value, (list, tuple)):
        return ", ".join(cell(v, "") for v in value)
    if isinstance(value, int):
        if column.endswith("_bp"):
            return percent(value)
        if column in ("shallow", "retained", "drop", "wasted", "bytes") or column.endswith(("_shallow", "_retained", "_bytes")):
            return size(value)
        if column in ("obj_id", "point", "container"):
            return f"{value & (1 << 64) - 1:#x}"
        return count(value)
    text = str(value).replace("\\", "\\\\").replace("|", "\\|").replace("\n", "\\n").replace("\r", "\\r")
    return text if len(text) <= 200 else text[:199] + "…"


def table(columns: list[str], rows: list[list], limit: int | None = None) -> list[str]:
    """A Markdown table with aligned columns; numbers to the right."""
    shown = rows[:limit] if limit else rows
    cells = [[cell(v, c) for v, c in zip(r, columns, strict=True)] for r in shown]
    widths = [max([len(c), 3, *(len(r[k]) for r in cells)]) for k, c in enumerate(columns)]
    numeric = [all(v is None or isinstance(v, (int, float)) and not isinstance(v, bool) for r in shown for v in [r[k]]) for k in range(len(columns))]
    line = lambda parts: "| " + " | ".join(p.rjust(w) if n else p.ljust(w) for p, w, n in zip(parts, widths, numeric, strict=True)) + " |"
    out = [line(columns), "|" + "|".join("-" * (w + 1) + (":" if n else "-") for w, n in zip(widths, numeric, strict=True)) + "|", *map(line, cells)]
    if len(rows) > len(shown):
        out.append(f"\n{len(rows) - len(shown)} more rows.")
    return out


def drawn_tree(columns: list[str], rows: list[list], limit: int) -> list[str]:
    """The rows of a tree (obj_id, idom, class_name, retained) with lines before them, the heaviest child first; ``limit`` rows."""
    at = {c: columns.index(c) for c in ("obj_id", "idom", "class_name", "retained")}
    below: dict[int, list[list]] = {}
    for r in sorted(rows, key=lambda r: (-r[at["retained"]], r[at["obj_id"]])):
        below.setdefault(r[at["idom"]], []).append(r)
    out, todo = [], [(r, []) for r in reversed(below.get(-1, []))]
    while todo and len(out) < limit:
        r, last = todo.pop()
        out.append(f"{tree_prefix(last)}{cell(r[at['class_name']], '')} {cell(r[at['obj_id']], 'obj_id')} {size(r[at['retained']])}")
        under = below.get(r[at["obj_id"]], [])
        todo += [(c, [*last, k == len(under) - 1]) for k, c in reversed(list(enumerate(under)))]
    return out


def markdown(report: dict, bars: bool = False, limit: int = 50) -> str:
    out = [f"# Heap report: {report['source']}", "", "## Contents", ""]
    out += [f"- [{s['title']}](#{s['title'].lower().replace(' ', '-')})" for s in report["sections"].values()]
    for key, s in report["sections"].items():
        out += ["", f"## {s['title']}", ""]
        if not s["rows"]:
            out.append("Nothing to show.")
            continue
        if key == "dominator_tree":
            out += ["```", *drawn_tree(s["columns"], s["rows"], limit), "```"]
            continue
        out += table(s["columns"], s["rows"], limit)
        measure = next((c for c in ("retained", "objects", "shallow") if c in s["columns"]), None)
        if bars and measure and len(s["rows"]) > 1:
            k = s["columns"].index(measure)
            top = max(r[k] or 0 for r in s["rows"]) or 1
            label = next((j for j, c in enumerate(s["columns"]) if isinstance(s["rows"][0][j], str)), 0)
            out += ["", "```", *(f"{bar((r[k] or 0) / top)} {cell(r[k], measure):>12}  {cell(r[label], s['columns'][label])}" for r in s["rows"][:limit]), "```"]
    return "\n".join(out) + "\n"


_PAGE = """<!DOCTYPE html>
<html lang="en"><head><meta charset="utf-8"><title>{title}</title>
<style>body{{font:14px system-ui,sans-serif;margin:2em auto;max-width:80em;padding:0 1em}}table{{border-collapse:collapse;margin:1em 0}}td,th{{border:1px solid #ccc;padding:.2em .6em;text-align:left}}td.n{{text-align:right;font-variant-numeric:tabular-nums}}</style></head>
<body><h1>{title}</h1>{body}
<script type="application/octet-stream" id="report" data-kind="{kind}">{payload}</script></body></html>
"""


def page(report: dict, kind: str = "report") -> str:
    """One file without references to others: tables for reading, and the report itself, packed, for programs."""
    body = []
    for s in report["sections"].values():
        body.append(f"<h2>{html.escape(s['title'])}</h2><table><tr>" + "".join(f"<th>{html.escape(c)}</th>" for c in s["columns"]) + "</tr>")
        for r in s["rows"]:
            body.append("<tr>" + "".join(f"<td{' class=n' if isinstance(v, (int, float)) else ''}>{html.escape(cell(v, c))}</td>" for v, c in zip(r, s["columns"], strict=True)) + "</tr>")
        body.append("</table>")
    packer = zlib.compressobj(9, zlib.DEFLATED, -15)
    payload = base64.b64encode(packer.compress(to_json(report).encode()) + packer.flush()).decode()
    return _PAGE.format(title=html.escape(f"Heap report: {report['source']}"), body="".join(body), payload=payload, kind=kind)


def to_json(report: dict) -> str:
    return json.dumps(report, indent=2, ensure_ascii=False) + "\n"


def from_json(text: str, version: int) -> dict:
    report = json.loads(text)
    if report.get("version") != version:
        raise ValueError(f"this report is of version {report.get('version')}, and only {version} can be read")
    return report


FORMATS = {"json": to_json, "md": markdown, "mdgraphs": lambda r: markdown(r, bars=True), "html": page}


def format_of(explicit: str | None, path: str | None) -> str:
    """The format that was asked for, else the one the file's ending names, else Markdown."""
    if explicit:
        return explicit
    ending = (path or "").removesuffix(".gz").rpartition(".")[2]
    return {"json": "json", "html": "html", "htm": "html"}.get(ending, "md")


def write(text: str, path: str | None) -> None:
    if path is None or path == "-":
        print(text, end="")
    elif path.endswith(".gz"):
        with gzip.open(path, "wt", encoding="utf-8") as f:
            f.write(text)
    else:
        with open(path, "w", encoding="utf-8") as f:
            f.write(text)
