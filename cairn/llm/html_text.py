"""Main text of web pages by the distribution of text over line blocks.

A page is stripped to lines, one for each block of running text, with inline markup gone and character
references decoded. What its elements say for certain (menus, footers, scripts, form controls, hidden parts) is left out.
Every other line has a weight: the length of its text outside of links. A marked article adds to the weight of its lines.
Class names and ids only lower it: a little where a name is loose (tags, legal, side), much where it is
plain (advert, sidebar, comments); so does being outside of the article that a page marks.

Weights are summed over a sliding window of lines, for each run of lines that are weighed alike: those of the page
and, by itself, each element that a name lowers. Text begins at a surge, a line from which the sum passes the
threshold, and ends at a dive, where a whole window weighs nothing; short gaps don't end it. In the page's own run all
lines between its first surge and last dive are text, links and short ones too; in a lowered run, only what surges in
spite of its name, which a line of an advert doesn't and paragraphs in a badly named element do.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm._common import by_batch

#: Lines in a block.
WINDOW = 3
#: Weight at which a block is a surge.
SURGE = 40
#: What is left of a weight in an element with a loose name, with a plain one, and outside of a marked article.
LOOSE, PLAIN, OUTSIDE = 0.15, 0.01, 0.2

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)", re.S)
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>|\Z", re.I) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "template")}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset("html head body article aside section nav header footer main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre form fieldset legend figure figcaption address hr details summary dialog menu center search hgroup".split())
_FURNITURE = frozenset("nav footer aside head button select datalist svg canvas object audio video map math dialog menu search label fieldset".split())
_IMPLIED = {"p": _BLOCK, "li": frozenset(["li"]), "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]), "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]), "option": frozenset(["option"])}
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)|\b(hidden)\b")
_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist status".split())
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertis\w*|adsense|adslot|banner|sponsor\w*|cookies?|consent|gdpr|popup|modal|overlay|newsletter|subscri\w*|signup|"
    r"menu\w*|nav|navbar|navigation|breadcrumbs?|sidebar|rail|recommend\w*|trending|footer|foot|header|masthead|topbar|comments?|commentlist|reply|replies|respond|disqus|"
    r"toolbar|pagination|pager|login|searchbox|skip|paywall)(?:$|[\s_-])",
    re.I,
)
#: Names that elements with text of the article may bear as well.
_LOOSE_NAMES = re.compile(
    r"(?:^|[\s_-])(?:promo\w*|notices?|notification\w*|alerts?|side|aside|related|share|sharing|social|widgets?|search|copyright|disclaimer|legal|tags|toc|byline-bar|form|discussion)(?:$|[\s_-])",
    re.I,
)
#: Names that say something of a layout, not of the element: has-sidebar, header-fixed, comments-open.
_MODIFIERS = re.compile(r"(?:^|(?<=[\s_-]))(?:(?:has|with|without|no|not|is)[_-][a-z]+|(?:sticky|fixed)[_-](?:header|nav|navbar|footer|sidebar)|(?:header|nav|navbar|footer|sidebar|menu)[_-](?:fixed|sticky|static|left|right|open|closed)|comments?[_-](?:open|closed)|search[_-]results?)(?=$|[\s_-])", re.I)
#: Names of what readers write or what leads elsewhere; it stays out even where it is longer than the text.
_TALK = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|reply|replies|respond|disqus|discussion|related|recommend\w*)(?:$|[\s_-])", re.I)
#: Marks of an element: none, furniture, by a loose name, by a plain one, by one of readers.
_NOT, _SURE, _LOOSELY, _NAMED, _TALKED = range(5)


def _furniture(tag: str, attributes: str, in_article: bool) -> int:
    if tag in _FURNITURE:
        return _SURE
    if tag == "header":
        return _NOT if in_article else _SURE
    mark = _LOOSELY if tag == "form" else _NOT
    if not attributes or tag in ("html", "body", "main"):
        return mark
    for name, value, hidden in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if hidden or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            return _SURE
        if name == "role" and value.lower() in _ROLES:
            return _SURE
        if name in ("class", "id"):
            value = _MODIFIERS.sub("", value)
            if tag == "article":
                value = re.sub(r"(?i)header|footer|social|share|tags|promo\w*|legal|notice", "", value)
            if _NAMES.search(value):
                mark = max(mark, _TALKED if _TALK.search(value) else _NAMED)
            elif _LOOSE_NAMES.search(value):
                mark = max(mark, _LOOSELY)
    return mark


def _cleared(lines: list[tuple[str, int, tuple[int, ...], bool]], marks: list[int]) -> set[int]:
    """The elements that a name lowers but that hold the page's article or, where none is marked, most of its text."""
    open_lines = [(text, links, f, article) for text, links, f, article in lines if all(marks[k] != _SURE for k in f)]
    if any(article and not f for _, _, f, article in open_lines):
        return set()
    total, held, with_article = 0, {}, set()
    for text, links, f, article in open_lines:
        size = max(0, len(text) - links)
        total += size
        for k in f:
            held[k] = held.get(k, 0) + size
            if article:
                with_article.add(k)
    cleared = {k for k in with_article if marks[k] != _TALKED}
    if any(article and all(k in cleared for k in f) for _, _, f, article in open_lines):
        return cleared
    cleared |= {k for k, size in held.items() if 2 * size > total and marks[k] != _TALKED}
    if not any(all(k in cleared for k in f) for _, _, f, _ in open_lines):
        cleared |= {k for k, size in held.items() if 2 * size > total}
    return cleared


def lines_of(html: str) -> list[tuple[str, int, int, float, bool]]:
    """(text, characters of it in links, run, share of its weight that is left, in an article) of each block of
    running text that isn't furniture for certain. Run -1 is the page's; others are elements that a name lowers."""
    found, parts, links, at, in_link = [], [], 0, 0, False
    marks: list[int] = []  # of furniture, in page order
    within: list[int] = []  # the open ones
    stack: list[tuple[str, int, bool]] = []  # tag, furniture, article: of elements that matter
    articles = 0

    def end_line() -> None:
        nonlocal parts, links
        if parts:
            text = " ".join(unescape("".join(parts)).split())
            if text:
                found.append((text, links, tuple(within), articles > 0))
            parts, links = [], 0

    def close(depth: int) -> None:
        nonlocal articles
        while len(stack) > depth:
            _, f, a = stack.pop()
            if f:
                within.pop()
            articles -= a

    def take(piece: str) -> None:
        nonlocal links
        parts.append(piece)
        if in_link:
            links += len(piece.strip())

    while True:
        m = _TOKEN.search(html, at)
        if m is None:
            break
        if m.start() > at:
            take(html[at : m.start()])
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                in_link = False
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if tag in _BLOCK or depth is not None and (stack[depth][1] or stack[depth][2]):
                end_line()
            if depth is not None:
                close(depth)
            continue
        if tag in _RAW:
            at = _RAW[tag].search(html, at).end()
            continue
        if tag == "br":
            take(" ")
            continue
        if tag == "a":
            in_link = True
        if tag in _BLOCK:
            end_line()
            in_link = in_link and tag == "a"
            while stack and tag in _IMPLIED.get(stack[-1][0], ()):
                close(len(stack) - 1)
        if tag in _VOID or m[3].endswith("/") and tag not in _BLOCK:
            continue
        bad = _furniture(tag, m[3], articles > 0)
        good = tag in ("article", "main") and not bad
        if bad:
            end_line()
        if bad or good or tag in _BLOCK:
            stack.append((tag, bad, good))
            if bad:
                within.append(len(marks))
                marks.append(bad)
            articles += good
    if at < len(html):
        take(html[at:])
    end_line()
    cleared = _cleared(found, marks)
    out = []
    for text, line_links, f, article in found:
        if all(marks[k] != _SURE for k in f):
            lowered = [k for k in f if k not in cleared]
            share = min([LOOSE if marks[k] == _LOOSELY else PLAIN for k in lowered], default=1.0)
            out.append((text, line_links, lowered[0] if lowered else -1, share, article))
    return out


def between(weights: list[float], surge: float, window: int = WINDOW) -> list[int]:
    """The lines with weight that lie between a surge and the next dive."""
    n = len(weights)
    ahead = [sum(weights[i : i + window]) for i in range(n)] + [0]
    kept, i = [], 0
    while i < n:
        if weights[i] and ahead[i] >= surge:
            while i < n and ahead[i]:
                if weights[i]:
                    kept.append(i)
                i += 1
        else:
            i += 1
    return kept


def main_text(html: str) -> str:
    """The page's main text, blocks joined by one newline; empty if there is none."""
    lines = lines_of(html)
    plain = [max(0, len(text) - links) for text, links, *_ in lines]
    inside = sum(n for n, (_, _, run, _, article) in zip(plain, lines, strict=True) if article and run < 0)
    others = [n for n, (_, _, run, _, article) in zip(plain, lines, strict=True) if not article and run < 0]
    beside = sum(others[i] for i in between(others, SURGE))
    runs: dict[tuple[int, bool], list[int]] = {}
    for i, (_, _, run, _, article) in enumerate(lines):
        runs.setdefault((run, article and run < 0), []).append(i)
    kept: set[int] = set()
    for (run, article), own in runs.items():
        outside = run < 0 and inside > 0 and not article and beside <= inside  # else the article is a teaser beside the text
        weights = [len(lines[i][0]) + SURGE if article else plain[i] * lines[i][3] * (OUTSIDE if outside else 1) for i in own]
        whole = run < 0 and not outside
        surge = min(SURGE, max(1, max(weights, default=1))) if whole else SURGE
        found = between(weights, surge)
        if found and whole:  # links and short lines between the first surge and the last dive are text as well
            found = list(range(found[0], found[-1] + 1))
        kept |= {own[k] for k in found}
    return "\n".join(lines[i][0] for i in sorted(kept))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of ``pages``.

    A null html is empty, and a page without main text has an empty text. Repeated and null ids and null
    urls stay as they are. Other columns are ignored."""

    def rows(batch: dict[str, list]) -> dict[str, list]:
        texts = [main_text(h) for h in batch["html"]]
        return {"page_id": batch["page_id"], "url": batch["url"], "text": texts, "n_chars": pa.array([len(t) for t in texts], pa.int64())}

    chosen = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    return by_batch(chosen, "page_id long, url string, text string, n_chars long", rows)
