import random

from cairn.llm import html_text
from cairn.llm.html_text import between, extract, main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p><article>no";</script></head>
<body class="has-sidebar"><header><h1>Site</h1><p>Slogan of the site, which is long enough to look like text.</p></header>
<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav><!-- <p>gone</p> -->
<div class="cookie-notice"><p>We use cookies, a lot of them, and say so in a sentence of some length.</p></div>
<article class="post"><h1>Title &amp; more</h1><p><b>First</b> para&shy;graph,
  with   <i>inline</i>mark<br>up &lt;tags&gt; and 3 < 4.<p>Second&nbsp;one</p>
<div class="ad">Buy now</div><p>After the advert.</p><aside><p>Related</p><p>Things</p><p>To read</p><p>Also</p></aside><blockquote>Quoted</blockquote><ul><li>one<li>two</ul>
<form><label>Name</label><input></form><figure><img src=x><figcaption>Seen</figcaption></figure><p>Last &eacute;&#233;&amp</p><footer>By me</footer></article>
<section id="comments"><article class="comment"><p>Nice!</p></article></section><div role="complementary"><p>More text</p></div><footer><p>&copy; us</p></footer></body></html>"""
WANT = 'Title & more\nFirst para\xadgraph, with inlinemark up <tags> and 3 < 4.\nSecond one\nAfter the advert.\nQuoted\none\ntwo\nSeen\nLast éé&'


def test_marked_article():
    assert main_text(PAGE) == WANT


def test_unmarked_page():
    body = "".join(f"<p>Paragraph number {i} with quite some running text in it.</p>" for i in range(3))
    page = f'<div id="menu"><a href=1>One</a> <a href=2>Two</a></div><p><a href=3>Link</a></p><p><a href=4>Link</a></p><p><a href=4>Link</a></p><div>{body}</div><div class="comments"><p>Reader text that is long as well, in a sentence.</p></div>'
    assert main_text(page) == "\n".join(f"Paragraph number {i} with quite some running text in it." for i in range(3))


def test_broken_and_empty_pages():
    assert main_text("") == main_text("<p></p>") == main_text("<nav>a</nav>") == main_text("<!-- open") == main_text("<script>x") == ""
    assert main_text("<article><p>cut off he") == "cut off he"
    assert main_text("<article>x</b></i></div>y</article>") == "x\ny"
    assert main_text("<article><p>A</p></article><p>outside</p>") == "A"
    assert main_text("just words, no markup at all, but a sentence") == "just words, no markup at all, but a sentence"
    deep = "<div>" * 3000 + "<article>deep</article>"
    assert main_text(deep) == "deep"
    assert main_text("<article>" + "<p>word</p>" * 20_000) == "\n".join(["word"] * 20_000)


def test_surge_and_dive():
    assert between([0, 0, 5, 9, 0, 0, 7, 0, 0, 0, 9], 1) == [2, 3, 6, 10]
    assert between([0, 3, 0, 0, 0, 50, 60, 0, 2, 0, 0, 0, 3], 40) == [5, 6, 8]
    assert between([], 1) == []


def test_query_rows(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, "x"), (2, "v", "", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = sorted((tuple(r) for r in extract(pages).collect()), key=str)
    assert got == sorted([(1, "u", WANT, len(WANT))] * 2 + [(None, None, "", 0), (2, "v", "", 0)], key=str)
    assert extract(pages.limit(0)).count() == 0


def test_wrappers_named_after_furniture():
    text = "\n".join(f"Paragraph number {i} with quite some running text in it." for i in range(4))
    body = "".join(f"<p>{line}</p>" for line in text.split("\n"))
    menu, talk = '<div class="sidebar"><p>Menu of the page</p></div>', '<div class="comments"><p>' + "Reader text. " * 40 + "</p></div>"
    for name in ("content has-sidebar", "layout-with-sidebar", "no-sidebar", "with-nav", "content header-fixed", "site-content sticky-header", "comments-open post", "page-search-results", "header"):
        for inner in (body, f"<article>{body}</article>"):
            assert main_text(f'{menu}<div class="{name}">{inner}{menu}</div>') == text, name
            assert main_text(f'<form id="aspnet">{menu}<div class="{name}">{inner}</div></form>') == text, name
    assert main_text(f"<div>{body}</div>{talk}") == text
    assert main_text(f'<form><article>{body}</article></form><section id="comments"><article class="comment"><p>Nice!</p></article></section>') == text


def test_teaser_article_beside_the_text():
    text = "\n".join(f"Paragraph number {i} with quite some running text in it." for i in range(4))
    body = "".join(f"<p>{line}</p>" for line in text.split("\n"))
    page = f'<div class="post-body">{body}</div><article class="card"><p>Another story</p></article>'
    assert main_text(page).startswith(text)
    assert main_text(f"<article>{body}</article><div><p>A short line that is outside of it, and long enough.</p></div>") == text


def test_links_and_short_lines_within_the_text():
    long = "A paragraph with quite some running text in it, number"
    links = "".join(f"<li><a href={i}>Source {i}</a></li>" for i in range(4))
    page = f"<p><a href=1>Menu</a></p><p><a href=2>Menu</a></p><p><a href=3>Menu</a></p><p>{long} 1.</p><ul>{links}</ul><h2>Why</h2><ul>{links}</ul><div class=ad>Buy</div><p>{long} 2.</p><p>{long} 3.</p>"
    sources = [f"Source {i}" for i in range(4)]
    assert main_text(page) == "\n".join([f"{long} 1.", *sources, "Why", *sources, f"{long} 2.", f"{long} 3."])


def test_paragraphs_in_badly_named_elements():
    long = "A paragraph with quite some running text in it, and with a second clause that makes it a longer one, number"
    body = "".join(f"<p>{long} {i}.</p>" for i in range(4))
    want = "\n".join(["Title", *(f"{long} {i}." for i in range(4)), "Last."])
    for name in ("tags", "share", "toc", "side", "legal", "related-work", "content side", "notice"):
        assert main_text(f"<article><h1>Title</h1><div class='{name}'>{body}</div><p>Last.</p></article>") == want, name
    for name in ("ad", "sidebar", "comments", "newsletter", "tags", "share"):
        assert main_text(f"<article><h1>Title</h1><div class='{name}'><p>One or two words, perhaps a sentence.</p></div>{body}<p>Last.</p></article>") == want, name


def test_advert_longer_than_a_short_article():
    assert main_text("<div class=ad>Buy this now, it is very good and quite cheap as well.</div><article><h1>Short title.</h1></article>") == "Short title."


def test_windows_against_their_definition():
    rng = random.Random(8)
    for _ in range(300):
        w = [rng.choice([0, 0, 3, 12, 45]) for _ in range(rng.randint(0, 14))]
        n, surge = len(w), rng.choice([1, 20, 40])
        ahead = lambda i: sum(w[i : i + 3])  # noqa: B023,E731
        # a line is text if a surge lies at or before it with no dive between
        want = [j for j in range(n) if w[j] and any(w[i] and ahead(i) >= surge and all(ahead(k) for k in range(i, j + 1)) for i in range(j + 1))]
        assert between(w, surge) == want


def test_known_texts_with_and_without_windows(spark, monkeypatch):
    rng = random.Random(3)
    sentence = lambda k: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(k)).capitalize() + "."
    rows, want = [], {}
    for i in range(120):
        title, body = sentence(6), [sentence(rng.randint(8, 60)) for _ in range(rng.randint(1, 9))]
        aside = f"<div class='{rng.choice(['ad', 'sidebar', 'promo', 'cookie-notice', 'tags'])}'>{sentence(5)}</div>"
        inner = "".join(f"<p>{p}</p>" + (aside if rng.random() < 0.3 else "") for p in body)
        inner = f"<h1>{title}</h1>{inner}"
        inner = f"<article>{inner}</article>" if i % 2 else f"<div class='{rng.choice(['post', 'content', 'entry'])}'>{inner}</div>"
        talk = "".join(f"<p>{sentence(30)}</p>" for _ in range(2))
        rows.append((i, "u", f"<html><body><nav><a href=/>Home</a></nav>{aside}{inner}<div id=comments>{talk}</div><footer>{sentence(9)}</footer></body></html>", "x"))
        want[i] = "\n".join([title, *body])
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in extract(pages).collect()}
    assert got == want
    monkeypatch.setattr(html_text, "between", lambda weights, surge: list(range(len(weights))))
    assert sum(main_text(html) != want[i] for i, _, html, _ in rows) == len(rows)  # surge and dive decide on every page
