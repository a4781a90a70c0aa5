from __future__ import annotations

import html
import re
import time

from tesserae.llm.html_text import extract, main_text, texts

PAGE = """<!doctype html><html><head><title>T</title><style>p{}</style></head><body>
<header class="site-header"><a href=/>Home</a> Daily News</header><nav><ul><li><a>World</a><li><a>Sports</a></ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>The &amp;lt;title&amp;gt;</h1><p>First   para<b>graph</b>
 &eacute;<!-- hidden <p> -->end.<script>var a="</p><p>no";</script></p><div class="ad-slot">Buy now</div><p>Second<br>line.</p>
<section id="comments"><p>I disagree</p></section></article><aside>Related</aside><form>Mail <input></form><footer>(c)</footer></body></html>"""


def test_marked_article():
    assert main_text(PAGE) == "The &lt;title&gt; First paragraph éend. Second line."


def test_unmarked_page_keeps_the_long_text():
    page = "<div><a>One</a> <a>Two</a> <a>Three</a></div>" + "<div>x</div>" * 0 + "<ul>" + "<li><a>menu item</a>" * 8 + "</ul>" + "<h1>Head</h1>" + "<p>Some long sentence that goes on for quite a while, with words.</p>" * 4 + "<div><a>a</a></div>" * 5 + "<div>tiny</div>"
    got = main_text(page)
    assert got.startswith("Head Some long") and got.endswith("words.") and "menu" not in got and "tiny" not in got


def test_surge_and_dive():
    assert list(texts([0, 5, 100, 80, 0, 0, 0, 0, 90, 0, 0, 0])) == [(1, 4), (8, 9)]
    assert list(texts([])) == [] and list(texts([0, 0])) == []


def test_odd_pages():
    assert main_text(None) == main_text("") == main_text("<!-- never closed <p>x") == main_text("<script>x") == ""
    assert main_text("plain & simple") == "plain & simple"
    assert main_text("<article><p>never closed <b>at all") == "never closed at all"
    assert main_text("<article><p>a < b and 1<2</p></article>") == "a < b and 1<2"
    assert len(main_text("<article>" + "<p>w</p>" * 20_000)) == 39_999


def test_short_lines_of_a_marked_article_stay():
    share = "<ul class='share'><li>a</li><li>b</li><li>c</li><li>d</li></ul>"
    long = "Words of a long paragraph that goes on and on. " * 10
    assert main_text(f"<article><h1>Short title</h1>{share}<p>{long}</p>{share}<p>The end.</p></article>") == f"Short title {long}The end."
    assert main_text(f"<h1>Short title</h1>{share}<p>{long}</p>{share}<p>The end.</p>") == f"Short title {long}The end."


def test_wrappers_named_like_boilerplate_stay():
    long = "Words of a long paragraph that goes on and on."
    text = f"<p>{long}</p>" * 5
    want = " ".join([long] * 5)
    side = "<div class='sidebar'>Side words</div>"
    for head, tail in [("<div class='layout has-sidebar'>", "</div>"), ("<div class='widget page'>", "</div>"), ("<main class='no-banner'>", "</main>"), ("<article class='post comment-open'>", "</article>"), ("<form id=aspnetForm>", "</form>"), ("<form><main>", "</main></form>"), ("<div role=form><article>", "</article></div>"), ("<div class='comments'>", "</div>")]:
        assert main_text(f"{head}{text}{tail}") == want
        if "comments" not in head:
            assert main_text(f"{head}{side}{text}{tail}{side}") == want
    assert main_text(f"<article><p>{long}</p><div id=comments>{text}</div></article>") == long
    assert main_text(f"<article><p>{long}</p></article><aside><article>Other</article></aside>") == long
    assert main_text("<div hidden>Not shown</div>") == main_text("<nav>Home</nav><article></article><div class=ad>Buy</div>") == ""


def test_omitted_end_tags_wrappers_and_quotes():
    long = "Words of a long paragraph that goes on and on."
    assert main_text(f"<html><head><meta charset=x><title>T</title><link rel=y><body><p>{long}</p>") == long
    assert main_text(f"<html><head><title>T</title><p>{long}</p>") == long
    assert main_text(f"<div id=page class=has-sidebar><p>{long}</p><div class=sidebar>Side</div></div>") == long
    assert main_text(f"<article><p>{long}</p><div class=related-work><p>Earlier work</p></div><div class=related-posts>More</div></article>") == f"{long} Earlier work"
    assert main_text(f"<table><tr><td class=menu>Menu<td>{long}<tr><td class=menu>Menu<td>{long}</table>") == f"{long} {long}"
    assert main_text(f"<article><p title=it's>{long}</p><p>It's <a href=\"x>y\">here</a></p></article>") == f"{long} It's here"
    assert main_text(f"<article><p>{long} <a href=\"foo>link</a></p></article>") == f"{long} link"
    assert main_text(f"<article><ul><li>{long}<ul><li>Inner</ul><li>Next</ul><dl><dt>T<dd>D<dt>U</dl></article>") == f"{long} Inner Next T D U"


def test_time_follows_the_length():
    for piece in ("<div>", "<p><span>", "<nav>", "<li><b>", "<div class=ad>", "<td>", "<a href='", "<!--", "</p>", "<div class=\""):
        began = time.process_time()
        main_text(piece * 40_000 + "x")
        assert time.process_time() - began < 6


def by_windows(page):
    """The line-block rule in plain steps, for pages of p, h1, li, br and div without nested boilerplate."""
    for shut in ("head", "script", "style", "nav", "footer"):
        page = re.sub(rf"<{shut}\b.*?</{shut}>", "\n", page, flags=re.S)
    page = re.sub(r'<div class="ad">.*?</div>', "\0", page, flags=re.S)
    ls = [" ".join(html.unescape(t).split()) for t in re.split("<[^>]*>|\0", re.sub("</?b>", "", page))]
    ls = [t for t in ls if t]
    w = [len(t.replace(" ", "")) for t in ls]
    sums = [sum(w[i : i + 3]) for i in range(len(w))]
    level = min(60, max(sums, default=0) / 4)
    keep, i = [], 0
    while i < len(w):
        if sums[i] >= level and sums[i]:
            last = next((j for j in range(i, len(w)) if not sums[j]), len(w))
            first = i
            while first and w[first - 1]:
                first -= 1
            while not w[first]:
                first += 1
            keep.append((first, last))
            i = last
        else:
            i += 1
    most = max((sum(w[a:b]) for a, b in keep), default=0)
    return " ".join(t for a, b in keep if sum(w[a:b]) >= most / 5 for t in ls[a:b])


def test_windows_decide_on_unmarked_pages(spark, small):
    rows = spark.read.parquet(f"{small}/pages.parquet").collect()
    for r in rows:
        bare = re.sub("<(/?)article>", r"<\1div>", r.html)
        assert "<article" not in bare and main_text(bare) == by_windows(bare) == main_text(r.html)
    assert len(rows) > 20


def test_frames(spark):
    rows = [(1, "u", PAGE, "x"), (None, None, None, "y"), (2, "u", "", "z"), (2, "u", "", "z")]
    out = extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"))
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = out.collect()
    assert len(got) == 4 and all(r.n_chars == len(r.text) for r in got) and sum(bool(r.text) for r in got) == 1
    assert extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_all_pages_by_brute_force(spark, small):
    for r in spark.read.parquet(f"{small}/pages.parquet").collect():
        inner = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        want = " ".join(html.unescape(re.sub("<[^>]*>", " ", re.sub("</?b>", "", inner))).split())
        assert main_text(r.html) == want
