"""Main text of web pages by line-block distribution.

Markup is stripped first: a page is cut into lines at block-level tags; script, style and other unshown content, comments and
tags go. Each line then has a weight, and over the weights runs a window of WINDOW lines: where its sum rises to the surge
level a text begins, where it falls to zero the text ends, and the lines between are kept if they have a fifth or more of
the longest text's weight.

A line weighs as many characters as it has outside of links (nothing, if half or more are links). Tags only change weights.
Lines within elements that are no article by their name, role, class or id (menus, headers, footers, sidebars, notices,
adverts, forms, reader comments) weigh nothing and are no position of the window, unless such an element holds the marked
article, or more than half of the page's block text and no more than a hint speaks against it; if that leaves nothing, only
elements such as nav and footer count as such. A class or id is a hint if all of its words are hints or say nothing of the
content (box, left, inner). Where a page marks its article or main part, each of its lines weighs SURGE or more, so that no
window over it falls, and lines outside weigh nothing.

Defined results: null and empty pages, and pages without text, give an empty text; unclosed elements and comments last to
the end of the page, but for end tags that may be left out (of head, p, li, dt, dd, and of tables' parts); quotes in tags
count after an equals sign only; character references are decoded once; white space within a line becomes one space; lines
are joined by one space in page order; equal pages give equal texts; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import table, text_bytes

WINDOW = 3
SURGE = 60
SHARE = 0.2

_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*)(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
#: Elements whose content up to their own end tag is no markup and isn't shown.
_RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "noembed", "noframes"}
_UNSHOWN = {"head", "template", "svg", "math", "object", "canvas", "audio", "video", "dialog", "select", "datalist", "button"}
_ASIDE = {"nav", "footer", "aside", "form", "menu"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rb", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "nobr", "input", "link", "meta"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar"}
#: Parts of class names and ids of what is no article.
_HINTS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "gdpr", "notice", "newsletter", "subscribe",
    "subscription", "signup", "login", "sidebar", "aside", "widget", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "masthead", "footer", "comment", "comments", "disqus", "respond", "replies",
    "related", "recommended", "share", "sharing", "social", "popup", "modal", "overlay", "toolbar", "pagination", "pager", "copyright", "skip", "paywall",
}
#: Parts that say nothing of the content, beside which a hint still is one.
_PLAIN = {
    "area", "bar", "block", "body", "bottom", "box", "button", "buttons", "center", "column", "col", "container", "content", "contents", "count", "desktop", "form", "global", "group", "header", "heading", "holder", "icon", "icons", "inline", "inner", "item",
    "items", "label", "large", "left", "link", "links", "list", "main", "message", "mobile", "outer", "overlay", "page", "pane", "panel", "primary", "reader", "readers", "right", "row", "secondary", "section", "site", "slot", "small", "space", "sticky",
    "text", "title", "top", "unit", "user", "view", "wrap", "wrapper", "zone", "article", "articles", "post", "posts", "stories", "media", "policy", "a", "b", "c", "js", "l", "m", "s", "x",
}
#: Of these, what names reader comments; such parts are aside however long they are.
_COMMENTS = {"comment", "comments", "disqus", "respond", "replies"}
#: A hint after one of these tells what an element has or has not, not what it is.
_DENIED = {"has", "have", "with", "without", "no", "not", "non", "hide", "hidden"}
_MAIN = {"article", "main"}
_MAIN_ROLE = re.compile(r"role\s*=\s*[\"']?main\b", re.I)
_PAIRS = {("side", "bar"), ("site", "header"), ("page", "header"), ("top", "bar"), ("sign", "up"), ("log", "in"), ("skip", "link")}
#: A start tag of these ends an open p.
_ENDS_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}


def _kind(tag: str, raw: str, in_article: bool) -> str:
    """"unshown", or how an element tells that it is no part of the article: "tag", "comments" or "hint"; else empty."""
    if tag in _UNSHOWN:
        return "unshown"
    kind = "hint" if tag == "form" else "tag" if tag in _ASIDE or (tag == "header" and not in_article) else ""
    if not raw or tag in ("html", "body"):
        return kind
    part = tag in _MAIN or _MAIN_ROLE.search(raw) is not None
    for m in _ATTRIBUTE.finditer(raw):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value.lower() == "true"):
            return "unshown"
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return "unshown"
        if kind or part:
            continue
        if name in ("class", "id"):
            for one in value.split():
                parts = [p.lower() for p in _NAME_PART.findall(one)]
                told = [k for k, p in enumerate(parts) if p in _HINTS or tuple(parts[k : k + 2]) in _PAIRS]
                told = [k for k in told if _DENIED.isdisjoint(parts[:k])]
                if told and all(p in _HINTS or p in _PLAIN or p.isdigit() or len(p) == 1 or any(tuple(parts[j : j + 2]) in _PAIRS for j in (k - 1, k) if j >= 0) for k, p in enumerate(parts)):
                    kind = "comments" if any(parts[k] in _COMMENTS for k in told) else "hint"
                    break
        elif name == "role" and value.lower() in _ROLES:
            kind = "hint"
    return kind


#: What an open element of the first kind ends with: a start tag of the second; and elements that keep it open from outside.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option", "optgroup"}, {"select"}), "td": ({"td", "th", "tr", "tbody", "thead", "tfoot"}, {"table"}),
    "th": ({"td", "th", "tr", "tbody", "thead", "tfoot"}, {"table"}), "tr": ({"tr", "tbody", "thead", "tfoot"}, {"table"}), "tbody": ({"tbody", "tfoot"}, {"table"}), "thead": ({"tbody", "tfoot"}, {"table"}), "p": (_ENDS_P, {"table", "button", "object"}),
}
_ENDED_BY: dict[str, list[str]] = {}
for _name, (_by, _) in _ENDS.items():
    for _tag in _by:
        _ENDED_BY.setdefault(_tag, []).append(_name)
#: What a head may hold; another start tag ends it.
_IN_HEAD = {"base", "basefont", "bgsound", "head", "link", "meta", "noscript", "script", "style", "template", "title"}


class _Open:
    """The open elements of a page. Each has a name, whether it is unshown, the innermost element around that may be aside (its number, or -1), that of the article's beginning (None outside of articles), and whether it is in a link."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool, int, int | None, bool]] = []
        self.places: dict[str, list[int]] = {}

    def state(self) -> tuple[bool, int, int | None, bool]:
        return self.stack[-1][1:] if self.stack else (False, -1, None, False)

    def push(self, name: str, *state) -> None:
        self.places.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, *state))

    def place(self, name: str) -> int:
        """Of the nearest one of that name; -1 if there is none."""
        found = self.places.get(name)
        return found[-1] if found else -1

    def close(self, place: int) -> None:
        """The element there ends, with those in it."""
        while len(self.stack) > place:
            self.places[self.stack.pop()[0]].pop()

    def implied_ends(self, tag: str) -> None:
        """A start tag ends elements whose end tags may be left out."""
        if tag not in _IN_HEAD and (head := self.place("head")) >= 0:
            self.close(head)
        for name in _ENDED_BY.get(tag, ()):
            at = self.place(name)
            if at >= 0 and all(self.place(around) < at for around in _ENDS[name][1]):
                self.close(at)


def lines(page: str, sure: bool = True) -> list[tuple[str, int, bool, bool]]:
    """Each shown line's text, its length (without spaces and links; 0 if half or more is links), whether it is aside, and whether it is in a marked article.

    An element is not aside if it holds more than half of the text of marked articles that begin in it, or if only a hint
    tells so and it holds more than half of the page's block text; with sure off, hints and comments count for nothing.
    """
    out: list[tuple[str, int, int, int | None]] = []
    parts: list[str] = []
    linked = 0
    now, kinds, parents = _Open(), [], []  # how each element that may be aside tells so, and the number of the next one around it

    def flush() -> None:
        nonlocal linked
        shut, mark, article, _ = now.state()
        text = "" if shut else " ".join(html.unescape("".join(parts)).split())
        if text:
            plain = len(text) - text.count(" ") - linked
            out.append((text, plain if plain > linked else 0, mark, article))
        parts.clear()
        linked = 0

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        text = page[at : m.start() if m else n]
        if text:
            parts.append(text)
            if now.state()[3]:
                linked += len("".join(html.unescape(text).split()))
        if not m:
            break
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag not in _INLINE:
                flush()
            now.implied_ends(tag)
            if tag in _RAW:
                end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else n
                continue
            if tag in _VOID or m[2].endswith("/") and tag in ("svg", "path"):
                continue
            shut, mark, article, link = now.state()
            inside = article is not None or tag in _MAIN or ("role" in m[2] and _MAIN_ROLE.search(m[2]) is not None)
            kind = _kind(tag, m[2], inside)
            if inside and article is None:
                article = mark
            if kind and kind != "unshown":
                parents.append(mark)
                mark = len(kinds)
                kinds.append(kind)
            now.push(tag, shut or kind == "unshown", mark, article, link or tag == "a")
        elif m[3]:
            tag = m[3].lower()
            if tag not in _INLINE:
                flush()
            if (place := now.place(tag)) >= 0:
                now.close(place)
    flush()
    around, held = [0] * len(kinds), [0] * len(kinds)
    for text, plain, mark, start in out:
        if mark >= 0:
            held[mark] += plain
        if start is not None and start >= 0:
            around[start] += len(text)
    for k in range(len(kinds) - 1, -1, -1):  # an element's number is above that of the one around it
        if parents[k] >= 0:
            held[parents[k]] += held[k]
            around[parents[k]] += around[k]
    marked = sum(len(text) for text, *_, start in out if start is not None)
    total = sum(plain for _, plain, *_ in out)
    aside: list[bool] = []
    for k, kind in enumerate(kinds):
        own = (sure or kind == "tag") and not (marked and 2 * around[k] > marked) and not (kind == "hint" and 2 * held[k] > total)
        aside.append(own or (parents[k] >= 0 and aside[parents[k]]))
    return [(text, plain, mark >= 0 and aside[mark], start is not None) for text, plain, mark, start in out]


def texts(weights: list[int]) -> Iterator[tuple[int, int]]:
    """Ranges of lines from surge to dive."""
    n = len(weights)
    sums = [sum(weights[i : i + WINDOW]) for i in range(n)]
    level = min(SURGE, max(sums, default=0) / 4)
    i = 0
    while i < n:
        if not sums[i] or sums[i] < level:
            i += 1
            continue
        first = i
        while first and weights[first - 1]:
            first -= 1
        while not weights[first]:
            first += 1
        last = i
        while last < n and sums[last]:
            last += 1
        yield first, last
        i = last


def _of_lines(found: list[tuple[str, int, bool, bool]]) -> str:
    found = [line for line in found if not line[2]]  # what is excluded is no position of the window either
    marked = any(article for *_, article in found)
    weights = [(max(SURGE, plain) if article else 0) if marked else plain for _, plain, _, article in found]
    ranges = [(first, last, sum(weights[first:last])) for first, last in texts(weights)]
    least = 0 if marked else SHARE * max((w for *_, w in ranges), default=0)
    return " ".join(found[i][0] for first, last, w in ranges if w >= least for i in range(first, last) if weights[i] or not marked)


def main_text(page: str | None) -> str:
    got = _of_lines(lines(page or ""))
    if got or not page:
        return got
    # Names and roles left nothing: only elements such as nav and footer are left out, unless the article is marked and empty.
    found = lines(page, sure=False)
    return _of_lines(found) if any(article for *_, article in found) or not re.search(r"<(?:article|main)[\s>]", page, re.I) else ""


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """key, url, text and n_chars, the text's code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [main_text(x.decode("utf-8", "replace")) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], ["key", "url", "text", "n_chars"])

    kind = pages.schema[key].dataType.simpleString()
    out = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), text_bytes(F.col(page)).alias("raw")).mapInArrow(run, f"key {kind}, url string, text string, n_chars long")
    return out.withColumnRenamed("key", key)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
