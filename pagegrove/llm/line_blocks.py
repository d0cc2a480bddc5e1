"""HTML extraction by line-block distribution (operator 7).

The markup is stripped: scripts, styles, menus, headers (those of an article
stay), footers, sidebars, forms and what is hidden go with their contents, block
elements end a line, inline elements leave no trace.  The lines of the page
are one sequence; tags only say how much a line counts:

* Lines in elements whose class or id names say boilerplate (notices, adverts,
  comments, ...) count 0.  A name says so if all its words do or are neutral
  (``site-footer``, not ``has-sidebar`` or ``related-work``), and a list of names if the
  others say nothing else (not ``topic social science``).  Where no other line
  has text, these names are not believed.
* Boxes are the page's ``main`` (or articleBody) and ``article`` elements; a box
  is measured by its text.  Where the boxes have at least as much text as the rest
  of the page (with a ``main`` that has text, half as much), lines outside count
  0.  In the same way lines of a ``main`` outside of its articles count 0 if
  these have at least as much text.
* Outside of boxes a line that is mostly link text counts 0.
* Any other line counts its length.

These counts are summed over windows of ``WINDOW`` lines.  The text surges at a
line that counts and whose window has at least one ``SHARE``-th of the largest
window (any line of a box does), and dives before a window without any count.
All lines between surge and dive are kept, short ones and links too, except those
that the first two rules made 0.

White space inside a line becomes one space; ``br`` is white space; character
references are decoded.  Null or empty html, and pages without text, give an
empty string.  Unclosed elements end with their parent.  Rows and other
columns stay as they are; repeated rows are extracted each.
"""

from __future__ import annotations

import html
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW, SHARE = 3, 100
# Elements of HTML by what they do here.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "xmp", "noembed", "noframes"}
DROP = {"head", "nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "datalist", "fieldset", "object", "canvas", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {"address", "article", "blockquote", "body", "caption", "center", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6",
         "hgroup", "hr", "html", "li", "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"}
LOOSE = {"p", "li", "dd", "dt", "td", "th", "tr", "thead", "tbody", "tfoot", "option", "h1", "h2", "h3", "h4", "h5", "h6"}
# Words in class or id that mark boilerplate, and roles.
MARKS = {"ad", "ads", "advert", "adverts", "advertisement", "adsense", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies",
         "disqus", "footer", "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "popup", "promo",
         "related", "replies", "respond", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}
# Words beside these that say nothing of their own.
NEUTRAL = {"area", "bar", "block", "body", "bottom", "box", "button", "buttons", "col", "container", "content", "footer", "form", "global", "group", "header", "holder", "icon", "icons",
           "inner", "item", "items", "js", "left", "link", "links", "list", "main", "outer", "page", "panel", "primary", "right", "row", "secondary", "section", "site", "slot", "text",
           "title", "top", "unit", "wrap", "wrapper"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alert", "alertdialog"}
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)\]\]>|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"(=?[^\s/>=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>][^\s>]*)))?")
_SPLIT = re.compile(r"[^a-z0-9]+")
_CLOSE = {t: re.compile(rf"</{t}\s*[^>]*>", re.I) for t in RAW}


def attributes(attrs: str) -> Iterator[tuple[str, str]]:
    """All attributes of a tag from left to right, ``(whole name, value)`` in lower case."""
    for m in _ATTR.finditer(attrs):
        yield m[1].lower(), (m[2] or m[3] or m[4] or "").lower()


def _says_boilerplate(names: str) -> bool:
    """Whether class or id names mark boilerplate and nothing else."""
    found = False
    for name in names.split():
        words = [w for w in _SPLIT.split(name) if w and not w.isdigit()]
        if not NEUTRAL.union(MARKS).issuperset(words):
            if any(c.isdigit() for c in name):
                continue  # of a grid or a counter
            return False
        found |= not MARKS.isdisjoint(words)
    return found


KEPT, MARKED, GONE = 0, 1, 2


def _boilerplate(tag: str, attrs: str, in_box: bool) -> int:
    """Whether an element stays, counts 0, or goes with its contents."""
    if tag in DROP and not (tag == "header" and in_box):
        return GONE
    if not attrs or "=" not in attrs and "hidden" not in attrs.lower():
        return KEPT
    marked = KEPT
    for name, value in attributes(attrs):
        if name == "hidden" or name == "aria-hidden" and value == "true" and tag != "body":
            return GONE
        if name == "role" and value.strip() in ROLES:
            return GONE
        if name in ("class", "id") and tag not in ("html", "body", "article", "main") and _says_boilerplate(value):
            marked = MARKED
        if name == "class" and tag == "article" and not {"comment", "comments", "reply", "ad", "advert", "related", "teaser"}.isdisjoint(value.split()):
            marked = MARKED
    return marked


def lines_of(page: str) -> list[tuple[str, int, int, int, int]]:
    """Lines ``(text, characters of link text, numbers of the main and of the article that they lie in, or 0, marked elements around)``."""
    lines: list[tuple[str, int, int, int, int]] = []
    text: list[str] = []
    links = n_link = 0
    stack: list[tuple[str, int, int, int]] = []  # open containers: tag, what becomes of them, main and article around
    count: dict[str, int] = {}
    skip = marked = main = article = n_boxes = 0
    at, size = 0, len(page)

    def flush() -> None:
        nonlocal n_link
        if text:
            s = " ".join(html.unescape("".join(text)).split())
            if s:
                lines.append((s, n_link, main, article, marked))
            text.clear()
        n_link = 0

    def put(s: str) -> None:
        nonlocal n_link
        if s and not skip:
            text.append(s)
            if links:
                n_link += len(s)

    while at < size:
        m = _TOKEN.search(page, at)
        if not m:
            put(page[at:])
            break
        put(page[at:m.start()])
        at = m.end()
        if m[1] is not None:
            put(m[1].replace("&", "&amp;"))
        if m[3] is None:
            continue
        tag, attrs = m[3].lower(), m[4]
        if m[2]:
            if tag == "a":
                links = max(0, links - 1)
            if tag in BLOCK or tag in DROP:
                flush()
            if count.get(tag):
                while stack:
                    t, fate, main, article = stack.pop()
                    count[t] -= 1
                    skip -= fate == GONE
                    marked -= fate == MARKED
                    if t == tag:
                        break
            continue
        if tag in RAW:
            end = _CLOSE[tag].search(page, at)
            at = end.end() if end else size
            continue
        if tag == "br":
            put(" ")
            continue
        if tag in BLOCK or tag in DROP:
            flush()
        if tag in VOID:
            continue
        fate = _boilerplate(tag, attrs, bool(main or article))
        if attrs.endswith("/") and tag not in BLOCK:
            continue
        if tag == "a":
            links += 1
        if fate and tag == "a":
            continue
        if tag in BLOCK | DROP and tag not in LOOSE or fate:
            stack.append((tag, fate, main, article))
            count[tag] = count.get(tag, 0) + 1
            skip += fate == GONE
            marked += fate == MARKED
            if not skip and not marked and not article:
                if tag == "article":
                    n_boxes += 1
                    article = n_boxes
                elif not main and (tag == "main" or "articleBody" in attrs and ("itemprop", "articlebody") in attributes(attrs)):
                    n_boxes += 1
                    main = n_boxes
    flush()
    return lines


def counts(lines: list[tuple[str, int, int, int, int]]) -> tuple[list[int], list[bool], list[bool]]:
    """What each line counts, whether it lies in a box, and whether it can never be kept."""
    believed = any(not marked for *_, marked in lines)
    out = [believed and marked > 0 for *_, marked in lines]
    plain = [len(s) * (2 * linked <= len(s)) for s, linked, *_ in lines]
    box = [bool(main or article) for _, _, main, article, _ in lines]
    boxed = sum(len(x[0]) for x, b, o in zip(lines, box, out, strict=True) if b and not o)
    rest = sum(x for x, b, o in zip(plain, box, out, strict=True) if not b and not o)
    if boxed and rest <= boxed * (2 if any(x[2] for x in lines) else 1):
        more: dict[int, int] = {}  # for each main with articles: how much more text they have than the rest of it
        for (s, _, main, article, _), x, o in zip(lines, plain, out, strict=True):
            more[main] = more.get(main, 0) + (0 if o else len(s) if article else -x)
        inside = {main for _, _, main, article, _ in lines if main and article}
        kept = [article or main and (main not in inside or more[main] < 0) for _, _, main, article, _ in lines]
        out = [o or not k for o, k in zip(out, kept, strict=True)]
    n = [0 if o else len(x[0]) if b else p for x, p, b, o in zip(lines, plain, box, out, strict=True)]
    return n, box, out


def stretches(n: list[int], box: list[bool]) -> Iterator[tuple[int, int]]:
    """``(surge, dive)`` of each stretch of lines between a surge and the next empty window."""
    sums = [sum(n[i:i + WINDOW]) for i in range(len(n) + 1)]
    least = max(sums) / SHARE
    start, last = -1, 0
    for i, x in enumerate(n):
        if start < 0 and x and (box[i] or sums[i] >= least):
            start = i
        if start >= 0:
            last = i if x else last
            if not sums[i + 1]:
                yield start, last
                start = -1


def main_text(page: str | None) -> str:
    """The lines of the page's main text, joined by newlines."""
    lines = lines_of(page or "")
    n, box, out = counts(lines)
    return "\n".join(lines[i][0] for surge, dive in stretches(n, box) for i in range(surge, dive + 1) if not out[i])


def extract(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """All rows and columns of ``pages`` with the main text in column ``out`` (replaced if there is one)."""
    def run(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in it:
            yield pa.array([main_text(x) for x in arr.to_pylist()], pa.string())
    return pages.withColumn(out, F.arrow_udf(run, "string").asNondeterministic()(html_col))
