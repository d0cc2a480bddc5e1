"""HTML -> relational.

D1 is the only Python that runs inside tasks: an iterator Arrow UDF
that tokenises each page with the standard-library ``html.parser`` and
emits the page's element tree as ``array<struct>`` (schema
``pagegrove.schemas.DOM_NODE``), a bounded number of nodes at a time.  Everything else in this module is a
native Column expression over that array: no shuffle, no Python.

Tree-building rules (those of a non-repairing, stdlib-tokenizer tree):
no implied end tags; an end tag closes the nearest open element of that
name and is ignored when there is none; void elements never hold
children; no html/head/body is invented; script/style content is opaque;
whitespace-only strings collapse to one space or newline.

Node kinds (``tag``): element names in lower case, ``#document`` (the
root, node 0), ``#text`` (strings that count as text), ``#rawtext``
(script/style/template content), ``#comment``, ``#doctype``, ``#pi``.
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F

from pagegrove.functions.text import PY_STRIP, let
from pagegrove.operators import htmltree
from pagegrove.operators.htmltree import parse_html  # noqa: F401  (re-export)
from pagegrove.schemas import DOM

# Ship the tokenizer module by value: workers need no installed package.
cloudpickle.register_pickle_by_value(htmltree)
_dom_udf = F.arrow_udf(htmltree.dom_chunks, DOM)


def with_dom(pages, html_col: str = "html", out: str = "dom"):
    """Add the ``dom`` array column.  Filter and project *before* this
    call: the UDF is a barrier for predicate pushdown."""
    return pages.withColumn(out, _dom_udf(F.col(html_col)))


# ---------------------------------------------------------------------------
# Page-local expressions over the dom array (``d`` = the array column)
# ---------------------------------------------------------------------------

def _d(dom) -> Column:
    return F.col(dom) if isinstance(dom, str) else dom


def is_desc(n: Column, anc: Column) -> Column:
    """``n`` is a proper descendant of ``anc`` (both node structs)."""
    return (n["node_id"] > anc["node_id"]) & (n["node_id"] <= anc["end_id"])


def has_ancestor(dom, n: Column, pred) -> Column:
    """Whether a proper ancestor of node ``n`` satisfies ``pred`` (a walk
    along ``parent_id``; ids are positions)."""
    d = _d(dom)
    start = F.struct(n["parent_id"].alias("at"), F.lit(False).alias("hit"))

    def up(s, _i):
        return F.when(s["hit"] | s["at"].isNull(), s).otherwise(F.struct(
            d[s["at"]]["parent_id"].alias("at"), F.coalesce(pred(d[s["at"]]), F.lit(False)).alias("hit")))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n["depth"], F.lit(1))), start, up, lambda s: s["hit"])


def subtree_ids(n_id: Column, n_end: Column) -> Column:
    """Ids of the proper descendants of a node of the whole (unfiltered) tree."""
    return F.when(n_end > n_id, F.sequence(n_id + 1, n_end)).otherwise(F.array().cast("array<int>"))


def strip_boilerplate(dom) -> Column:
    """The dom without the subtrees of boilerplate elements, which the
    parse has marked."""
    return F.filter(_d(dom), lambda n: ~n["boiler"])


def first_node(dom, pred) -> Column:
    """First node (document order) satisfying ``pred``; null if none."""
    return F.try_element_at(F.filter(_d(dom), pred), F.lit(1))


def main_content(dom) -> Column:
    """D3: first ``main`` or ``article``, else first ``body``; null if none."""
    d = _d(dom)
    return F.coalesce(first_node(d, lambda n: n["tag"].isin("main", "article")),
                      first_node(d, lambda n: n["tag"] == "body"))


def descendant_strings(dom, anc: Column, alive: bool = False) -> Column:
    """Text strings below ``anc`` in document order, without boilerplate if
    ``alive``.  ``dom`` is the whole tree: positions are read, no scan."""
    d = _d(dom)

    def wanted(i):
        text = d[i]["tag"] == "#text"
        return text & ~d[i]["boiler"] if alive else text
    return let(anc, lambda a: F.transform(F.filter(subtree_ids(a["node_id"], a["end_id"]), wanted), lambda i: d[i]["text"]))


def element_text(dom, anc: Column, strip: bool = True, sep: str = "", alive: bool = False) -> Column:
    """D6 (``strip=True``): each string stripped, empties dropped, joined by
    ``sep``.  D7 (``strip=False``): strings joined, then the ends stripped."""
    strings = descendant_strings(dom, anc, alive)
    if strip:
        parts = F.filter(F.transform(strings, lambda s: F.regexp_replace(s, PY_STRIP, "")),
                         lambda s: s != "")
        return F.array_join(parts, sep)
    return F.regexp_replace(F.array_join(strings, ""), PY_STRIP, "")


def element_string(dom, anc: Column) -> Column:
    """The only string of an element (a single-child chain ending in a
    string), else null.  In pre-order the descendants form a chain exactly
    when the last one sits ``count`` levels below ``anc``; works on a
    filtered tree too."""
    def body(a):
        desc = F.filter(_d(dom), lambda n: is_desc(n, a))
        return let(F.struct(F.size(desc).alias("k"), F.try_element_at(desc, F.lit(-1)).alias("last")),
                   lambda v: F.when((v["k"] >= 1) & ((v["last"]["depth"] - a["depth"]) == v["k"])
                                    & v["last"]["tag"].startswith("#"), v["last"]["text"]))
    return let(anc, body)


def meta_content(dom, key: str, value: str) -> Column:
    """The first ``meta`` whose attribute ``key`` equals ``value``
    (the node itself; ``['attrs']['content']`` is the content)."""
    return first_node(dom, lambda n: (n["tag"] == "meta") & (n["attrs"][key] == value))
