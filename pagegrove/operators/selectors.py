"""CSS selectors as Column predicates over dom nodes.

A selector is compiled once on the driver into a predicate ``n -> Column``
over a node struct of the page's ``dom`` array.  Supported subset: type
selectors and ``*``, ``#id``, ``.class``, ``[a]``, ``[a="v"]``, ``[a*="v"]``,
``[a^="v"]``, ``[a$="v"]``, ``[a~="v"]``, ``[a|="v"]``, ``:not(compound)``,
``:scope``, the descendant and child combinators, and comma lists.
Anything else raises ``ValueError`` on the driver (the browser would throw
too).  Ancestors are those of the whole page, so a descendant match may leave the element the query started from, exactly as
``element.querySelectorAll`` does.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagegrove.functions.text import let
from pagegrove.functions.urls import host_contains
from pagegrove.operators.dom import has_ancestor

Pred = Callable[[Column], Column]
# Class lists and ``~=`` words are split at ASCII white space.
ASCII_WS = r"[ \t\n\f\r]"


def _unescape(name: str) -> str:
    """An identifier without its escapes: ``md\\:flex`` is ``md:flex``."""
    return re.sub(r"\\(.)", r"\1", name)

_IDENT = r"-?(?:[A-Za-z_]|[^\x00-\x7f]|\\.)(?:[A-Za-z0-9_\-]|[^\x00-\x7f]|\\.)*"
_TOKEN = re.compile(
    r"\s*(?P<comb>>)\s*|(?P<ws>\s+)|(?P<comma>,)\s*|(?P<star>\*)|(?P<tag>" + _IDENT + r")"
    r"|#(?P<id>" + _IDENT + r")|\.(?P<cls>" + _IDENT + r")"
    r"|\[\s*(?P<attr>" + _IDENT + r")\s*(?:(?P<op>[*^$~|]?=)\s*(?:\"(?P<dq>[^\"]*)\"|'(?P<sq>[^']*)'|(?P<bare>" + _IDENT + r"))\s*)?\]"
    r"|:not\((?P<not>[^()]*)\)|(?P<scope>:scope)"
)


def _element(n: Column) -> Column:
    return ~n["tag"].startswith("#")


def _attr_pred(name: str, op: str | None, val: str | None) -> Pred:
    name = name.lower()
    if op is None:
        return lambda n: _element(n) & F.coalesce(F.map_contains_key(n["attrs"], name), F.lit(False))
    v = n_val = val if val is not None else ""

    def pred(n: Column) -> Column:
        a = n["attrs"][name]
        if op == "=":
            c = a == n_val
        elif op == "~=":
            c = F.array_contains(F.split(a, f"{ASCII_WS}+"), n_val) if v and not re.search(r"\s", v) else F.lit(False)
        elif op == "|=":
            c = (a == v) | a.startswith(v + "-")
        elif not v:  # *= ^= $= with an empty value never match
            c = F.lit(False)
        elif op == "*=":
            c = a.contains(v)
        elif op == "^=":
            c = a.startswith(v)
        else:
            c = a.endswith(v)
        return _element(n) & F.coalesce(c, F.lit(False))
    return pred


def _compound(parts: list[Pred]) -> Pred:
    def pred(n: Column) -> Column:
        c = _element(n)
        for p in parts:
            c = c & p(n)
        return c
    return pred


def _parse_compound(tokens: list[re.Match], i: int, scope: Pred | None) -> tuple[Pred, int]:
    parts: list[Pred] = []
    while i < len(tokens):
        m = tokens[i]
        if m.group("star") is not None:
            pass
        elif m.group("tag") is not None:
            t = m.group("tag").lower()
            parts.append(lambda n, t=t: n["tag"] == t)
        elif m.group("id") is not None:
            v = _unescape(m.group("id"))
            parts.append(lambda n, v=v: F.coalesce(n["attrs"]["id"] == v, F.lit(False)))
        elif m.group("cls") is not None:
            v = _unescape(m.group("cls"))
            parts.append(lambda n, v=v: F.coalesce(
                F.array_contains(F.split(n["attrs"]["class"], f"{ASCII_WS}+"), v), F.lit(False)))
        elif m.group("attr") is not None:
            val = m.group("dq") if m.group("dq") is not None else (
                m.group("sq") if m.group("sq") is not None else m.group("bare"))
            parts.append(_attr_pred(m.group("attr"), m.group("op"), val))
        elif m.group("not") is not None:
            inner = compile_selector(m.group("not"), scope=scope)
            parts.append(lambda n, inner=inner: ~inner(n))
        elif m.group("scope") is not None:
            if scope is None:
                raise ValueError(":scope needs a scope element")
            parts.append(scope)
        else:
            break
        i += 1
    if not parts and not (i > 0 and tokens[i - 1].group("star") is not None):
        raise ValueError("empty compound selector")
    return _compound(parts), i


Steps = list[tuple[str | None, Pred]]


def _parse(selector: str, scope: Pred | None = None) -> list[Steps]:
    """The alternatives of a selector list, each as compounds with the combinator before them."""
    text = selector.strip()
    if not text:
        raise ValueError("empty selector")
    pos, tokens = 0, []
    while pos < len(text):
        m = _TOKEN.match(text, pos)
        if not m or m.end() == pos:
            raise ValueError(f"unsupported selector syntax at {text[pos:]!r}")
        tokens.append(m)
        pos = m.end()

    alternatives: list[Steps] = []
    i = 0
    while i < len(tokens):
        # one complex selector: compound (combinator compound)*
        steps: Steps = []
        comb = None
        while i < len(tokens) and tokens[i].group("comma") is None:
            m = tokens[i]
            if m.group("comb") is not None:
                comb = ">"
                i += 1
                continue
            if m.group("ws") is not None:
                comb = comb or " "
                i += 1
                continue
            p, i = _parse_compound(tokens, i, scope)
            steps.append((comb if steps else None, p))
            comb = None
        if not steps:
            raise ValueError("empty selector in list")
        alternatives.append(steps)
        i += 1  # skip comma
    return alternatives


def has_combinator(selector: str) -> bool:
    return any(len(steps) > 1 for steps in _parse(selector, lambda n: F.lit(True)))


def compile_selector(selector: str, dom: Column | str = "dom", scope: Pred | None = None) -> Pred:
    """Compile ``selector`` into ``node -> Column`` over the array ``dom``.

    Combinators walk up from each node; for a whole page ``match_flags``
    takes fewer steps."""
    d = F.col(dom) if isinstance(dom, str) else dom
    alternatives = [_chain(steps, d) for steps in _parse(selector, scope)]

    def pred(n: Column) -> Column:
        c = alternatives[0](n)
        for a in alternatives[1:]:
            c = c | a(n)
        return c
    return pred


def _chain(steps: Steps, d: Column) -> Pred:
    """Right-to-left matching of ``A B > C`` along the ancestors."""
    if len(steps) == 1:
        return steps[0][1]
    *head, (comb, last) = steps
    prev = _chain(head, d)
    if comb == ">":
        return lambda n: last(n) & n["parent_id"].isNotNull() & F.coalesce(prev(d[n["parent_id"]]), F.lit(False))
    return lambda n: last(n) & has_ancestor(d, n, prev)


def _below(flags: Column, d: Column) -> Column:
    """For each node whether a proper ancestor is flagged.

    Each round looks twice as far up: what a node knows of the ancestors up
    to some node, and that node's own knowledge.  A page takes as many rounds
    as its depth has binary digits, and each is one pass over its nodes."""
    start = F.struct(F.transform(d, lambda n: F.coalesce(flags[n["parent_id"]], F.lit(False))).alias("hit"), F.transform(d, lambda n: n["parent_id"]).alias("up"))

    def farther(s, _i):
        return F.struct(F.transform(s["hit"], lambda h, i: h | F.coalesce(s["hit"][s["up"][i]], F.lit(False))).alias("hit"),
                        F.transform(s["up"], lambda u: s["up"][u]).alias("up"))
    rounds = F.length(F.bin(F.greatest(F.coalesce(F.array_max(F.transform(d, lambda n: n["depth"])), F.lit(1)), F.lit(1)).cast("long")))
    return F.aggregate(F.sequence(F.lit(1), rounds), start, farther, lambda s: s["hit"])


def _step_flags(flags: Column, comb: str | None, pred: Pred, d: Column) -> Column:
    """Nodes that fit ``pred`` and have a flagged parent (``>``) or ancestor."""
    def under(above: Pred) -> Column:
        return F.transform(d, lambda n: F.coalesce(pred(n) & above(n), F.lit(False)))
    if comb == ">":
        return let(flags, lambda m: under(lambda n: m[n["parent_id"]]))
    return let(flags, lambda m: let(_below(m, d), lambda below: under(lambda n: below[n["node_id"]])))


def _chain_flags(steps: Steps, d: Column) -> Column:
    first = steps[0][1]
    flags = F.transform(d, lambda n: F.coalesce(first(n), F.lit(False)))
    for comb, pred in steps[1:]:
        flags = _step_flags(flags, comb, pred, d)
    return flags


def match_flags(dom, selector: str) -> Column:
    """D10 for all nodes of a page at once: ``array<boolean>`` by node id.

    The compounds of a selector are matched left to right, each over all
    nodes, so the steps grow with nodes times the digits of the depth, not with
    the ancestors of every node (nor their ancestors, for longer selectors)."""
    d = F.col(dom) if isinstance(dom, str) else dom
    flags = [_chain_flags(steps, d) for steps in _parse(selector)]
    out = flags[0]
    for more in flags[1:]:
        out = F.zip_with(out, more, lambda a, b: a | b)
    return out


def matches(dom, selector: str) -> Column:
    """Ids of the nodes matching ``selector``, in document order."""
    d = F.col(dom) if isinstance(dom, str) else dom
    if not has_combinator(selector):
        pred = compile_selector(selector, d)
        return F.transform(F.filter(d, pred), lambda n: n["node_id"])
    return let(match_flags(d, selector), lambda m: F.filter(F.transform(d, lambda n: F.when(m[n["node_id"]], n["node_id"])), lambda i: i.isNotNull()))


# --- Fixed values: framework / site detectors -------------------------------
FRAMEWORK_SELECTORS = {
    "react": '[data-reactroot], [data-reactid], [data-react], .ReactModal__Overlay',
    "vue": '[data-v-app], [data-vue], [v-], .v-application',
    "angular": '[ng-app], [ng-], [data-ng], .ng-scope',
    "svelte": '[data-svelte], [svelte-]',
    "nextjs": '[data-nextjs]',
    "gatsby": '[data-gatsby]',
}
SHOPIFY_MARKER = '[data-shopify]'
LEGO_HOST = "lego.com"
SHOPIFY_HOST = "shopify.com"
# ---------------------------------------------------------------------------


def detect_site_type(dom="dom", url="url") -> Column:
    """Framework flags and site flags of one page."""
    d = F.col(dom) if isinstance(dom, str) else dom
    fields = [F.exists(d, compile_selector(s, d)).alias(k) for k, s in FRAMEWORK_SELECTORS.items()]
    fields.append(host_contains(url, LEGO_HOST).alias("lego"))
    fields.append((host_contains(url, SHOPIFY_HOST)
                   | F.exists(d, compile_selector(SHOPIFY_MARKER, d))).alias("shopify"))
    return F.struct(*fields)
