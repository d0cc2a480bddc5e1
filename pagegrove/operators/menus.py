"""Menus of a page as a graph, and as relations.

``nav.py`` expands the whole tree of a page into one array.  With menus that
share submenus the tree has up to 2^n - 1 rows for n links, so here the page is
kept as what it is, a graph of menus: a menu holds the links inside it, a link
opens its submenu.

* ``menu_graphs``   that graph, a few numbers per link, made by Columns;
* ``menu_rows``     the rows of the tree in order, emitted by a generator that
                    walks the graph: memory grows with menus, not with rows;
* ``row_counts``    how many rows a tree has, summed up once per menu;
* ``nav_cycles``    for each page whose tree never ends, the menu that opens
                    itself again, the link that does so, and the way there;
* ``nav_submenus``  the submenu of each link by joins of exploded nodes.

A page's graph is bounded by the page.  Null or empty pages have no links and
no rows; a page whose menus loop has no rows in ``compat`` mode.
"""

from __future__ import annotations

import sys
from bisect import bisect_right

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagegrove.functions.text import cached_expr, sanitize_text
from pagegrove.functions.urls import py_urljoin_abs
from pagegrove.operators.nav import DEFAULT_CONTEXT_SELECTOR, SUBMENU_FALLBACKS, line_of, nav_page_columns, row_fits
from pagegrove.operators.selectors import compile_selector, detect_site_type

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Rows of a tree, and pages read, that a task holds at a time.
BATCH_ROWS, SLICE_PAGES = 4096, 16
ROWS = "page_id long, pos long, path array<int>, depth int, title string, url string, own string"


# ---- the graph -------------------------------------------------------------

def _graph_exprs() -> dict:
    def link(l):  # noqa: E741
        # a row's own conditions do not depend on where in the tree it is
        row = F.struct(l["url"].alias("url"), sanitize_text(l["title"]).alias("title_s"), l["sub"].alias("sub"), l["nkids"].alias("nkids"),
                       py_urljoin_abs(F.col("url"), l["url"]).alias("full"))
        return F.struct(l["id"].alias("id"), l["sub"].alias("sub"), l["menu_of"].alias("menu_of"), l["title"].alias("title"), l["url"].alias("url"),
                        row["title_s"].alias("title_s"), row["full"].alias("full"), row_fits(row).alias("fits"))
    subs = F.filter(F.transform("links", lambda l: l["sub"]), lambda s: s.isNotNull())
    menus = F.transform(F.array_sort(F.array_distinct(F.concat(F.col("roots"), subs))), lambda m: F.struct(m.alias("id"), F.col("dom")[m]["end_id"].alias("end")))
    return {"menus": menus, "links": F.transform("links", link)}


def menu_graphs(pages_dom: DataFrame, root_selector: str, context_selector: str | None = None, mode: str = "compat") -> DataFrame:
    """``(page_id, url, roots, menus, links)`` per page: the ids of the root
    menus, ``(id, end)`` of all menus (the last node inside), and the links
    in document order with the submenu that each opens."""
    cols = nav_page_columns(pages_dom, root_selector, context_selector, mode)
    e = cached_expr(("menu_graph",), _graph_exprs)
    empty = lambda c: F.coalesce(c, F.array().cast(cols.schema["roots"].dataType))
    return cols.select("page_id", "url", empty(F.col("roots")).alias("roots"), e["menus"].alias("menus"), e["links"].alias("links"))


def _members(menus: list[dict], links: list[dict], mode: str) -> dict[int, range | list[int]]:
    """The places of each menu's links: all inside it, or in ``tree`` mode those with no menu between."""
    ids = [x["id"] for x in links]
    if mode == "compat":
        return {m["id"]: range(bisect_right(ids, m["id"]), bisect_right(ids, m["end"])) for m in menus}
    own: dict[int, list[int]] = {m["id"]: [] for m in menus}
    for i, x in enumerate(links):
        if x["menu_of"] in own:
            own[x["menu_of"]].append(i)
    return own


def find_cycle(roots, members, subs) -> tuple[int, int, list[int]] | None:
    """``(menu, opener, way)`` of the first loop met: a link of the last menu
    on the way opens the first one again.  Each menu is entered once, so the
    search takes steps in proportion to menus and their links."""
    done: set[int] = set()
    for root in roots:
        way, at, on_way = [root], [iter(members[root])], {root: 0}
        if root in done:
            continue
        while way:
            for i in at[-1]:
                sub = subs[i]
                if sub is None or sub in done:
                    continue
                if sub in on_way:
                    return sub, i, way[on_way[sub]:]
                on_way[sub] = len(way)
                way.append(sub)
                at.append(iter(members[sub]))
                break
            else:
                done.add(way[-1])
                del on_way[way.pop()]
                at.pop()
    return None


def tree_size(roots, members, subs) -> int:
    """The number of rows of the whole tree, each menu counted once; the graph must not loop."""
    size: dict[int, int] = {}
    for root in roots:
        todo = [root]
        while todo:
            m = todo[-1]
            below = [subs[i] for i in members[m] if subs[i] is not None]
            open_ = [s for s in below if s not in size]
            if m in size or not open_:
                size.setdefault(m, len(members[m]) + sum(size[s] for s in below))
                todo.pop()
            else:
                todo += dict.fromkeys(open_)
    return sum(size[r] for r in roots)


def walk(roots, members, subs, enter):
    """Yields ``(path, depth, link)`` in the tree's order.  ``enter(depth, link)``
    says whether a row stays; a row that goes takes its subtree with it.  A
    menu is not opened again inside itself."""
    for root in roots:
        way, at, path = [root], [iter(members[root])], [root]
        while at:
            i = next(at[-1], None)
            if i is None:
                at.pop()
                way.pop()
                path.pop()
                continue
            if not enter(len(at) - 1, i):
                continue
            yield path, len(at) - 1, i
            sub = subs[i]
            if sub is not None and sub not in way:
                way.append(sub)
                at.append(iter(members[sub]))
                path.append(i)


def _graphs(batches):
    for b in batches:
        for at in range(0, b.num_rows, SLICE_PAGES):  # a whole batch as Python objects would not fit a worker
            for r in b.slice(at, SLICE_PAGES).to_pylist():
                yield r["page_id"], r["roots"] or [], r["menus"] or [], r["links"] or []


def _rows(mode: str, kept: bool):
    names = [c.split()[0] for c in ROWS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.string(), pa.string(), pa.string()]
    title, url = ("title_s", "full") if kept else ("title", "url")

    def batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def run(batches):
        out = []
        for page, roots, menus, links in _graphs(batches):
            members, subs = _members(menus, links, mode), [x["sub"] for x in links]
            if mode == "compat" and find_cycle(roots, members, subs):
                continue
            seen: set[str] = set()

            def enter(depth, i):
                x = links[i]  # noqa: B023
                if depth == 0 and x["url"]:  # N7: the first top row of a URL stands for all
                    if x["url"] in seen:  # noqa: B023
                        return False
                    seen.add(x["url"])  # noqa: B023
                return x["fits"]
            for pos, (path, depth, i) in enumerate(walk(roots, members, subs, enter if kept else lambda _d, _i: True)):
                x = links[i]
                out.append((page, pos, [path[0], *(links[k]["id"] for k in path[1:]), x["id"]], depth, x[title], x[url], x["url"]))
                if len(out) >= BATCH_ROWS:
                    yield batch(out)
                    out = []
        if out:
            yield batch(out)
    return run


def menu_rows(graphs: DataFrame, mode: str = "compat", kept: bool = True) -> DataFrame:
    """N6 (+ N7, T1-T5): ``(page_id, pos, path, depth, title, url, line)``,
    a row for each row of the tree in its order; ``kept`` false gives the
    whole expansion with the links' own titles and URLs.  At most ``BATCH_ROWS``
    rows are held at a time."""
    rows = graphs.select("page_id", "roots", "menus", "links").mapInArrow(_rows(mode, kept), ROWS)
    return rows.select("page_id", "pos", "path", "depth", "title", "url", line_of(F.col("depth"), F.col("title"), F.col("own"), F.col("url")).alias("line"))


def _counts(mode: str):
    def run(batches):
        rows = []
        for page, roots, menus, links in _graphs(batches):
            members, subs = _members(menus, links, mode), [x["sub"] for x in links]
            rows.append((page, len(links), len(menus), None if find_cycle(roots, members, subs) else str(tree_size(roots, members, subs))))
        if rows:
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "n_links", "n_menus", "n_rows"])
    return run


def row_counts(graphs: DataFrame, mode: str = "compat") -> DataFrame:
    """``(page_id, n_links, n_menus, n_rows)``; the exact number of rows of
    the whole tree as digits (it may have more of them than a long), null where
    it never ends."""
    return graphs.select("page_id", "roots", "menus", "links").mapInArrow(_counts(mode), "page_id long, n_links int, n_menus int, n_rows string")


def _cycles(batches):
    rows = []
    for page, roots, menus, links in _graphs(batches):
        found = find_cycle(roots, _members(menus, links, "compat"), [x["sub"] for x in links])
        if found:
            menu, i, way = found
            rows.append((page, menu, links[i]["id"], links[i]["title"], links[i]["url"], way))
    if rows:
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.list_(pa.int32())]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                         ["page_id", "menu", "opener", "title", "url", "way"])


def nav_cycles(graphs: DataFrame) -> DataFrame:
    """``(page_id, menu, opener, title, url, way)`` for each page whose
    navigation never ends: the link ``opener`` opens ``menu`` again, ``way`` lists
    the menus from it to the one that holds the link."""
    return graphs.select("page_id", "roots", "menus", "links").mapInArrow(_cycles, "page_id long, menu int, opener int, title string, url string, way array<int>")


# ---- submenus as relations -------------------------------------------------

def nav_submenus(pages_dom: DataFrame, context_selector: str | None = None) -> DataFrame:
    """``(page_id, link, item, submenu, via)`` for every clickable node:
    its nearest ``li``, that one's first child ``ul`` or else the first node inside
    that the page's framework marks as a menu, and which of these it was.

    Joins of exploded nodes, without the page-local form of ``nav.py``.  The
    last ``li`` opened before a link is its nearest one unless it is closed
    already; only links behind a closed one are matched by intervals.
    """
    flags = detect_site_type("dom", "url")
    marked = [(name, selector) for name, selector in SUBMENU_FALLBACKS]
    tests: list[Column] = [F.col("n.tag").isin("li", "ul")]
    clickable = compile_selector(context_selector or DEFAULT_CONTEXT_SELECTOR, "dom")
    nodes = pages_dom.select("page_id", flags.alias("flags"), F.explode_outer(F.transform("dom", lambda n: F.struct(
        n["node_id"].alias("id"), n["end_id"].alias("end"), n["parent_id"].alias("parent"), n["tag"].alias("tag"), clickable(n).alias("is_link"),
        F.struct(*[compile_selector(s, "dom")(n).alias(name) for name, s in marked]).alias("menu")))).alias("n"))
    for name, _ in marked:
        tests.append(F.col(f"n.menu.{name}") & F.col(f"flags.{name}"))
    keep = F.col("n.is_link")
    for t in tests:
        keep = keep | t
    flagged = F.coalesce(*[F.when(F.col(f"flags.{name}"), F.lit(name)) for name, _ in marked])
    # of the fallbacks only that of the first framework counts
    marks = F.coalesce(*[F.when(F.col(f"flags.{name}"), F.col(f"n.menu.{name}")) for name, _ in marked])
    nodes = nodes.where("n is not null").where(keep).select(
        "page_id", F.col("n.id").alias("id"), F.col("n.end").alias("end"), F.col("n.parent").alias("parent"), F.col("n.tag").alias("tag"), F.col("n.is_link").alias("is_link"),
        flagged.alias("framework"), F.coalesce(marks, F.lit(False)).alias("is_menu"))

    w = Window.partitionBy("page_id").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opened = F.last(F.when(F.col("tag") == "li", F.struct("id", "end")), ignorenulls=True).over(w)
    links = nodes.withColumn("li", opened).where("is_link").select("page_id", F.col("id").alias("link"), "framework", "li")
    inside = F.col("li.end") >= F.col("link")
    direct = links.where(F.coalesce(inside, F.lit(True))).select("page_id", "link", "framework", F.col("li.id").alias("item"), F.col("li.end").alias("item_end"))
    items = nodes.where("tag = 'li'").select(F.col("page_id").alias("item_page"), F.col("id").alias("item"), F.col("end").alias("item_end"))
    late = links.where(~inside).select("page_id", "link", "framework")
    around = late.join(items, F.expr("page_id = item_page and item < link and item_end >= link"), "left")
    around = around.groupBy("page_id", "link", "framework").agg(F.max(F.struct("item", "item_end")).alias("li")).select("page_id", "link", "framework", "li.item", "li.item_end")
    placed = direct.union(around)

    lists = nodes.where("tag = 'ul'").groupBy("page_id", F.col("parent").alias("item")).agg(F.min("id").alias("child"))
    placed = placed.join(lists, ["page_id", "item"], "left")
    menus = nodes.where("is_menu").select(F.col("page_id").alias("menu_page"), F.col("id").alias("menu"))
    open_items = placed.where("child is null and item is not null and framework is not null").select("page_id", "item", "item_end").distinct()
    first = open_items.join(menus, F.expr("page_id = menu_page and menu > item and menu <= item_end"))
    first = first.groupBy("page_id", "item").agg(F.min("menu").alias("menu"))
    out = placed.join(first, ["page_id", "item"], "left")
    fallback = F.when(F.col("child").isNull(), F.col("menu"))
    return out.select("page_id", "link", "item", F.coalesce("child", fallback).alias("submenu"),
                      F.when(F.col("child").isNotNull(), "ul").when(fallback.isNotNull(), F.col("framework")).alias("via"))
