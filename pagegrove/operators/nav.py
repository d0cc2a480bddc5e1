"""Navigation tree -> ``llms.txt``.

All of it is page-local work on the ``dom`` array (higher-order functions,
no shuffle, no Python): a page's navigation depends on that page only, so a
corpus of any size is processed with one narrow stage.

Representation: the recursive ``{title, url, children}`` tree is flattened
into rows whose ``path`` is ``[root_id, link_id, child_link_id, ...]``.
Lexicographic order of ``path`` is the pre-order the renderer walks
(roots and links are both in document order).

``compat`` mode expands a submenu into *all* links inside it at every
level, as the extractor it mirrors does (a chain of n nested links yields
2**n - 1 rows); ``tree`` mode keeps each link once, under the menu that
directly contains it.  A submenu that contains its own opener (a link
directly inside the ``ul`` without its own ``li``) would recurse forever
in the original; such pages get ``status = 'cyclic_nav'`` and no lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrove.functions.text import cached_expr, js_trim, let, sanitize_text
from pagegrove.functions.urls import py_urljoin_abs, resolve_href, url_parts
from pagegrove.operators.dom import first_node, subtree_ids
from pagegrove.operators.selectors import compile_selector, detect_site_type, has_combinator, match_flags

# --- Fixed values -----------------------------------------------------------
GENERIC_ROOT_SELECTORS = [
    'nav', 'header nav', '[role="navigation"]', '[data-test*="nav"]',
    '[data-testid*="nav"]', '[aria-label*="navigation"]', '[class*="nav"]', '[id*="nav"]',
]
LEGO_ROOT_SELECTOR = '[data-test="desktop-navigation"]'
SHOPIFY_ROOT_SELECTOR = '[data-sectiontype="header"]'
DEFAULT_CONTEXT_SELECTOR = 'a[href]'
# submenu fallbacks when the li has no child ul, tried in this order
SUBMENU_FALLBACKS = [
    ("react", '[role="menu"], [aria-labelledby]'),
    ("vue", '.submenu, .v-menu__content'),
    ("lego", '[data-test="meganav-content"]'),
    ("shopify", '.dropdown-menu, .meganav'),
]
TITLE_ATTRS_BEFORE_TEXT = ["aria-label"]
TITLE_ATTRS_AFTER_TEXT = ["data-testid", "data-test", "title"]
UNTITLED_LINK = "Untitled Link"
STOP_TITLES = ["more", "menu", "click here", "home", "new"]
MIN_TITLE_LENGTH = 2
MAX_PATH_LENGTH = 100
BANNED_IN_PATH = ["#", "?", "javascript"]
NO_NAV_MESSAGE = "No navigation structure found. Try different selectors."
MISSING_PARAMS_MESSAGE = "Error: Provide homepage URL and root navigation selector"
# ---------------------------------------------------------------------------


def _nonblank(c: Column) -> Column:
    return F.when(c != "", c)


def check_params(homepage_url: str | None, root_selector: str | None) -> None:
    """Both parameters are required.  A table's homepages are rows: one
    without a URL gets the status ``missing_params`` instead."""
    if not homepage_url or not root_selector:
        raise ValueError(MISSING_PARAMS_MESSAGE)


def nav_page_columns(pages_dom: DataFrame, root_selector: str,
                     context_selector: str | None = None, mode: str = "compat") -> DataFrame:
    """Adds ``flags``, ``roots`` and ``links`` (N1-N5) to each page.

    ``links``: struct(id, title, url, sub, nkids) per clickable element in
    document order; ``sub`` is the submenu node id (or null), ``nkids`` the
    number of links the submenu expands to.
    """
    if mode not in ("compat", "tree"):
        raise ValueError("mode must be 'compat' or 'tree'")
    if not root_selector:
        raise ValueError(MISSING_PARAMS_MESSAGE)
    e = cached_expr(("nav_columns", root_selector, context_selector, mode),
                    lambda: _nav_column_exprs(root_selector, context_selector, mode))
    own = [e[c].alias(c) for c in ("root_flags", "context_flags") if c in e]
    stage1 = pages_dom.select("*", e["flags"].alias("flags"), e["base_url"].alias("base_url"), *own)
    stage2 = stage1.select("*", e["roots"].alias("roots"), e["links0"].alias("links0"))
    stage3 = stage2.select("*", e["links1"].alias("links1"), e["n_menus"].alias("n_menus"))
    return stage3.select(*[c for c in stage3.columns if c not in ("links0", "links1", "root_flags", "context_flags")],
                         e["links"].alias("links"))


def _nav_column_exprs(root_selector: str, context_selector: str | None, mode: str) -> dict:
    d = F.col("dom")
    ctx = context_selector if context_selector and context_selector.strip() else DEFAULT_CONTEXT_SELECTOR

    out = {}

    def user_selector(selector, name):
        """A predicate on nodes; a selector with combinators is matched for the whole page in a stage of its own."""
        if not has_combinator(selector):
            return compile_selector(selector, d)
        out[name] = match_flags(d, selector)
        return lambda n: F.col(name)[n["node_id"]]

    flags = detect_site_type(d, "url")
    user_root = user_selector(root_selector, "root_flags")
    generic = compile_selector(", ".join(GENERIC_ROOT_SELECTORS), d)
    lego_root = compile_selector(LEGO_ROOT_SELECTOR, d)
    shopify_root = compile_selector(SHOPIFY_ROOT_SELECTOR, d)
    clickable = user_selector(ctx, "context_flags")

    base_el = first_node(d, lambda n: (n["tag"] == "base") & F.map_contains_key(n["attrs"], "href"))
    base = F.coalesce(resolve_href(F.col("url"), base_el["attrs"]["href"]), F.col("url"))

    out |= {"flags": flags, "base_url": base}
    fl = F.col("flags")

    def is_root(n):
        return (user_root(n) | generic(n) | (fl["lego"] & lego_root(n))
                | (fl["shopify"] & shopify_root(n)))

    def submenu(li_id):
        def body(li_id):
            inside = subtree_ids(li_id, d[li_id]["end_id"])
            child_ul = F.try_element_at(F.filter(inside, lambda m: (d[m]["parent_id"] == li_id) & (d[m]["tag"] == "ul")),
                                        F.lit(1))
            fallback = F.lit(None).cast("int")
            for flag, sel in reversed(SUBMENU_FALLBACKS):
                match = compile_selector(sel, d)
                hit = F.try_element_at(F.filter(inside, lambda m: match(d[m])), F.lit(1))
                fallback = F.when(fl[flag], hit).otherwise(fallback)
            return F.when(li_id.isNotNull(), F.coalesce(child_ul, fallback))
        return let(li_id, body)

    def link_struct(n):
        text = F.array_join(F.transform(
            F.filter(subtree_ids(n["node_id"], n["end_id"]), lambda m: d[m]["tag"].isin("#text", "#rawtext")),
            lambda m: d[m]["text"]), "")
        title_parts = ([_nonblank(n["attrs"][a]) for a in TITLE_ATTRS_BEFORE_TEXT]
                       + [_nonblank(js_trim(text))]
                       + [_nonblank(n["attrs"][a]) for a in TITLE_ATTRS_AFTER_TEXT]
                       + [F.lit(UNTITLED_LINK)])
        url = F.when(n["tag"] == "a",
                     F.coalesce(resolve_href(F.col("base_url"), n["attrs"]["href"]), F.lit(""))
                     ).otherwise(F.lit(""))
        return F.struct(n["node_id"].alias("id"), F.coalesce(*title_parts).alias("title"),
                        url.alias("url"), submenu(n["li_id"]).alias("sub"))

    out["roots"] = F.transform(F.filter(d, is_root), lambda n: n["node_id"])
    out["links0"] = F.transform(F.filter(d, clickable), link_struct)

    lk = F.col("links0")
    subs = F.array_distinct(F.filter(F.transform(lk, lambda l: l["sub"]), lambda x: x.isNotNull()))

    def menu_of(menus, l):
        # menus nest, so the nearest one around a link is the last that holds it
        return F.array_max(F.filter(menus, lambda m: (m < l["id"]) & (d[m]["end_id"] >= l["id"])))

    if mode == "tree":
        with_menu = let(F.array_union(F.col("roots"), subs),
                        lambda menus: F.transform(lk, lambda l: l.withField("menu_of", menu_of(menus, l))))
    else:
        with_menu = F.transform(lk, lambda l: l.withField("menu_of", F.lit(None).cast("int")))
    out["links1"] = with_menu
    # each level of the expansion opens a submenu that its path has not seen
    out["n_menus"] = F.size(subs)

    l1 = F.col("links1")

    def in_menu(l, m_id):
        inside = (l["id"] > m_id) & (l["id"] <= d[m_id]["end_id"])
        return inside & (l["menu_of"] == m_id) if mode == "tree" else inside

    links = F.transform(l1, lambda l: l.withField(
        "nkids", F.when(l["sub"].isNull(), F.lit(0)).otherwise(F.size(F.filter(l1, lambda k: in_menu(k, l["sub"]))))))
    out["links"] = links
    return out


def expand_nav(nav_pages: DataFrame, mode: str = "compat") -> DataFrame:
    """``rows`` = the expanded tree (unordered), ``cyclic`` flag."""
    e = cached_expr(("nav_expand", mode), lambda: _expand_exprs(mode))
    staged = nav_pages.select("*", e["rows"].alias("rows"))
    return staged.select("*", e["cyclic"].alias("cyclic"))


def _expand_exprs(mode: str) -> dict:
    d = F.col("dom")
    lk = F.col("links")

    def in_menu(l, m_id):
        inside = (l["id"] > m_id) & (l["id"] <= d[m_id]["end_id"])
        return inside & (l["menu_of"] == m_id) if mode == "tree" else inside

    def row(path, depth, l, menus):
        return F.struct(path.alias("path"), depth.alias("depth"), l["id"].alias("id"), l["sub"].alias("sub"),
                        l["title"].alias("title"), l["url"].alias("url"), l["nkids"].alias("nkids"),
                        menus.alias("menus"))

    level0 = F.flatten(F.transform(
        F.col("roots"),
        lambda r: F.transform(F.filter(lk, lambda l: in_menu(l, r)),
                              lambda l: row(F.array(r, l["id"]), F.lit(0), l, F.array(r)))))

    def opening(rows):
        return F.filter(rows, lambda f: f["sub"].isNotNull() & ~F.array_contains(f["menus"], f["sub"]))

    def grow(acc, i):
        nxt = F.flatten(F.transform(
            acc["front"],
            lambda f: F.transform(F.filter(lk, lambda l: in_menu(l, f["sub"])),
                                  lambda l: row(F.concat(f["path"], F.array(l["id"])), i, l,
                                                F.concat(f["menus"], F.array(f["sub"]))))))
        grown = let(nxt, lambda more: F.struct(F.concat(acc["rows"], more).alias("rows"), opening(more).alias("front")))
        return F.when(F.size(acc["front"]) == 0, acc).otherwise(grown)

    start = let(level0, lambda top: F.struct(top.alias("rows"), opening(top).alias("front")))
    rows = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("n_menus"), F.lit(1))), start, grow, lambda acc: acc["rows"])
    cyclic = F.exists(F.col("rows"), lambda f: f["sub"].isNotNull() & F.array_contains(f["menus"], f["sub"]))
    return {"rows": rows, "cyclic": cyclic if mode == "compat" else F.lit(False)}


def _is_dup(r: Column, before: Column) -> Column:
    """A top row whose URL an earlier top row has."""
    return (r["depth"] == 0) & (r["url"] != "") & F.coalesce(before["url"] == r["url"], F.lit(False))


def row_fits(r: Column) -> Column:
    """T1-T3 for one row, without its place in the tree; ``r.full`` is the
    urljoin'ed URL."""
    title = r["title_s"]
    has_url = r["url"] != ""
    has_children = r["sub"].isNotNull() & (r["nkids"] > 0)

    def url_ok(parts):
        low = F.lower(parts["path"])
        ok = (parts["netloc"] != "") & (F.length(parts["path"]) <= MAX_PATH_LENGTH)
        for s in BANNED_IN_PATH:
            ok = ok & ~low.contains(s)
        return ok
    return (has_url | has_children) & (F.length(title) >= MIN_TITLE_LENGTH) \
        & ~F.lower(title).isin(*STOP_TITLES) & (~has_url | let(url_parts(r["full"]), url_ok))


def _row_ok(r: Column, before: Column) -> Column:
    """T1-T3 and N7 for one row (subtree drop is applied by the walk);
    ``before`` is the row ahead of it when top rows come first and are
    sorted by URL and path."""
    return row_fits(r) & ~_is_dup(r, before)


def line_of(depth: Column, title: Column, url: Column, full: Column) -> Column:
    """T5: one row of the rendered tree, without its line break."""
    body = F.when(url != "", F.concat(F.lit("["), title, F.lit("]("), full, F.lit(")"))).otherwise(title)
    return F.concat(F.repeat(F.lit("  "), depth), F.lit("- "), body)


def _row_line(r: Column) -> Column:
    return F.concat(line_of(r["depth"], r["title"], r["url"], r["full"]), F.lit("\n"))


def render_nav(expanded: DataFrame) -> DataFrame:
    """N7 + T1-T5: walk the rows in pre-order, dropping failing nodes with
    their subtrees; ``kept`` holds the surviving rows (with their line),
    ``nav_md`` the rendered tree, ``status`` ok / no_nav / cyclic_nav."""
    e = cached_expr(("nav_render",), _render_exprs)
    stage = expanded.select("*", e["_prep"].alias("_prep"))
    stage = stage.select("*", e["marked"].alias("marked"))
    stage = stage.select("*", e["kept"].alias("kept"))
    return stage.select("*", e["nav_md"].alias("nav_md"), e["status"].alias("status"))


def _render_exprs() -> dict:
    rows = F.col("rows")
    page_url = F.col("url")
    prepared = F.array_sort(F.transform(rows, lambda r: F.struct(
        (r["depth"] > 0).alias("below"), r["url"].alias("url"), r["path"].alias("path"), r["depth"].alias("depth"),
        sanitize_text(r["title"]).alias("title_s"), r["sub"].alias("sub"), r["nkids"].alias("nkids"),
        py_urljoin_abs(page_url, r["url"]).alias("full"))))
    marked = F.array_sort(F.transform(F.col("_prep"), lambda r, i: F.struct(
        r["path"].alias("path"), r["depth"].alias("depth"), r["title_s"].alias("title"), r["url"].alias("url"),
        r["full"].alias("full"), _row_ok(r, F.get(F.col("_prep"), i - 1)).alias("ok"),
        _is_dup(r, F.get(F.col("_prep"), i - 1)).alias("dup"))))

    init = F.struct(F.array().cast("array<struct<path:array<int>,depth:int,title:string,url:string,full:string>>").alias("kept"),
                    F.lit(None).cast("int").alias("drop"))

    def walk(acc, r):
        keep = F.struct(r["path"].alias("path"), r["depth"].alias("depth"),
                        r["title"].alias("title"), r["url"].alias("url"), r["full"].alias("full"))
        return (F.when(acc["drop"].isNotNull() & (r["depth"] > acc["drop"]), acc)
                .when(r["ok"], F.struct(F.concat(acc["kept"], F.array(keep)).alias("kept"),
                                        F.lit(None).cast("int").alias("drop")))
                .otherwise(F.struct(acc["kept"].alias("kept"), r["depth"].alias("drop"))))

    kept = F.aggregate(F.col("marked"), init, walk)["kept"]
    kept = F.when(F.col("cyclic"), F.slice(kept, 1, 0)).otherwise(kept)
    lines = F.transform(F.col("kept"), _row_line)
    status = (F.when(F.coalesce(page_url, F.lit("")) == "", F.lit("missing_params"))
              .when(F.col("cyclic"), F.lit("cyclic_nav"))
              .when(F.size(F.col("rows")) == 0, F.lit("no_nav"))
              .otherwise(F.lit("ok")))
    return {"_prep": prepared,
            "marked": marked, "kept": kept,
            "nav_md": F.array_join(lines, ""), "status": status}


def nav_tree(pages_dom: DataFrame, root_selector: str, context_selector: str | None = None,
             mode: str = "compat") -> DataFrame:
    """N1-N8 + T1-T5 per page: adds ``rows``, ``kept``, ``nav_md``, ``status``."""
    cols = nav_page_columns(pages_dom, root_selector, context_selector, mode)
    return render_nav(expand_nav(cols, mode))


def llms_document(title: Column, description: Column, nav_md: Column, status: Column) -> Column:
    """T7 + N9: the ``llms.txt`` text, or the fixed message when the page has
    no navigation (or a self-referencing one) or no URL (T8)."""
    doc = F.concat(F.lit("# "), title, F.lit("\n\n> "), description,
                   F.lit("\n\n## Navigation\n\n"), nav_md)
    return F.when(status == "ok", doc).when(status == "missing_params", F.lit(MISSING_PARAMS_MESSAGE)).otherwise(F.lit(NO_NAV_MESSAGE))


def homepage_llms(pages: DataFrame, homepage_url: str, root_selector: str, context_selector: str | None = None) -> DataFrame:
    """``(page_id, url, content, status)`` of one homepage among
    crawled pages; both parameters must be given."""
    from pagegrove.operators.dom import with_dom
    from pagegrove.operators.siteinfo import page_description, page_title
    check_params(homepage_url, root_selector)
    tree = nav_tree(with_dom(pages.where(F.col("url") == homepage_url)), root_selector, context_selector)
    return tree.select("page_id", "url", llms_document(page_title("dom"), page_description("dom"), F.col("nav_md"), F.col("status")).alias("content"), "status")
