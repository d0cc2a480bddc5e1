"""Queries on pages composed from ``pages``: nested, shared and looping menus,
framework marks, pages without navigation, and links that hit known pages.
Each composed page is a function of one page's id and URL; what its operators
must give is stated in SQL from the shapes below."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegrove.functions.text import cached_expr
from pagegrove.functions.urls import url_host
from pagegrove.operators import menus as M
from pagegrove.operators import site as R
from pagegrove.operators.dom import with_dom
from pagegrove.operators.nav import NO_NAV_MESSAGE, llms_document, nav_page_columns, nav_tree
from pagegrove.operators.selectors import detect_site_type
from pagegrove.operators.siteinfo import page_description, page_title
from pagegrove.plans import sqlfrag as S
from pagegrove.plans.catalog import ROOT_SELECTOR, SQL_PAGE_FACTS, pages, pages_dom, query
from pagegrove.plans.sqlfrag import NL, q

HEAD = '<html><head><title>Page {i}</title><meta name="description" content="About {i}"></head>'
TAIL = "<main><h1>Page {i}</h1><p>Text {i}</p></main></body></html>"
FALLBACK = '<body {mark}><nav><ul><li><a href="{u}">Page {i}</a><div {menu}><ul><li><a href="/sub/{i}">Sub {i}</a></li></ul></div></li></ul></nav>'
#: The shapes, by page_id modulo their number; the last one is a chain of links, each in the menu of the one before.
SHAPES = [
    "<body>",
    '<body><nav><ul><li><a href="{u}">Page {i}</a><ul><li><a href="/sub/{i}" aria-label="Sub {i}">x</a></li></ul></li><li><a href="/only/{i}" title="Only {i}"><img></a></li></ul></nav>',
    '<body><nav><ul><li><a href="{u}">Page {i}</a><ul><a href="/loop/{i}">Loop {i}</a></ul></li></ul></nav>',
    FALLBACK.replace("{mark}", "data-reactroot").replace("{menu}", 'role="menu"'),
    FALLBACK.replace("{mark}", "data-v-app").replace("{menu}", 'class="submenu"'),
    FALLBACK.replace("{mark}", "data-shopify").replace("{menu}", 'class="dropdown-menu"'),
    "<body><nav><ul>{chain}</ul></nav>",
]
N_SHAPES = len(SHAPES)
CHAIN_LINK = '<li><a href="/c/{i}/{j}">Chain {j}</a><ul>'
#: Links in a chain: 1 to 8.
LENGTH = f"(1 + (page_id div {N_SHAPES}) % 8)"
LENGTH_SQL = LENGTH.replace(" div ", " // ")


def composed_pages(pages_df: DataFrame) -> DataFrame:
    """``(page_id, url, html)``: a composed page for every page."""
    i = F.col("page_id").cast("string")
    link = F.replace(F.lit(CHAIN_LINK), F.lit("{i}"), i)
    chain = F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), F.expr(LENGTH)), lambda j: F.replace(link, F.lit("{j}"), j.cast("string"))), "")
    body = F.element_at(F.array(*[F.lit(HEAD + s + TAIL) for s in SHAPES]), (F.col("page_id") % N_SHAPES + 1).cast("int"))
    url = F.replace(F.col("url"), F.lit("&"), F.lit("&amp;"))
    for name, value in (("{i}", i), ("{u}", url), ("{chain}", chain)):
        body = F.replace(body, F.lit(name), value)
    return pages_df.select("page_id", "url", body.alias("html"))


def composed_dom(spark, sf) -> DataFrame:
    from pagegrove.sources.pages import spread
    return with_dom(composed_pages(spread(pages(spark, sf).select("page_id", "url"))))


def composed_nav(spark, sf, mode="compat") -> DataFrame:
    return nav_tree(composed_dom(spark, sf), ROOT_SELECTOR, None, mode)


# What the shapes hold.  Kept rows of shapes 1 and 3 to 5, and of a chain: its
# rows are the increasing sequences of its links, in lexicographic order.
SQL_COMPOSED = f"""
cp AS (SELECT page_id, url, page_id % {N_SHAPES} AS v, page_id::VARCHAR AS i, {S.host('url')} AS site, {S.scheme_host('url')} AS base, {LENGTH_SQL} AS k FROM pages),
shape(v, pos, depth, title, path) AS (VALUES
  (1, 0, 0, 'Page ', NULL), (1, 1, 1, 'Sub ', '/sub/'), (1, 2, 0, 'Sub ', '/sub/'), (1, 3, 0, 'Only ', '/only/'),
  (3, 0, 0, 'Page ', NULL), (3, 1, 1, 'Sub ', '/sub/'), (3, 2, 0, 'Sub ', '/sub/'),
  (4, 0, 0, 'Page ', NULL), (4, 1, 1, 'Sub ', '/sub/'), (4, 2, 0, 'Sub ', '/sub/'),
  (5, 0, 0, 'Page ', NULL), (5, 1, 1, 'Sub ', '/sub/'), (5, 2, 0, 'Sub ', '/sub/')),
seqs AS (SELECT list_filter(range(1, 9), lambda j: ((m >> (8 - j)::INT) & 1) = 1) AS s FROM range(1, 256) t(m)),
chains AS (
  SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY s) - 1 AS pos, len(s) - 1 AS depth, s[-1] AS j
  FROM cp JOIN seqs ON s[-1] <= k WHERE v = {N_SHAPES - 1}),
cn AS (
  SELECT site, page_id, pos::BIGINT AS pos, depth::INT AS depth, title || i AS title, coalesce(base || path || i, url) AS url FROM cp JOIN shape USING (v)
  UNION ALL SELECT site, page_id, pos, depth::INT, 'Chain ' || j, base || '/c/' || i || '/' || j FROM chains JOIN cp USING (page_id)),
cs AS (
  SELECT site, url, arg_min(title, (page_id, pos)) AS title, min(page_id) AS first_page_id, count(DISTINCT page_id) AS n_pages FROM cn GROUP BY site, url),
known AS (SELECT url, min(page_id) AS page_id FROM pages GROUP BY url)"""


@query("composed_tree_rows", f"WITH {SQL_COMPOSED} SELECT page_id, pos, depth, title, url, repeat('  ', depth) || '- [' || title || '](' || url || ')' AS line FROM cn")
def q_composed_tree_rows(spark, sf):
    """Rows of shared and chained menus from the generator."""
    return M.menu_rows(M.menu_graphs(composed_dom(spark, sf), ROOT_SELECTOR)).drop("path")


@query("composed_nav_filtered", f"WITH {SQL_COMPOSED} SELECT page_id, pos::INT AS pos, depth, title, url FROM cn")
def q_composed_nav_filtered(spark, sf):
    """The same rows by the page-local expansion."""
    return R.nav_links(composed_nav(spark, sf)).select("page_id", "pos", "depth", "title", "url")


@query("nav_menu_rows", SQL_PAGE_FACTS + """
SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS pos, 0 AS depth, title_s AS title, link_url AS url,
       '- [' || title_s || '](' || link_url || ')' AS line FROM navf""")
def q_nav_menu_rows(spark, sf):
    """The crawled pages' trees from the generator."""
    return M.menu_rows(M.menu_graphs(pages_dom(spark, sf), ROOT_SELECTOR)).drop("path")


@query("nav_row_counts", f"""
WITH {SQL_COMPOSED}
SELECT page_id, CASE v WHEN 0 THEN 0 WHEN 1 THEN 3 WHEN {N_SHAPES - 1} THEN k ELSE 2 END::INT AS n_links,
       CASE v WHEN 0 THEN 0 WHEN {N_SHAPES - 1} THEN 1 + k ELSE 2 END::INT AS n_menus,
       CASE v WHEN 0 THEN '0' WHEN 1 THEN '4' WHEN 2 THEN NULL WHEN {N_SHAPES - 1} THEN ((1 << k::INT) - 1)::VARCHAR ELSE '3' END AS n_rows
FROM cp""")
def q_nav_row_counts(spark, sf):
    """Rows of each composed page's whole tree, counted on its graph."""
    return M.row_counts(M.menu_graphs(composed_dom(spark, sf), ROOT_SELECTOR))


@query("nav_cycles", f"WITH {SQL_COMPOSED} SELECT page_id, 12 AS menu, 13 AS opener, 'Loop ' || i AS title, base || '/loop/' || i AS url, [12] AS way FROM cp WHERE v = 2")
def q_nav_cycles(spark, sf):
    """The menu, opener and way of each page whose menus loop."""
    return M.nav_cycles(M.menu_graphs(composed_dom(spark, sf), ROOT_SELECTOR))


@query("nav_submenus", f"""
WITH {SQL_COMPOSED}, s(v, link, item, submenu, via) AS (VALUES
  (1, 10, 9, 12, 'ul'), (1, 14, 13, NULL, NULL), (1, 17, 16, NULL, NULL), (2, 10, 9, 12, 'ul'), (2, 13, 9, 12, 'ul'),
  (3, 10, 9, 12, 'react'), (3, 15, 14, NULL, NULL), (4, 10, 9, 12, 'vue'), (4, 15, 14, NULL, NULL), (5, 10, 9, 12, 'shopify'), (5, 15, 14, NULL, NULL))
SELECT page_id, link, item, submenu, via FROM cp JOIN s USING (v)
UNION ALL SELECT page_id, 4 * j + 6, 4 * j + 5, 4 * j + 8, 'ul' FROM (SELECT *, unnest(range(1, k + 1))::INT AS j FROM cp WHERE v = {N_SHAPES - 1})""")
def q_nav_submenus(spark, sf):
    """Nearest item and submenu of every link, by joins of nodes."""
    return M.nav_submenus(composed_dom(spark, sf))


SQL_ALL_LINKS = f"""
al AS (
  SELECT page_id, pos, title, link_url AS url FROM navr
  UNION ALL
  SELECT -1 - page_id, row_number() OVER (PARTITION BY page_id ORDER BY o) - 1, title || i, coalesce(base || path || i, url) FROM cp JOIN (VALUES
    (1, 1, 'Page ', NULL), (1, 2, 'Sub ', '/sub/'), (1, 3, 'Only ', '/only/'), (2, 1, 'Page ', NULL), (2, 2, 'Loop ', '/loop/'),
    (3, 1, 'Page ', NULL), (3, 2, 'Sub ', '/sub/'), (4, 1, 'Page ', NULL), (4, 2, 'Sub ', '/sub/'), (5, 1, 'Page ', NULL), (5, 2, 'Sub ', '/sub/')) s(v, o, title, path) USING (v)
  UNION ALL SELECT -1 - page_id, j - 1, 'Chain ' || j, base || '/c/' || i || '/' || j FROM (SELECT *, unnest(range(1, k + 1)) AS j FROM cp WHERE v = {N_SHAPES - 1}))"""


def _all_links(spark, sf) -> DataFrame:
    """The links of crawled pages, and of composed ones under ids below 0."""
    own = composed_dom(spark, sf).withColumn("page_id", -1 - F.col("page_id"))
    both = pages_dom(spark, sf).select("page_id", "url", "dom").unionByName(own.select("page_id", "url", "dom"))
    cols = nav_page_columns(both, ROOT_SELECTOR)
    return cols.select("page_id", F.posexplode_outer("links").alias("pos", "l")).where("l is not null")


@query("nav_titles", SQL_PAGE_FACTS + f", {SQL_COMPOSED}, {SQL_ALL_LINKS} SELECT page_id, pos::INT AS pos, title FROM al")
def q_nav_titles(spark, sf):
    """The title of every link, from its text or attributes."""
    return _all_links(spark, sf).select("page_id", "pos", F.col("l.title").alias("title"))


@query("nav_urls", SQL_PAGE_FACTS + f", {SQL_COMPOSED}, {SQL_ALL_LINKS} SELECT page_id, pos::INT AS pos, url FROM al")
def q_nav_urls(spark, sf):
    """The resolved URL of every link."""
    return _all_links(spark, sf).select("page_id", "pos", F.col("l.url").alias("url"))


# ---------------------------------------------------------------------------
# R4, R5, R7, R10, N9, D11 where both outcomes occur
# ---------------------------------------------------------------------------

def composed_facts(spark, sf) -> tuple[DataFrame, DataFrame]:
    """The links of composed pages, and what is known of the pages, from one parse."""
    facts = R.page_facts(composed_nav(spark, sf))
    return R.site_nav(R.nav_links(facts)), facts


@query("composed_annotated_links", f"""
WITH {SQL_COMPOSED}
SELECT site, cs.url, '- [' || title || '](' || cs.url || ')' || coalesce(' - About ' || known.page_id, '') AS line FROM cs LEFT JOIN known ON known.url = cs.url""")
def q_composed_annotated_links(spark, sf):
    """Links to known pages carry their descriptions."""
    return R.annotate_links(*composed_facts(spark, sf))


@query("composed_depth_limited", f"WITH {SQL_COMPOSED} SELECT site, page_id, pos::INT AS pos, depth, title, url FROM cn WHERE depth <= 1")
def q_composed_depth_limited(spark, sf):
    """Rows of nested menus down to the second level."""
    return R.limit_depth(R.nav_links(composed_nav(spark, sf)), 1)


@query("composed_link_details", f"""
WITH {SQL_COMPOSED}
SELECT site, cs.url, title, CASE WHEN known.url IS NOT NULL THEN {q(R.DETAIL_PREFIX + '[')} || {S.sanitize_filename('cs.url')} || '](' || cs.url || ')' END AS detail
FROM cs LEFT JOIN known ON known.url = cs.url""")
def q_composed_link_details(spark, sf):
    """Links to known pages point to their files."""
    return R.link_details(*composed_facts(spark, sf))


@query("composed_link_metadata", f"""
WITH {SQL_COMPOSED}
SELECT site, cs.url, title, length('# Untitled Page' || {NL} || {NL} || '## Page ' || known.page_id || {NL} || {NL} || 'Text ' || known.page_id || {NL}) AS md_chars
FROM cs LEFT JOIN known ON known.url = cs.url""")
def q_composed_link_metadata(spark, sf):
    """The Markdown size of known pages."""
    return R.link_metadata(*composed_facts(spark, sf))


@query("composed_llms_txt", f"""
WITH {SQL_COMPOSED}, lines AS (SELECT page_id, string_agg(repeat('  ', depth) || '- [' || title || '](' || url || ')' || {NL}, '' ORDER BY pos) AS md FROM cn GROUP BY page_id)
SELECT page_id, CASE v WHEN 0 THEN 'no_nav' WHEN 2 THEN 'cyclic_nav' ELSE 'ok' END AS status,
       CASE WHEN v IN (0, 2) THEN {q(NO_NAV_MESSAGE)}
            ELSE '# Page ' || i || {NL} || {NL} || '> About ' || i || {NL} || {NL} || '## Navigation' || {NL} || {NL} || md END AS content
FROM cp LEFT JOIN lines USING (page_id)""")
def q_composed_llms_txt(spark, sf):
    """Documents of pages with, without and with endless navigation."""
    doc = cached_expr(("llms_document",), lambda: llms_document(page_title("dom"), page_description("dom"), F.col("nav_md"), F.col("status")))
    return composed_nav(spark, sf).select("page_id", "status", doc.alias("content"))


@query("composed_type_flags", f"WITH {SQL_COMPOSED} SELECT page_id, v = 3 AS react, v = 4 AS vue, v = 5 AS shopify, false AS angular, site FROM cp")
def q_composed_type_flags(spark, sf):
    """Marks of frameworks and sites."""
    f = detect_site_type("dom", "url")
    return composed_dom(spark, sf).select("page_id", *[f[c].alias(c) for c in ("react", "vue", "shopify", "angular")], url_host(F.col("url")).alias("site"))
