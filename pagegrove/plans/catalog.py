"""Registered queries: one Spark plan per operator of the inventory, each
next to the DuckDB SQL that states the same result independently.

Spark side: ``fn(spark, sf_dir) -> DataFrame`` over the driver tables.
SQL side: DuckDB over the same tables (views ``pages``, ``documents``...);
``None`` when the operator is not expressible in SQL (rows-only check).
SQL marked *fixture-shape* relies on the regular shape of the fixture HTML
(one title, ``nav > ul > li > a``, one ``article``); the Spark side never
does.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegrove.functions.text import cached_expr, sanitize_filename, sanitize_text
from pagegrove.functions.urls import URL_RE, resolve_href, url_host, url_parts
from pagegrove.operators import links as L
from pagegrove.operators.dom import has_ancestor, main_content, strip_boilerplate, with_dom
from pagegrove.operators.markdown import (NO_URLS, file_set, filename_collisions, list_previews, markdown_bundle,
                                          markdown_for_requests, page_markdown)
from pagegrove.operators.nav import NO_NAV_MESSAGE, STOP_TITLES, llms_document, nav_tree
from pagegrove.operators.selectors import detect_site_type, matches
from pagegrove.operators.siteinfo import page_description, page_title, site_info
from pagegrove.plans import inputs as I
from pagegrove.plans import sqlfrag as S
from pagegrove.plans.sqlfrag import NL, q
from pagegrove.session import checkpoint_dir
from pagegrove.sources.pages import read_pages, read_table, resolve_pages, spread
from pagegrove.sources.sinks import exportable_llms
from pagegrove.sources.url_list import FIRST_MD_TARGET, parse_url_list

REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}

ROOT_SELECTOR = "nav"  # the flagship's user root selector


def query(name: str, sql: str | None):
    def deco(fn):
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


# ---------------------------------------------------------------------------
# shared Spark inputs
# ---------------------------------------------------------------------------

def pages(spark, sf) -> DataFrame:
    return read_pages(spark, f"{sf}/pages.parquet")


def pages_dom(spark, sf) -> DataFrame:
    return with_dom(spread(pages(spark, sf)))


def nav_pages(spark, sf, mode="compat") -> DataFrame:
    return nav_tree(pages_dom(spark, sf), ROOT_SELECTOR, None, mode)


def request_files(spark, sf) -> DataFrame:
    """S2 -> S4 -> D1 -> P1-P3: one Markdown file per requested URL."""
    p = pages(spark, sf)
    return markdown_for_requests(parse_url_list(I.url_requests(p)), p)


def link_candidates(spark, sf) -> DataFrame:
    return L.link_candidates(I.link_text(pages(spark, sf)))


def llms(spark, sf) -> DataFrame:
    """The tree and the homepage info come from the same parsed page,
    so the reference's join on the homepage is a projection of one row."""
    nav = nav_pages(spark, sf)
    doc = cached_expr(("llms_document",), lambda: llms_document(
        page_title("dom"), page_description("dom"), F.col("nav_md"), F.col("status")))
    return nav.select(
        "page_id", url_host(F.col("url")).alias("site"), F.col("url").alias("homepage_url"),
        doc.alias("content"), "status")


# ---------------------------------------------------------------------------
# SQL building blocks (DuckDB)
# ---------------------------------------------------------------------------

SQL_LINK_CANDS = f"""
WITH lt AS ({I.LINK_TEXT_SQL}),
m AS (SELECT doc_id,
  regexp_extract_all(text, {q(L.MD_LINK)}, 1) AS md_a, regexp_extract_all(text, {q(L.MD_LINK)}, 2) AS md_b,
  regexp_extract_all(text, {q(L.RAW_LINK)}, 0) AS raw_m,
  regexp_extract_all(text, {q(L.HTML_LINK)}, 1) AS h_a, regexp_extract_all(text, {q(L.HTML_LINK)}, 2) AS h_b
  FROM lt),
cands AS (
  SELECT doc_id, 0 AS pattern, CAST(unnest(generate_series(0, len(md_a) - 1)) AS INTEGER) AS pos,
         unnest(md_a) AS a, unnest(md_b) AS b FROM m
  UNION ALL
  SELECT doc_id, 1, CAST(unnest(generate_series(0, len(raw_m) - 1)) AS INTEGER), unnest(raw_m), unnest(raw_m) FROM m
  UNION ALL
  SELECT doc_id, 2, CAST(unnest(generate_series(0, len(h_a) - 1)) AS INTEGER), unnest(h_a), unnest(h_b) FROM m),
oriented AS (
  SELECT doc_id, pattern, pos, {S.strip('b')} AS url,
         CASE WHEN {S.sanitize_text('a')} = '' THEN {S.strip('b')} ELSE {S.sanitize_text('a')} END AS text
  FROM cands),
valid AS (
  SELECT * FROM oriented
  WHERE regexp_matches(regexp_replace(regexp_replace(url, '^[\\x00-\\x20]+', ''), '[\\t\\r\\n]', '', 'g'),
                       '(?s)^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]')),
uniq AS (
  SELECT doc_id, url, arg_max(text, pattern * 1000000000 + pos) AS text,
         CAST(min(pattern * 1000000000 + pos) // 1000000000 AS INTEGER) AS first_pattern,
         CAST(min(pattern * 1000000000 + pos) % 1000000000 AS INTEGER) AS first_pos
  FROM valid GROUP BY doc_id, url)
"""

# per-page HTML facts of the fixture shape
SQL_PAGE_FACTS = f"""
WITH pf AS (
  SELECT page_id, url, html, {S.TITLE_RAW} AS title_raw, {S.ARTICLE} AS article, {S.NAV_HTML} AS nav_html
  FROM pages),
art AS (
  SELECT page_id, url, title_raw, nav_html, article,
         regexp_extract(article, '<h1>([^<]*)</h1>', 1) AS h1_raw,
         string_split(article, '<p>') AS parts
  FROM pf),
paras AS (
  SELECT page_id, k - 2 AS pos,
         CASE WHEN starts_with(parts[k], '<b>') THEN array_to_string(parts[k:], '<p>')
              ELSE split_part(parts[k], '</p>', 1) END AS frag
  FROM (SELECT page_id, parts, unnest(generate_series(2, least(len(parts), 6))) AS k FROM art)),
para_text AS (
  SELECT page_id, pos, {S.element_text('frag')} AS text FROM paras),
md AS (
  SELECT a.page_id, a.url,
         array_to_string(list_concat(['# Untitled Page' || {NL}], ['## ' || {S.strip(S.unescape('a.h1_raw'))} || {NL}],
           coalesce((SELECT list(p.text || {NL} ORDER BY p.pos) FROM para_text p WHERE p.page_id = a.page_id AND p.text <> ''),
                    [])), {NL}) AS content
  FROM art a),
navl AS (
  SELECT page_id, url, CAST(unnest(generate_series(0, len(hrefs) - 1)) AS INTEGER) AS pos,
         unnest(hrefs) AS href, unnest(texts) AS raw_title
  FROM (SELECT page_id, url, regexp_extract_all(nav_html, {q(S.NAV_LINK_RE)}, 1) AS hrefs,
               regexp_extract_all(nav_html, {q(S.NAV_LINK_RE)}, 2) AS texts FROM pf)),
navr AS (
  SELECT page_id, url, pos, href,
         coalesce(nullif({S.js_trim(S.unescape('raw_title'))}, ''), 'Untitled Link') AS title,
         {S.scheme_host('url')} || {S.pct_path('href')} AS link_url
  FROM navl),
navd AS (
  SELECT *, row_number() OVER (PARTITION BY page_id, link_url ORDER BY pos) > 1 AS dup FROM navr),
navk AS (
  SELECT *, {S.sanitize_text('title')} AS title_s,
         regexp_extract(link_url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) AS link_path
  FROM navd),
navf AS (
  SELECT * FROM navk
  WHERE NOT dup AND length(title_s) >= 2 AND lower(title_s) NOT IN ({', '.join(q(s) for s in STOP_TITLES)})
    AND length(link_path) <= 100 AND NOT contains(lower(link_path), 'javascript')),
navmd AS (
  SELECT p.page_id, coalesce((SELECT string_agg('- [' || f.title_s || '](' || f.link_url || ')' || {NL}, '' ORDER BY f.pos)
                              FROM navf f WHERE f.page_id = p.page_id), '') AS nav_md,
         (SELECT count(*) FROM navr r WHERE r.page_id = p.page_id) AS n_links
  FROM pf p),
info AS (
  SELECT page_id, url,
         CASE WHEN title_raw <> '' THEN {S.sanitize_text(S.strip(S.unescape('title_raw')))}
              ELSE {S.sanitize_text(S.strip(S.unescape('h1_raw')))} END AS title,
         'No Description' AS description
  FROM art),
llms AS (
  SELECT i.page_id, {S.host('i.url')} AS site, i.url AS homepage_url,
         CASE WHEN n.n_links = 0 THEN {q(NO_NAV_MESSAGE)}
              ELSE '# ' || i.title || {NL} || {NL} || '> ' || i.description || {NL} || {NL} || '## Navigation' || {NL} || {NL} || n.nav_md END AS content,
         CASE WHEN n.n_links = 0 THEN 'no_nav' ELSE 'ok' END AS status
  FROM info i JOIN navmd n USING (page_id))
"""

SQL_REQUESTS = f"""
WITH rq AS ({I.URL_REQUESTS_SQL}),
lines AS (
  SELECT request_id, CAST(unnest(generate_series(0, len(ls) - 1)) AS INTEGER) AS line_no, unnest(ls) AS raw
  FROM (SELECT request_id, string_split_regex(text, {q(r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]")}) AS ls FROM rq)),
parsed AS (
  SELECT request_id, line_no,
         CASE WHEN regexp_matches(line, {q(FIRST_MD_TARGET)}) THEN regexp_extract(line, {q(FIRST_MD_TARGET)}, 1)
              WHEN starts_with(line, 'http://') OR starts_with(line, 'https://') THEN line END AS url
  FROM (SELECT request_id, line_no, {S.strip('raw')} AS line FROM lines) WHERE line <> ''),
reqs AS (SELECT * FROM parsed WHERE url IS NOT NULL)
"""


# ---------------------------------------------------------------------------
# F*, U*: scalar functions
# ---------------------------------------------------------------------------

@query("pages_scan", "SELECT page_id, url, length(html) AS html_chars FROM pages")
def q_pages_scan(spark, sf):
    """Scan with projection."""
    return pages(spark, sf).select("page_id", "url", F.length("html").alias("html_chars"))


@query("sanitize_text", f"SELECT doc_id, {S.sanitize_text('text')} AS clean_text FROM documents")
def q_sanitize_text(spark, sf):
    """F1 over every document's whole text."""
    return read_table(spark, sf, "documents").select("doc_id", sanitize_text(F.col("text")).alias("clean_text"))


@query("sanitize_filename", f"SELECT page_id, {S.sanitize_filename('url')} AS filename FROM pages")
def q_sanitize_filename(spark, sf):
    """F2."""
    return pages(spark, sf).select("page_id", sanitize_filename(F.col("url")).alias("filename"))


def _sql_url_parts():
    g = lambda i: f"regexp_extract(url, {q(URL_RE)}, {i})"
    path = g(3)
    has_params = f"(regexp_matches({path}, ';[^/]*$') AND lower({g(1)}) IN ('', 'http', 'https', 'ftp', 'sftp', 'tel', 'sip', 'sips', 'mms', 'rtsp', 'rtsps', 'rtspu', 'shttp', 'hdl', 'prospero'))"
    last = f"string_split({path}, '/')[-1]"  # the segment that may have parameters
    return (f"SELECT page_id, lower({g(1)}) AS scheme, {g(2)} AS netloc, "
            f"CASE WHEN {has_params} THEN left({path}, length({path}) - length({last}) + strpos({last}, ';') - 1) ELSE {path} END AS path, "
            f"CASE WHEN {has_params} THEN substr({last}, strpos({last}, ';') + 1) ELSE '' END AS params, "
            f"{g(4)} AS query, {g(5)} AS fragment FROM pages")


@query("url_parts", _sql_url_parts())
def q_url_parts(spark, sf):
    """U1."""
    p = url_parts(F.col("url"))
    return pages(spark, sf).select("page_id", *[p[c].alias(c) for c in
                                               ("scheme", "netloc", "path", "params", "query", "fragment")])


@query("filename_collisions", f"""
SELECT filename, page_id, url, n_same_name FROM (
  SELECT {S.sanitize_filename('url')} AS filename, page_id, url,
         count(*) OVER (PARTITION BY {S.sanitize_filename('url')}) AS n_same_name FROM pages)
WHERE n_same_name > 1""")
def q_filename_collisions(spark, sf):
    """P5: pages whose Markdown file name collides with another page's."""
    files = pages(spark, sf).select("page_id", "url", sanitize_filename(F.col("url")).alias("filename"))
    return filename_collisions(files).select("filename", "page_id", "url", "n_same_name")


# ---------------------------------------------------------------------------
# L*: link conversion (input: per-page link text derived from pages)
# ---------------------------------------------------------------------------

@query("links_markdown", SQL_LINK_CANDS + "SELECT doc_id, pos, a AS text, b AS url FROM cands WHERE pattern = 0")
def q_links_markdown(spark, sf):
    """L1."""
    return link_candidates(spark, sf).filter("pattern = 0").select("doc_id", "pos", F.col("a").alias("text"),
                                                                   F.col("b").alias("url"))


@query("links_raw", SQL_LINK_CANDS + "SELECT doc_id, pos, a AS url FROM cands WHERE pattern = 1")
def q_links_raw(spark, sf):
    """L2."""
    return link_candidates(spark, sf).filter("pattern = 1").select("doc_id", "pos", F.col("a").alias("url"))


@query("links_html", SQL_LINK_CANDS + "SELECT doc_id, pos, a AS href, b AS anchor FROM cands WHERE pattern = 2")
def q_links_html(spark, sf):
    """L3."""
    return link_candidates(spark, sf).filter("pattern = 2").select("doc_id", "pos", F.col("a").alias("href"),
                                                                   F.col("b").alias("anchor"))


@query("links_union", SQL_LINK_CANDS + "SELECT doc_id, pattern, pos, a, b FROM cands")
def q_links_union(spark, sf):
    """L4."""
    return link_candidates(spark, sf)


@query("links_oriented", SQL_LINK_CANDS + "SELECT doc_id, pattern, pos, url, text FROM oriented")
def q_links_oriented(spark, sf):
    """L5."""
    return L.orient_links(link_candidates(spark, sf))


@query("links_valid", SQL_LINK_CANDS + "SELECT doc_id, pattern, pos, url, text FROM valid")
def q_links_valid(spark, sf):
    """L6."""
    return L.valid_links(L.orient_links(link_candidates(spark, sf)))


@query("links_unique", SQL_LINK_CANDS + "SELECT doc_id, url, text, first_pattern, first_pos FROM uniq")
def q_links_unique(spark, sf):
    """L7."""
    return L.dedupe_links(L.valid_links(L.orient_links(link_candidates(spark, sf))))


@query("links_rendered", SQL_LINK_CANDS + f"""
, rendered AS (
  SELECT doc_id, string_agg('- [' || text || '](' || url || ')', {NL} ORDER BY first_pattern, first_pos) AS r
  FROM uniq GROUP BY doc_id)
SELECT lt.doc_id, CASE WHEN coalesce(lt.text, '') = '' THEN {q(L.NO_INPUT)}
                       WHEN r.r IS NULL THEN {q(L.NO_VALID)} ELSE r.r END AS content
FROM lt LEFT JOIN rendered r USING (doc_id)""")
def q_links_rendered(spark, sf):
    """L8 (minimum slice: text -> unique standardised links)."""
    return L.render_links(I.link_text(pages(spark, sf)))


@query("links_fixed", f"""
WITH p AS (SELECT page_id, url, {S.TITLE_RAW} AS t, regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1) AS h, page_id::VARCHAR AS i FROM pages)
SELECT page_id AS doc_id, '- [' || CASE WHEN {S.sanitize_text('t')} = '' THEN url ELSE {S.sanitize_text('t')} END || '](' || url || ')' || {NL}
       || '- [B ' || i || '](' || h || '/b/' || i || ')' || {NL} || '- [' || h || '/c/' || i || '](' || h || '/c/' || i || ')' || {NL}
       || '- [' || h || '/raw-' || i || ',](' || h || '/raw-' || i || ',)' || {NL} || '- [' || h || '/tail-' || i || '](' || h || '/tail-' || i || ')' || {NL}
       || '- [' || h || '/cut-' || i || '](' || h || '/cut-' || i || ')' AS content
FROM p""")
def q_links_fixed(spark, sf):
    """L2, L5, L8 in ``fixed`` mode: raw links only outside of other links."""
    return L.render_links(I.mixed_link_text(pages(spark, sf)), mode="fixed")


# ---------------------------------------------------------------------------
# S2, S4, P*, K*: URL lists -> Markdown files
# ---------------------------------------------------------------------------

@query("url_list_parse", SQL_REQUESTS + "SELECT request_id, line_no, url FROM reqs")
def q_url_list_parse(spark, sf):
    """S2."""
    return parse_url_list(I.url_requests(pages(spark, sf)))


@query("url_list_resolve", SQL_REQUESTS + """
SELECT r.request_id, r.line_no, r.url, p.page_id, p.page_id IS NOT NULL AS found
FROM reqs r LEFT JOIN pages p ON p.url = r.url""")
def q_url_list_resolve(spark, sf):
    """Left join, one output row per request."""
    p = pages(spark, sf).select("url", "page_id")
    reqs = parse_url_list(I.url_requests(pages(spark, sf)))
    return resolve_pages(reqs, p).select("request_id", "line_no", "url", "page_id",
                                         F.col("page_id").isNotNull().alias("found"))


@query("page_markdown_errors", SQL_REQUESTS + f"""
SELECT r.request_id, r.line_no, r.url, {S.sanitize_filename("r.url || '_error'")} AS filename,
       'Error processing ' || r.url || ': page not found' AS content
FROM reqs r LEFT JOIN pages p ON p.url = r.url WHERE p.page_id IS NULL""")
def q_page_markdown_errors(spark, sf):
    """Requests whose page is missing become error documents."""
    return request_files(spark, sf).filter("status = 'error'").select(
        "request_id", "line_no", "url", "filename", "content")


@query("page_markdown", SQL_PAGE_FACTS + f"""
SELECT page_id, url, {S.sanitize_filename('url')} AS filename, content, 'ok' AS status FROM md""")
def q_page_markdown(spark, sf):
    """P1-P3 (compat) over every page (fixture-shape SQL)."""
    return page_markdown(pages_dom(spark, sf))


@query("page_markdown_fixed", SQL_PAGE_FACTS.replace("'# Untitled Page' || {NL}".replace("{NL}", NL),
                                                     f"'# ' || {S.unescape('a.title_raw')} || {NL}")
       .replace("lambda s: s <> ''), '')", "lambda s: s <> ''), ' ')") + f"""
SELECT page_id, url, {S.sanitize_filename('url')} AS filename, content, 'ok' AS status FROM md""")
def q_page_markdown_fixed(spark, sf):
    """P2 'fixed' mode: title read before head removal, text joined by spaces."""
    return page_markdown(pages_dom(spark, sf), mode="fixed")


@query("markdown_file_set", SQL_REQUESTS + SQL_PAGE_FACTS.replace("WITH pf AS", ", pf AS") + f"""
, files AS (
  SELECT r.request_id, r.line_no, r.url,
         CASE WHEN m.page_id IS NULL THEN {S.sanitize_filename("r.url || '_error'")} ELSE {S.sanitize_filename('r.url')} END AS filename,
         CASE WHEN m.page_id IS NULL THEN 'Error processing ' || r.url || ': page not found' ELSE m.content END AS content
  FROM reqs r LEFT JOIN md m ON m.url = r.url)
SELECT filename, request_id, line_no, url, content FROM (
  SELECT *, row_number() OVER (PARTITION BY filename ORDER BY request_id DESC, line_no DESC) AS rn FROM files)
WHERE rn = 1""")
def q_markdown_file_set(spark, sf):
    """Last written file per filename across all request lists."""
    return file_set(request_files(spark, sf).select("filename", "request_id", "line_no", "url", "content"))


SQL_FILES = SQL_REQUESTS + SQL_PAGE_FACTS.replace("WITH pf AS", ", pf AS") + f"""
, files AS (
  SELECT r.request_id, r.line_no,
         CASE WHEN m.page_id IS NULL THEN {S.sanitize_filename("r.url || '_error'")} ELSE {S.sanitize_filename('r.url')} END AS filename,
         CASE WHEN m.page_id IS NULL THEN 'Error processing ' || r.url || ': page not found' ELSE m.content END AS content
  FROM reqs r LEFT JOIN md m ON m.url = r.url),
bundles AS (
  SELECT request_id, CAST(line_no // 1000 AS BIGINT) AS chunk,
         string_agg('File: ' || filename || {NL} || content || {NL} || '---' || {NL}, {NL} ORDER BY line_no) AS bundle
  FROM files GROUP BY 1, 2)
"""


@query("markdown_bundle", SQL_FILES + "SELECT request_id, chunk, bundle FROM bundles")
def q_markdown_bundle(spark, sf):
    """K3: preview text per request list."""
    return markdown_bundle(request_files(spark, sf))


@query("url_list_previews", SQL_FILES + f"""
SELECT request_id, CASE WHEN request_id % 5 IN (0, 1) THEN 0 ELSE chunk END AS chunk,
       CASE request_id % 5 WHEN 0 THEN {q(NO_URLS)} WHEN 1 THEN '' ELSE bundle END AS bundle FROM bundles""")
def q_url_list_previews(spark, sf):
    """Previews of all lists, blank ones and ones without URLs too."""
    p = pages(spark, sf)
    kind = F.col("request_id") % 5
    lists = I.url_requests(p).withColumn("text", F.when(kind == 0, F.lit(" \n\t")).when(kind == 1, F.lit("no link here")).otherwise(F.col("text")))
    return list_previews(lists, markdown_for_requests(parse_url_list(lists), p))


# ---------------------------------------------------------------------------
# D*: HTML -> relational
# ---------------------------------------------------------------------------

@query("dom_tag_counts", """
SELECT lower(tag) AS tag, count(*) AS n FROM (
  SELECT unnest(regexp_extract_all(html, '<([A-Za-z][A-Za-z0-9]*)', 1)) AS tag FROM pages) GROUP BY 1""")
def q_dom_tag_counts(spark, sf):
    """Element counts per tag over the whole corpus (partial + final
    hash aggregate)."""
    d = pages_dom(spark, sf).select(F.explode_outer("dom").alias("n")).filter(F.col("n").isNotNull())
    return (d.filter(~F.col("n.tag").startswith("#"))
            .groupBy(F.col("n.tag").alias("tag")).agg(F.count(F.lit(1)).alias("n")))


@query("boilerplate_strip", """
SELECT page_id, len(regexp_extract_all(
  regexp_replace(regexp_replace(regexp_replace(html, '(?s)<head>.*?</head>', ''), '(?s)<nav>.*?</nav>', ''),
                 '(?s)<footer>.*?</footer>', ''), '<[A-Za-z]', 0)) AS n_elements_kept FROM pages""")
def q_boilerplate_strip(spark, sf):
    """Elements left after removing boilerplate subtrees (fixture-shape SQL)."""
    return pages_dom(spark, sf).select(
        "page_id", F.size(F.filter(strip_boilerplate("dom"), lambda n: ~n["tag"].startswith("#"))).alias("n_elements_kept"))


@query("main_content_kind", """
SELECT page_id, CASE WHEN regexp_matches(html, '<(main|article)[\\s>]') THEN regexp_extract(html, '<(main|article)[\\s>]', 1)
                     WHEN regexp_matches(html, '<body[\\s>]') THEN 'body' END AS main_tag FROM pages""")
def q_main_content_kind(spark, sf):
    """D3."""
    return pages_dom(spark, sf).select("page_id", main_content(strip_boilerplate("dom"))["tag"].alias("main_tag"))


@query("page_headings", SQL_PAGE_FACTS + f"""
SELECT page_id, 0 AS pos, {S.strip(S.unescape('h1_raw'))} AS heading FROM art""")
def q_page_headings(spark, sf):
    """D4 exploded: every h1-h3 of the main content."""
    from pagegrove.operators.markdown import heading_texts, with_main
    return (with_main(pages_dom(spark, sf)).select("page_id", F.posexplode_outer(heading_texts(F.col("dom"))).alias("pos", "heading"))
            .filter(F.col("pos").isNotNull()))


@query("page_top_paragraphs", SQL_PAGE_FACTS + "SELECT page_id, pos, text FROM para_text WHERE text <> ''")
def q_page_top_paragraphs(spark, sf):
    """Non-empty texts among the first five paragraphs; ``pos`` is
    the rank among those five."""
    from pagegrove.operators.markdown import paragraph_texts, with_main
    return (with_main(pages_dom(spark, sf)).select("page_id", F.posexplode_outer(paragraph_texts(F.col("dom"))).alias("pos", "text"))
            .filter("text <> ''"))


@query("selector_match", f"""
SELECT page_id, len(regexp_extract_all({S.NAV_HTML}, '<li><a href=', 0)) AS n_nav_links,
       len(regexp_extract_all(html, '<div class="ad">', 0)) AS n_ads,
       len(regexp_extract_all({S.NAV_HTML}, '<a href="/', 0)) AS n_rel_links FROM pages""")
def q_selector_match(spark, sf):
    """Child combinator, class, attribute prefix and :not."""
    d = pages_dom(spark, sf)
    return d.select("page_id",
                    F.size(matches("dom", "nav > ul > li > a[href]")).alias("n_nav_links"),
                    F.size(matches("dom", "div.ad")).alias("n_ads"),
                    F.size(matches("dom", 'nav a[href^="/"]:not([href^="//"])')).alias("n_rel_links"))


@query("site_type_flags", f"""
SELECT page_id,
  regexp_matches(html, '\\sdata-react(root|id)?[\\s=>]|ReactModal__Overlay') AS react,
  regexp_matches(html, '\\s(data-v-app|data-vue|v-)[\\s=>]|v-application') AS vue,
  regexp_matches(html, '\\s(ng-app|ng-|data-ng)[\\s=>]|ng-scope') AS angular,
  regexp_matches(html, '\\s(data-svelte|svelte-)[\\s=>]') AS svelte,
  regexp_matches(html, '\\sdata-nextjs[\\s=>]') AS nextjs,
  regexp_matches(html, '\\sdata-gatsby[\\s=>]') AS gatsby,
  contains({S.host('url')}, 'lego.com') AS lego,
  contains({S.host('url')}, 'shopify.com') OR regexp_matches(html, '\\sdata-shopify[\\s=>]') AS shopify
FROM pages""")
def q_site_type_flags(spark, sf):
    """D11 (fixture-shape SQL)."""
    f = detect_site_type("dom", "url")
    return pages_dom(spark, sf).select("page_id", *[f[c].alias(c) for c in
                                                    ("react", "vue", "angular", "svelte", "nextjs", "gatsby",
                                                     "lego", "shopify")])


# ---------------------------------------------------------------------------
# N*, T*, H*: navigation and llms.txt
# ---------------------------------------------------------------------------

@query("homepage_info", SQL_PAGE_FACTS + "SELECT page_id, url, title, description FROM info")
def q_homepage_info(spark, sf):
    """H1-H3."""
    return site_info(pages_dom(spark, sf))


@query("nav_roots", f"SELECT page_id, len(regexp_extract_all(html, '<nav[\\s>]', 0)) AS n_roots FROM pages")
def q_nav_roots(spark, sf):
    """Number of root containers per page."""
    return nav_pages(spark, sf).select("page_id", F.size("roots").alias("n_roots"))


@query("nav_links_raw", SQL_PAGE_FACTS + "SELECT page_id, pos, title, link_url AS url FROM navr")
def q_nav_links_raw(spark, sf):
    """Top-level candidate links with title and resolved URL."""
    n = nav_pages(spark, sf)
    top = F.array_sort(F.filter("rows", lambda r: r["depth"] == 0))
    return (n.select("page_id", F.posexplode_outer(top).alias("pos", "r")).filter(F.col("r").isNotNull())
            .select("page_id", "pos", F.col("r.title").alias("title"), F.col("r.url").alias("url")))


@query("nav_top_level", SQL_PAGE_FACTS + "SELECT page_id, pos, title, link_url AS url FROM navd WHERE NOT dup")
def q_nav_top_level(spark, sf):
    """Top-level dedupe by URL, first wins, URL-less entries all kept."""
    top = F.filter("marked", lambda r: r["depth"] == 0)
    rows = nav_pages(spark, sf).select("page_id", F.posexplode_outer(top).alias("pos", "r"))
    return (rows.filter(F.col("r").isNotNull() & ~F.col("r.dup"))
            .select("page_id", "pos", F.col("r.title").alias("title"), F.col("r.url").alias("url")))


@query("url_join", SQL_PAGE_FACTS + "SELECT page_id, pos, href, link_url AS resolved FROM navr")
def q_url_join(spark, sf):
    """Each nav href resolved against its page URL."""
    d = pages_dom(spark, sf)
    hrefs = F.filter("dom", lambda n: (n["tag"] == "a") & F.map_contains_key(n["attrs"], "href")
                     & has_ancestor("dom", n, lambda a: a["tag"] == "nav"))
    return (d.select("page_id", "url", F.posexplode_outer(F.transform(hrefs, lambda n: n["attrs"]["href"])).alias("pos", "href"))
            .filter(F.col("pos").isNotNull())
            .select("page_id", "pos", "href", resolve_href(F.col("url"), F.col("href")).alias("resolved")))


@query("nav_markdown", SQL_PAGE_FACTS + "SELECT page_id, nav_md FROM navmd")
def q_nav_markdown(spark, sf):
    """N7 + T1-T5: rendered navigation tree per page."""
    return nav_pages(spark, sf).select("page_id", "nav_md")


@query("llms_txt", SQL_PAGE_FACTS + "SELECT page_id, site, homepage_url, content, status FROM llms")
def q_llms_txt(spark, sf):
    """Flagship: one llms.txt document per homepage (every page)."""
    return llms(spark, sf)


@query("llms_txt_status", SQL_PAGE_FACTS + "SELECT status, count(*) AS n_pages FROM llms GROUP BY status")
def q_llms_txt_status(spark, sf):
    """Pages per extraction status."""
    return llms(spark, sf).groupBy("status").agg(F.count(F.lit(1)).alias("n_pages"))


@query("llms_txt_export", SQL_PAGE_FACTS + """
SELECT page_id, site, content FROM llms WHERE content <> '' AND NOT contains(content, 'Error')""")
def q_llms_txt_export(spark, sf):
    """K1 guard: the documents the export would write."""
    return exportable_llms(llms(spark, sf)).select("page_id", "site", "content")


# ---------------------------------------------------------------------------
# R*: site-scale operators
# ---------------------------------------------------------------------------

from pagegrove.operators import site as R  # noqa: E402
from pagegrove.streaming import stream as X  # noqa: E402

TOP_K = 5

SQL_SITE = SQL_PAGE_FACTS + f"""
, nl AS (
  SELECT {S.host('url')} AS site, page_id,
         CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS INTEGER) AS pos,
         0 AS depth, title_s AS title, link_url AS url
  FROM navf),
sn AS (
  SELECT site, url, arg_min(title, page_id * 1000000 + pos) AS title, min(page_id) AS first_page_id,
         count(DISTINCT page_id) AS n_pages
  FROM nl GROUP BY site, url),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY site ORDER BY n_pages DESC, url ASC) AS INTEGER) AS rank FROM sn)
"""


def site_links(spark, sf) -> DataFrame:
    return R.site_nav(R.nav_links(nav_pages(spark, sf)))


@query("site_nav", SQL_SITE + "SELECT site, url, title, first_page_id, n_pages FROM sn")
def q_site_nav(spark, sf):
    """Merged navigation of all pages of a site."""
    return site_links(spark, sf)


@query("site_top_links", SQL_SITE + f"SELECT site, url, title, first_page_id, n_pages, rank FROM ranked WHERE rank <= {TOP_K}")
def q_site_top_links(spark, sf):
    """R2: top-k links per site by number of linking pages."""
    return R.rank_links(site_links(spark, sf), TOP_K)


@query("site_sections", SQL_SITE + f"""
, sec AS (
  SELECT *, CASE WHEN regexp_extract(regexp_extract(url, {q(URL_RE)}, 3), '^/([^/]*)', 1) = '' THEN '/'
                 ELSE regexp_extract(regexp_extract(url, {q(URL_RE)}, 3), '^/([^/]*)', 1) END AS section FROM sn),
sr AS (
  SELECT *, row_number() OVER (PARTITION BY site, section ORDER BY n_pages DESC, url ASC) AS srank FROM sec)
SELECT site, section, CAST((srank - 1) // 1000 AS BIGINT) AS chunk, '## ' || section || {NL} || string_agg('- [' || title || '](' || url || ')', {NL} ORDER BY srank) AS content
FROM sr GROUP BY site, section, (srank - 1) // 1000""")
def q_site_sections(spark, sf):
    """Sectioned llms.txt blocks, all links by first path segment."""
    return R.sectioned_llms_txt(site_links(spark, sf))


@query("annotated_links", SQL_SITE + """
SELECT s.site, s.url, CASE WHEN i.description IS NOT NULL AND i.description <> '' AND i.description <> 'No Description'
                           THEN '- [' || s.title || '](' || s.url || ') - ' || i.description
                           ELSE '- [' || s.title || '](' || s.url || ')' END AS line
FROM sn s LEFT JOIN info i ON i.url = s.url""")
def q_annotated_links(spark, sf):
    """Links annotated with the linked page's description."""
    facts = R.page_facts(nav_pages(spark, sf))
    return R.annotate_links(R.site_nav(R.nav_links(facts)), facts)


@query("nav_depth_limited", SQL_SITE + "SELECT site, page_id, pos, depth, title, url FROM nl WHERE depth <= 0")
def q_nav_depth_limited(spark, sf):
    """Navigation rows down to depth 0."""
    return R.limit_depth(R.nav_links(nav_pages(spark, sf)), 0)


FULL_CHARS = 20_000  # small, so that sites have several chunks


@query("llms_full", SQL_PAGE_FACTS + f"""
, sized AS (SELECT *, {S.host('url')} AS site, length(content) + {len(R.PAGE_SEPARATOR)} AS size FROM md),
run AS (
  SELECT *, coalesce(sum(CASE WHEN size <= {FULL_CHARS // 2} THEN size ELSE 0 END) OVER w, 0) AS chars, coalesce(sum((size > {FULL_CHARS // 2})::INT) OVER w, 0) AS n_long
  FROM sized WINDOW w AS (PARTITION BY site ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT site, CAST(chars // {FULL_CHARS // 2} + 2 * n_long + (size > {FULL_CHARS // 2})::INT AS BIGINT) AS chunk,
       string_agg(content, {q(R.PAGE_SEPARATOR)} ORDER BY page_id) AS content, count(*) AS n_pages
FROM run GROUP BY 1, 2""")
def q_llms_full(spark, sf):
    """Whole-site text in ordered chunks of bounded size."""
    return R.llms_full(page_markdown(pages_dom(spark, sf)), FULL_CHARS)


@query("link_details", SQL_SITE + f"""
SELECT s.site, s.url, s.title,
       CASE WHEN m.url IS NOT NULL THEN {q(R.DETAIL_PREFIX + '[')} || {S.sanitize_filename('m.url')} || '](' || s.url || ')' END AS detail
FROM sn s LEFT JOIN md m ON m.url = s.url""")
def q_link_details(spark, sf):
    """Each link with a pointer to its page's Markdown file."""
    facts = R.page_facts(nav_pages(spark, sf))
    return R.link_details(R.site_nav(R.nav_links(facts)), facts)


@query("link_metadata", SQL_SITE + """
SELECT s.site, s.url, s.title, length(m.content) AS md_chars FROM sn s LEFT JOIN md m ON m.url = s.url""")
def q_link_metadata(spark, sf):
    """Markdown size of each linked page."""
    facts = R.page_facts(nav_pages(spark, sf))
    return R.link_metadata(R.site_nav(R.nav_links(facts)), facts)


@query("robots_rules", f"""
SELECT host, 1 AS group_no, '*' AS agent, rule_no, allow, path_prefix FROM ({I.ROBOTS_TEXTS_SQL}) h,
  (VALUES (1, true, '/en/'), (2, false, '/')) r(rule_no, allow, path_prefix)""")
def q_robots_rules(spark, sf):
    """Robots.txt text of every host parsed into rules."""
    return R.parse_robots(I.robots_texts(pages(spark, sf))).drop("directive")


@query("robots_allowed", f"""
SELECT page_id, url, starts_with(
  CASE WHEN regexp_extract(url, {q(URL_RE)}, 3) = '' THEN '/' ELSE regexp_extract(url, {q(URL_RE)}, 3) END
  || CASE WHEN regexp_extract(url, {q(URL_RE)}, 4) <> '' THEN '?' || regexp_extract(url, {q(URL_RE)}, 4) ELSE '' END,
  '/en/') AS allowed FROM pages""")
def q_robots_allowed(spark, sf):
    """Robots filter over every page URL (rules derived per host)."""
    p = pages(spark, sf)
    return R.allowed_urls(p.select("page_id", "url"), R.parse_robots(I.robots_texts(p)))


# ---------------------------------------------------------------------------
# X*: streaming reuse (same result as batch)
# ---------------------------------------------------------------------------

@query("stream_page_markdown", REGISTRY["page_markdown"][1])
def q_stream_page_markdown(spark, sf):
    """Page Markdown computed by a Structured Streaming query over the
    page files, drained with ``availableNow``; equals the batch result."""
    out = X.run_to_table(spark, X.stream_page_markdown(X.read_page_stream(spark, sf)), "page_markdown")
    return out


@query("stream_first_seen_urls", "SELECT DISTINCT url FROM pages")
def q_stream_first_seen_urls(spark, sf):
    """First-seen URL dedupe across micro-batches."""
    s = X.read_page_stream(spark, sf, max_files_per_trigger=1).select("url")
    return X.run_to_table(spark, X.first_seen_urls(s), "first_seen_urls")


@query("stream_urls_across_files", "SELECT DISTINCT url FROM pages")
def q_stream_urls_across_files(spark, sf):
    """URLs that several files repeat, read in batches with a restart
    between them; each comes out once."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/arrivals-{uuid.uuid4().hex}"
    p = pages(spark, sf).select("page_id", "url", "html")
    run = uuid.uuid4().hex
    for part in (p.where("page_id % 2 = 0"), p.where("page_id % 3 > 0"), p):
        part.coalesce(1).write.mode("append").parquet(folder)
        s = X.read_page_stream(spark, folder, "*.parquet", max_files_per_trigger=1).select("url")
        out = X.run_to_table(spark, X.first_seen_urls(s), "urls_across_files", run=run)
    return out


@query("nav_filtered", SQL_SITE + "SELECT page_id, pos, depth, title, url FROM nl")
def q_nav_filtered(spark, sf):
    """Surviving navigation rows (failing nodes dropped with their
    subtrees), in pre-order."""
    return R.nav_links(nav_pages(spark, sf)).select("page_id", "pos", "depth", "title", "url")


@query("nav_tree_lines", SQL_SITE + f"""
SELECT page_id, pos AS line_no, repeat('  ', depth) || '- [' || title || '](' || url || ')' AS line FROM nl""")
def q_nav_tree_lines(spark, sf):
    """T5 exploded: one rendered Markdown line per surviving node."""
    n = nav_pages(spark, sf)
    lines = F.split(F.regexp_replace(F.col("nav_md"), "\n$", ""), "\n")
    return (n.select("page_id", F.posexplode_outer(F.when(F.col("nav_md") != "", lines)).alias("line_no", "line"))
            .filter(F.col("line").isNotNull()))


# queries on inputs composed from the tables; they register themselves
from pagegrove.plans import composed, robots  # noqa: E402, F401
