"""Site-scale operators over many pages per host.

Inputs are the per-page navigation rows (``kept`` of ``nav_tree``) and the
per-page Markdown files.  Every operator is a keyed aggregate, a top-k
window or a join; no group is ever collected whole into one task:

* keys are ``(site, url)`` -- a site with a third of all pages still spreads
  over many tasks, and partial aggregation runs before the shuffle;
* top-k reports use ``row_number() <= k`` which Spark plans as a partial
  ``WindowGroupLimit`` before the shuffle;
* places and sizes inside a site or section are counted over ranges
  (``ranking.py``), so a hot one is spread over tasks; whole-site text
  (``llms_full``) is cut into ordered chunks by characters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagegrove.functions.text import let, py_strip, split_lines
from pagegrove.functions.urls import py_quote, py_unquote, py_urlunparse, resolve_href, splits, url_host, url_parts, valid_url
from pagegrove.operators.markdown import page_markdown
from pagegrove.operators.ranking import with_running
from pagegrove.operators.siteinfo import page_description
from pagegrove.sources.staging import stage

# --- Fixed values -----------------------------------------------------------
PAGE_SEPARATOR = "\n\n---\n\n"
CHUNK_CHARS = 1_000_000
DETAIL_PREFIX = "  - Detailed content: "
# Directives of robots.txt that belong to no group.
SITE_DIRECTIVES = ["llm", "llm-full", "sitemap"]
# ---------------------------------------------------------------------------


def nav_links(nav: DataFrame) -> DataFrame:
    """Exploded kept navigation rows: ``(site, page_id, pos, depth, title,
    url)`` where ``url`` is the rendered (joined) URL and ``pos`` the
    pre-order position in the page's tree."""
    return (nav.select("page_id", url_host(F.col("url")).alias("site"),
                       F.posexplode_outer("kept").alias("pos", "r"))
            # _outer: a plain generator makes the optimizer infer size(kept) > 0
            # and push it below the shuffle, re-running the per-page pipeline
            .filter(F.col("r").isNotNull())
            .select("site", "page_id", "pos", F.col("r.depth").alias("depth"),
                    F.col("r.title").alias("title"), F.col("r.full").alias("url")))


def site_nav(links: DataFrame) -> DataFrame:
    """One row per (site, url) with a URL; the title first seen in (page, position)
    order and the number of pages linking to it."""
    # Two levels instead of count_distinct: a distinct aggregate shuffles
    # every page id of a (site, url) into one task, and one link (say the
    # home link of a site with a third of all pages) can hold a third of all
    # rows.  Level 1 is keyed by page too; level 2 only uses map-side
    # combinable aggregates (count, min, min_by).
    per_page = (links.filter(F.col("url") != "").groupBy("site", "url", "page_id")
                .agg(F.min_by("title", F.col("pos")).alias("title"), F.min("pos").alias("pos")))
    key = F.struct("page_id", "pos")
    return (per_page.groupBy("site", "url")
            .agg(F.min_by("title", key).alias("title"), F.min("page_id").alias("first_page_id"),
                 F.count(F.lit(1)).alias("n_pages")))


def rank_links(site_links: DataFrame, k: int) -> DataFrame:
    """R2: the ``k`` most linked URLs per site (ties by URL)."""
    w = Window.partitionBy("site").orderBy(F.desc("n_pages"), F.asc("url"))
    return (site_links.withColumn("rank", F.row_number().over(w))
            .filter(F.col("rank") <= k))


def first_segment(url_col) -> F.Column:
    path = url_parts(url_col)["path"]
    seg = F.regexp_extract(path, r"^/([^/]*)", 1)
    return F.when(seg == "", F.lit("/")).otherwise(seg)


def sectioned_llms_txt(site_links: DataFrame, chunk_links: int = 1000) -> DataFrame:
    """All links grouped under a heading per first path segment, most
    linked first, as ordered text blocks ``(site, section, chunk, content)``
    of at most ``chunk_links`` links, so no string grows with the section."""
    w = Window.partitionBy("site", "section").orderBy(F.desc("n_pages"), F.asc("url"))
    top = (site_links.withColumn("section", first_segment(F.col("url")))
           .withColumn("rank", F.row_number().over(w))
           .withColumn("chunk", F.floor((F.col("rank") - 1) / chunk_links).cast("long")))
    line = F.concat(F.lit("- ["), F.col("title"), F.lit("]("), F.col("url"), F.lit(")"))
    return (top.groupBy("site", "section", "chunk")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", line.alias("l")))),
                                          lambda x: x["l"]), "\n").alias("lines"))
            .select("site", "section", "chunk",
                    F.concat(F.lit("## "), F.col("section"), F.lit("\n"), F.col("lines")).alias("content")))


def page_facts(nav: DataFrame) -> DataFrame:
    """``(page_id, url, kept, description, filename, md_chars, status)`` of
    pages with their trees (``nav_tree``): what links of a page and links to
    it need, from one parse, staged as narrow rows."""
    described = nav.withColumn("description", page_description("dom"))
    files = page_markdown(described, keys=("page_id", "url", "kept", "description"))
    return stage(files.select("page_id", "url", "kept", "description", "filename", F.length("content").alias("md_chars"), "status"), "page-facts")


def by_link_url(pages: DataFrame, *cols: F.Column) -> DataFrame:
    """``(url, *cols)``: one row per page URL in the form that links have;
    of several pages with that URL the one with the least page_id."""
    v = pages.select("page_id", resolve_href(F.col("url"), F.col("url")).alias("url"), F.struct(*cols).alias("v"))
    return v.groupBy("url").agg(F.min_by("v", "page_id").alias("v")).select("url", "v.*")


def annotate_links(site_links: DataFrame, info: DataFrame) -> DataFrame:
    """``- [title](url)`` plus `` - description`` when the linked page is
    known and has a description."""
    d = by_link_url(info, F.col("description"))
    j = site_links.join(d, "url", "left")
    has = F.col("description").isNotNull() & (F.col("description") != "") & (F.col("description") != "No Description")
    base = F.concat(F.lit("- ["), F.col("title"), F.lit("]("), F.col("url"), F.lit(")"))
    return j.select("site", "url", F.when(has, F.concat(base, F.lit(" - "), F.col("description")))
                    .otherwise(base).alias("line"))


def limit_depth(links: DataFrame, max_depth: int) -> DataFrame:
    """Keep navigation rows down to ``max_depth`` (0 = top level)."""
    return links.filter(F.col("depth") <= max_depth)


def llms_full(files: DataFrame, chunk_chars: int = CHUNK_CHARS) -> DataFrame:
    """Whole-site text: every page's Markdown per site in page order, as
    ``(site, chunk, content, n_pages)`` rows whose chunks ascend.

    A chunk has at most ``chunk_chars`` characters, separators included,
    unless it is one longer page alone.  Pages of up to half of that go by the
    half that the running size of such pages before them falls in, so a
    chunk is nearly half full at least, whatever the page ids; a longer page
    is a chunk of its own.  Error pages are left out.  A page_id counts once a site."""
    half = chunk_chars // 2
    # error pages are told by a flag: a filter on the derived ``status`` would
    # be pushed below the parse and re-run the whole per-page pipeline
    ok = (F.col("status") == "ok") if "status" in files.columns else F.lit(True)
    texts = stage(files.select(url_host(F.col("url")).alias("site"), "page_id", "content", ok.alias("ok")), "llms-full")
    size = F.length("content") + len(PAGE_SEPARATOR)
    sizes = texts.where("ok").groupBy("site", "page_id").agg(F.max(size).alias("size"))
    sizes = sizes.select("site", "page_id", F.when(F.col("size") <= half, F.col("size")).otherwise(0).alias("small"), (F.col("size") > half).cast("int").alias("long"))
    placed = with_running(sizes, ["site"], [F.col("page_id")], {"chars": "small", "n_long": "long"})
    chunk = F.floor(F.col("chars") / half) + 2 * F.col("n_long") + F.col("long")
    placed = placed.select(F.col("site").alias("own_site"), F.col("page_id").alias("own_page"), chunk.cast("long").alias("chunk"))
    here = F.col("site").eqNullSafe(F.col("own_site")) & F.col("page_id").eqNullSafe(F.col("own_page"))
    return (texts.where("ok").join(placed, here).groupBy("site", "chunk")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_id", "content"))), lambda x: x["content"]), PAGE_SEPARATOR).alias("content"),
                 F.count(F.lit(1)).alias("n_pages")))


def link_details(site_links: DataFrame, files: DataFrame) -> DataFrame:
    """Cross-reference each link to the Markdown file of its page."""
    f = by_link_url(files, F.when(F.col("status") == "ok", F.col("filename")).alias("filename"))
    j = site_links.join(f, "url", "left")
    return j.select("site", "url", "title",
                    F.when(F.col("filename").isNotNull(),
                           F.concat(F.lit(DETAIL_PREFIX + "["), F.col("filename"), F.lit("]("), F.col("url"), F.lit(")")))
                    .alias("detail"))


def link_metadata(site_links: DataFrame, files: DataFrame) -> DataFrame:
    """Content size of the linked page's Markdown (null when unknown).
    ``files`` has ``content`` or its length, ``md_chars``."""
    size = F.col("md_chars") if "md_chars" in files.columns else F.length("content")
    f = by_link_url(files, F.when(F.col("status") == "ok", size).alias("md_chars"))
    return site_links.join(f, "url", "left").select("site", "url", "title", "md_chars")


def robots_lines(robots: DataFrame) -> DataFrame:
    """``(host, line_no, blank, key, val)``: the directives of every robots.txt
    and its empty lines; comments are cut off, values percent-decoded.  Lines
    of white space only are neither."""
    lines = robots.select("host", F.posexplode(split_lines(F.col("robots_txt"))).alias("line_no", "raw"))
    line = py_strip(F.regexp_extract("raw", r"(?s)^([^#]*)", 1))
    named = line.contains(":")
    key = F.lower(py_strip(F.regexp_extract(line, r"(?s)^([^:]*):", 1)))
    val = py_unquote(py_strip(F.regexp_extract(line, r"(?s)^[^:]*:(.*)$", 1)))
    return (lines.select("host", F.col("line_no").cast("int").alias("line_no"), (F.col("raw") == "").alias("blank"), named.alias("named"), key.alias("key"), val.alias("val"))
            .where("blank or named").drop("named"))


def parse_robots(robots: DataFrame) -> DataFrame:
    """Robots.txt text per host -> ``(host, group_no, agent, rule_no,
    directive, allow, path_prefix)``, one row per agent and line of a group.

    Consecutive User-agent lines open one group; an empty line, or a
    User-agent line after other directives, closes it; directives outside a
    group are ignored.  Groups without any directive are none.  Paths are in
    the percent-encoded form of ``robots_path``; an empty Disallow allows
    all.  ``crawl-delay`` and ``request-rate`` lines have no path, but make a
    group too.  A host with a path that the standard parser cannot read has no
    rows (an unreadable file allows all)."""
    rules = ["allow", "disallow", "crawl-delay", "request-rate"]
    parsed = robots_lines(robots).withColumn("key", F.when(F.col("blank"), "").otherwise(F.col("key"))).where(F.col("key").isin("", "user-agent", *rules))
    w = Window.partitionBy("host").orderBy("line_no")
    opens = (F.col("key") == "user-agent") & (F.coalesce(F.lag("key").over(w), F.lit("")) != "user-agent")
    has_path = F.col("key").isin("allow", "disallow")
    grouped = (parsed.withColumn("step", F.when(opens | (F.col("key") == ""), 1).otherwise(0))
               .withColumn("group_no", F.sum("step").over(w))
               .withColumn("bad", F.max(has_path & ~splits(F.col("val"))).over(Window.partitionBy("host"))).where("not bad"))
    agents = grouped.filter(F.col("key") == "user-agent").select("host", "group_no", F.col("val").alias("agent")).distinct()
    joined = grouped.filter(F.col("key").isin(*rules)).join(agents, ["host", "group_no"])
    return joined.select(
        "host", F.col("group_no").cast("int").alias("group_no"), "agent", F.col("line_no").alias("rule_no"), F.col("key").alias("directive"),
        F.when(has_path, (F.col("key") == "allow") | (F.col("val") == "")).alias("allow"),
        F.when(has_path, let(url_parts(F.col("val")), lambda p: py_quote(py_urlunparse(p)))).alias("path_prefix"))


def robots_guidance(robots: DataFrame) -> DataFrame:
    """The lines that hold for a whole site, whatever their place:
    ``(host, rule_no, directive, value)`` of ``LLM``, ``LLM-full`` and
    ``Sitemap`` lines; values that are no URL with a host are left out."""
    lines = robots_lines(robots).where(F.col("key").isin(*SITE_DIRECTIVES))
    return lines.where(valid_url(F.col("val"))).select("host", F.col("line_no").alias("rule_no"), F.col("key").alias("directive"), F.col("val").alias("value"))


def host_rules(rules: DataFrame, agent: str = "*") -> DataFrame:
    """``(host, rules)``: the rules that apply to ``agent``, in file order.

    The first group that names part of the agent's product (without regard
    to case) applies; only where none does, the first group that has ``*``
    among its agents, which counts for nothing else."""
    product = agent.split("/")[0].lower()
    groups = rules.groupBy("host", "group_no").agg(F.max(F.col("agent") == "*").alias("default"), F.max(F.lit(product).contains(F.lower("agent"))).alias("named"))
    rank = F.when(F.col("default"), 1).when(F.col("named"), 0)
    best = groups.where(rank.isNotNull()).groupBy("host").agg(F.min(F.struct(rank.alias("rank"), "group_no")).alias("best")).select("host", "best.group_no")
    mine = rules.join(best, ["host", "group_no"]).where("allow is not null").dropDuplicates(["host", "rule_no"])
    return mine.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("rule_no", "allow", "path_prefix"))).alias("rules"))


def robots_path(url) -> F.Column:
    """What rules are tested against: the URL decoded, split, and its path,
    parameters, query and fragment encoded again; ``/`` if that is empty."""
    return let(url_parts(py_unquote(url)), lambda p: let(py_quote(py_urlunparse(p, whole=False)), lambda x: F.when(x == "", F.lit("/")).otherwise(x)))


def allowed_urls(urls: DataFrame, rules: DataFrame, agent: str = "*") -> DataFrame:
    """``(page_id, url, allowed)``: of the rules that apply to ``agent``
    the first whose path the URL's path begins with decides; none allows.

    Both sides are in one percent-encoded form, so a rule holds however it
    and the URL are written.  A URL that cannot be split is allowed.  Rules
    are folded to one row per host (a robots.txt has a bounded size) and
    tested in place, so URLs are joined once and never multiplied."""
    u = urls.select("page_id", "url", url_host(F.col("url")).alias("host"), robots_path(F.col("url")).alias("rpath"))
    j = u.join(host_rules(rules, agent), "host", "left")
    hit = F.filter("rules", lambda r: F.col("rpath").startswith(r["path_prefix"]))
    allowed = F.coalesce(F.get(hit, F.lit(0))["allow"], F.lit(True)) | ~splits(py_unquote(F.col("url")))
    return j.select("page_id", "url", allowed.alias("allowed"))
