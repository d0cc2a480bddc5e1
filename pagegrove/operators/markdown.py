"""Page -> Markdown document, file sets and previews.

Everything here is narrow (per page) except ``file_set`` (one keyed
aggregate of names, one join) and ``markdown_bundle`` (one ordered aggregate per
request list).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrove.functions.text import cached_expr, py_strip, sanitize_filename
from pagegrove.operators.dom import (element_string, element_text, first_node, is_desc,
                                     main_content, meta_content, strip_boilerplate)
from pagegrove.sources.staging import stage

# --- Fixed values -----------------------------------------------------------
HEADING_TAGS = ("h1", "h2", "h3")
PARAGRAPH_LIMIT = 5
UNTITLED = "Untitled Page"
NO_MAIN_MESSAGE = "no main content"
MISSING_PAGE_MESSAGE = "page not found"
NO_URLS = "No URLs provided."
# ---------------------------------------------------------------------------


def with_main(pages_dom: DataFrame) -> DataFrame:
    """Stages ``_alive`` (D2) and ``_main`` (D3) as once-per-row columns."""
    s1 = pages_dom.select("*", strip_boilerplate("dom").alias("_alive"))
    return s1.select("*", main_content("_alive").alias("_main"))


def heading_texts(dom: Column, sep: str = "") -> Column:
    """Texts of the headings of the main content (after ``with_main``)."""
    heads = F.filter(F.col("_alive"), lambda n: is_desc(n, F.col("_main")) & n["tag"].isin(*HEADING_TAGS))
    return F.transform(heads, lambda h: element_text(dom, h, strip=True, sep=sep, alive=True))


def paragraph_texts(dom: Column, sep: str = "") -> Column:
    """Texts, empty ones too, of the first paragraphs of the main content."""
    paras = F.filter(F.col("_alive"), lambda n: is_desc(n, F.col("_main")) & (n["tag"] == "p"))
    return F.transform(F.slice(paras, 1, PARAGRAPH_LIMIT), lambda p: element_text(dom, p, strip=True, sep=sep, alive=True))


def _markdown_body(dom: Column, mode: str) -> tuple[Column, Column]:
    """(content, has_main) for one page, over the staged ``_alive``/``_main``."""
    alive = F.col("_alive")
    # compat reads title/description after the removal; fixed reads them first
    meta_tree = dom if mode == "fixed" else alive
    sep = " " if mode == "fixed" else ""

    main = F.col("_main")
    meta = meta_content(meta_tree, "name", "description")
    meta_text = meta["attrs"]["content"]
    desc_block = F.when(meta.isNotNull() & F.coalesce(meta_text != "", F.lit(False)),
                        F.array(F.concat(F.lit("# Page Description\n\n"), meta_text, F.lit("\n"))))
    desc_block = F.coalesce(desc_block, F.array().cast("array<string>"))

    t = first_node(meta_tree, lambda n: n["tag"] == "title")
    title_text = F.when(t.isNull(), F.lit(UNTITLED)).otherwise(
        F.coalesce(element_string(meta_tree, t), F.lit("None")))
    title_block = F.array(F.concat(F.lit("# "), title_text, F.lit("\n")))

    heads = F.transform(heading_texts(dom, sep), lambda s: F.concat(F.lit("## "), s, F.lit("\n")))
    paras = F.filter(paragraph_texts(dom, sep), lambda s: s != "")
    paras = F.transform(paras, lambda s: F.concat(s, F.lit("\n")))
    content = F.array_join(F.concat(desc_block, title_block, heads, paras), "\n")
    return content, main.isNotNull()


def page_markdown(pages_dom: DataFrame, mode: str = "compat",
                  keys=("page_id", "url")) -> DataFrame:
    """``(*keys, filename, content, status)``, one row per input
    row (``keys`` must include ``url``).  ``status`` is 'ok' or 'error'; an error row carries the filename of
    ``url + '_error'`` and ``Error processing <url>: <message>``."""
    if mode not in ("compat", "fixed"):
        raise ValueError("mode must be 'compat' or 'fixed'")
    pages_dom = with_main(pages_dom)
    content, has_main = cached_expr(("markdown_body", mode), lambda: _markdown_body(F.col("dom"), mode))
    missing = F.col("dom").isNull()
    ok = ~missing & has_main
    message = F.when(missing, F.lit(MISSING_PAGE_MESSAGE)).otherwise(F.lit(NO_MAIN_MESSAGE))
    return pages_dom.select(
        *keys,
        F.when(ok, sanitize_filename(F.col("url")))
         .otherwise(sanitize_filename(F.concat(F.col("url"), F.lit("_error")))).alias("filename"),
        F.when(ok, content)
         .otherwise(F.concat(F.lit("Error processing "), F.col("url"), F.lit(": "), message)).alias("content"),
        F.when(ok, F.lit("ok")).otherwise(F.lit("error")).alias("status"),
    )


def file_set(files: DataFrame, order_cols=("request_id", "line_no")) -> DataFrame:
    """One row per filename, the last written (highest order key) wins.

    Files are staged once; the winners are found among names and order keys
    only, and their content is joined on at the end, so no text goes through
    an aggregate.  Of rows that agree in all order keys one wins."""
    rows = stage(files.withColumn("_row", F.monotonically_increasing_id()), "file-set")
    last = F.max(F.struct(*order_cols, "_row"))
    winners = rows.select("filename", "_row", *order_cols).groupBy("filename").agg(last.alias("w")).select(F.col("w._row").alias("_row"))
    return rows.join(winners, "_row").drop("_row").select("filename", *[c for c in files.columns if c != "filename"])


def filename_collisions(files: DataFrame) -> DataFrame:
    """P5: files whose filename is shared with another row (data the file
    set would overwrite), with the size of the collision group.  Counts are
    computed by a map-side-combined aggregate and joined back."""
    counts = files.groupBy("filename").agg(F.count(F.lit(1)).alias("n_same_name")).filter("n_same_name > 1")
    return files.join(counts, "filename", "inner")


def markdown_bundle(files: DataFrame, group_col: str = "request_id", order_col: str = "line_no",
                    chunk_lines: int = 1000) -> DataFrame:
    """K3: preview text per request list: every file (collisions included) as
    ``File: <name>``, newline, content, newline, ``---``, newline; blocks
    joined by newline in request order.  Emitted as ``(request_id, chunk,
    bundle)`` with at most ``chunk_lines`` request lines per chunk, so a huge
    list never becomes one string in one task; the chunks in order,
    newline-joined, give the full preview."""
    block = F.concat(F.lit("File: "), F.col("filename"), F.lit("\n"), F.col("content"), F.lit("\n---\n"))
    chunk = F.floor(F.col(order_col) / chunk_lines).cast("long").alias("chunk")
    return (files.groupBy(F.col(group_col), chunk)
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("k"), block.alias("b")))),
                                          lambda x: x["b"]), "\n").alias("bundle")))


def list_previews(lists: DataFrame, files: DataFrame, text_col: str = "text", chunk_lines: int = 1000) -> DataFrame:
    """K3 with S2's answer for every list: ``(request_id, chunk, bundle)``; a
    blank list gets ``NO_URLS`` and one without any URL an empty text."""
    bundles = markdown_bundle(files, chunk_lines=chunk_lines).withColumnRenamed("request_id", "_id")
    heads = lists.select("request_id", (py_strip(F.coalesce(F.col(text_col), F.lit(""))) == "").alias("_blank"))
    j = heads.join(bundles, F.col("request_id") == F.col("_id"), "left")
    return j.select("request_id", F.coalesce("chunk", F.lit(0).cast("long")).alias("chunk"),
                    F.coalesce("bundle", F.when(F.col("_blank"), F.lit(NO_URLS)).otherwise(F.lit(""))).alias("bundle"))


def markdown_for_requests(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """S4 + P1-P3 for request rows ``(request_id, line_no, url)``: every
    distinct requested URL is parsed once (a page requested by a million
    lists is converted once), then the files are joined back to the request
    rows; a URL absent from ``pages`` becomes an error document."""
    from pagegrove.operators.dom import with_dom
    from pagegrove.sources.pages import spread
    wanted = requests.select("url").distinct()
    hits = pages.join(wanted, "url", "left_semi")
    files = page_markdown(with_dom(spread(hits.select("page_id", "url", "html"))))
    j = requests.join(files, "url", "left")
    missing = F.col("page_id").isNull()
    return j.select(
        "request_id", "line_no", "url", "page_id",
        F.when(missing, sanitize_filename(F.concat(F.col("url"), F.lit("_error"))))
         .otherwise(F.col("filename")).alias("filename"),
        F.when(missing, F.concat(F.lit("Error processing "), F.col("url"), F.lit(": "), F.lit(MISSING_PAGE_MESSAGE)))
         .otherwise(F.col("content")).alias("content"),
        F.when(missing, F.lit("error")).otherwise(F.col("status")).alias("status"))
