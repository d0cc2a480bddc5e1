"""Free text -> unique, standardised Markdown link list.

One projection computes the three match arrays, one ``explode`` emits all
candidates with their ``(pattern, pos)`` order key (so the text is scanned
once, not once per pattern), then a filter, one hash aggregate on
``(doc_id, url)`` and one ordered aggregate per document.  No Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrove.functions.text import PY_NON_WS, PY_WS, let, py_strip, sanitize_text
from pagegrove.functions.urls import valid_url

# --- Fixed values -----------------------------------------------------------
# The three link patterns, in the order they are applied ('.' is written
# [^\n] so Java and RE2 agree with Python's dot).
MD_LINK = r"\[([^\n]*?)\]\(([^\n]*?)\)"
RAW_LINK = r"https?://" + PY_NON_WS + "+"
HTML_LINK = r"<a" + PY_WS + r"+href=\"([^\n]*?)\"[^\n]*?>([^\n]*?)</a>"
PATTERN_MD, PATTERN_RAW, PATTERN_HTML = 0, 1, 2
NO_INPUT = "No input provided"
NO_VALID = "No valid links found."
# ---------------------------------------------------------------------------


def _rx_all(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _pairs(pattern_no: int, a: Column, b: Column) -> Column:
    return F.transform(F.arrays_zip(a.alias("a"), b.alias("b")),
                       lambda x, i: F.struct(F.lit(pattern_no).alias("pattern"), i.alias("pos"),
                                             x["a"].alias("a"), x["b"].alias("b")))


def match_spans(text: Column, pattern: str) -> Column:
    """``(start, end)`` of every match of ``pattern``, counted from 0: the
    texts between matches and the matches tell where each begins."""
    def spans(v):
        between = F.transform(v["between"], F.length)
        sizes = F.transform(v["matches"], F.length)
        step = lambda acc, i: F.struct(
            (acc["at"] + between[i] + sizes[i]).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + between[i]).alias("start"), (acc["at"] + between[i] + sizes[i]).alias("end")))).alias("out"))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))
        places = F.when(F.size(sizes) > 0, F.sequence(F.lit(0), F.size(sizes) - 1)).otherwise(F.array().cast("array<int>"))
        return F.aggregate(places, start, step, lambda acc: acc["out"])
    return let(F.struct(F.split(text, pattern, -1).alias("between"), _rx_all(text, pattern, 0).alias("matches")), spans)


def outside(text: Column, spans: Column) -> Column:
    """What lies outside of all ``(start, end)`` spans, joined by spaces."""
    def cut(acc, s):
        piece = F.array(F.substring(text, acc["at"] + 1, s["start"] - acc["at"]))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], piece)).otherwise(acc["out"]).alias("out"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(F.array_sort(spans), start, cut, lambda acc: F.array_join(F.concat(acc["out"], F.array(F.substring(text, acc["at"] + 1, F.length(text)))), " "))


def _matches(t: Column, mode: str) -> Column:
    md = _pairs(PATTERN_MD, _rx_all(t, MD_LINK, 1), _rx_all(t, MD_LINK, 2))
    plain = t if mode == "compat" else let(t, lambda x: outside(x, F.concat(match_spans(x, MD_LINK), match_spans(x, HTML_LINK))))
    raw_m = _rx_all(plain, RAW_LINK, 0)
    raw = _pairs(PATTERN_RAW, raw_m, raw_m)
    html = _pairs(PATTERN_HTML, _rx_all(t, HTML_LINK, 1), _rx_all(t, HTML_LINK, 2))
    return F.concat(md, raw, html)


def link_candidates(df: DataFrame, doc_col: str = "doc_id", text_col: str = "text", mode: str = "compat") -> DataFrame:
    """L1-L4: every match of the three patterns as ``(doc_id, pattern, pos,
    a, b)`` where ``(a, b)`` is the tuple the pattern yields (raw links give
    ``(m, m)``).  Ordered by ``(pattern, pos)``: Markdown, raw, HTML.
    ``fixed`` looks for raw links only outside of Markdown and HTML links."""
    # explode_outer + null filter: a plain explode lets the optimizer infer
    # size(...) > 0 and evaluate the three regex scans twice
    return (df.select(F.col(doc_col).alias("doc_id"), F.explode_outer(_matches(F.col(text_col), mode)).alias("m"))
            .filter(F.col("m").isNotNull())
            .select("doc_id", "m.pattern", "m.pos", "m.a", "m.b"))


def _oriented(pattern: Column, a: Column, b: Column, mode: str) -> tuple[Column, Column]:
    swap = (pattern == PATTERN_HTML) if mode == "fixed" else F.lit(False)
    url = py_strip(F.when(swap, a).otherwise(b))
    clean = sanitize_text(F.when(swap, b).otherwise(a))
    return url, F.when(clean == "", url).otherwise(clean)


def orient_links(cands: DataFrame, mode: str = "compat") -> DataFrame:
    """Read each pair as (text, url); trim the URL; a blank text falls
    back to the URL.  In ``compat`` HTML pairs stay in (href, anchor) order,
    so the anchor text is taken as the URL; ``fixed`` reads them right."""
    url, text = _oriented(F.col("pattern"), F.col("a"), F.col("b"), mode)
    return cands.select("doc_id", "pattern", "pos", url.alias("url"), text.alias("text"))


def valid_links(oriented: DataFrame) -> DataFrame:
    """Keep URLs with both a scheme and an authority."""
    return oriented.filter(valid_url(F.col("url")))


def dedupe_links(valid: DataFrame) -> DataFrame:
    """One row per (doc, url): first position, last text."""
    key = F.struct("pattern", "pos")
    return (valid.groupBy("doc_id", "url")
            .agg(F.min(key).alias("first"), F.max_by("text", key).alias("text"))
            .select("doc_id", "url", "text",
                    F.col("first.pattern").alias("first_pattern"), F.col("first.pos").alias("first_pos")))


def unique_links(df: DataFrame, doc_col: str = "doc_id", text_col: str = "text",
                 mode: str = "compat") -> DataFrame:
    """L1-L7 in one call."""
    return dedupe_links(valid_links(orient_links(link_candidates(df, doc_col, text_col, mode), mode)))


def render_links(df: DataFrame, doc_col: str = "doc_id", text_col: str = "text",
                 mode: str = "compat") -> DataFrame:
    """``(doc_id, content)`` for every input document: ``- [text](url)``
    lines in first-position order, or the fixed messages for an empty input
    and for a text without valid links.

    One scan and one shuffle: a text without matches keeps a row of its own
    through the generator, and both groupings share the partitions by
    document.  Rows with one doc_id are one document."""
    t = F.col(text_col)
    rows = df.select(F.col(doc_col).alias("doc_id"), (F.coalesce(t, F.lit("")) == "").alias("empty"), F.explode_outer(_matches(t, mode)).alias("m"))
    url, text = _oriented(F.col("m.pattern"), F.col("m.a"), F.col("m.b"), mode)
    rows = rows.select("doc_id", "empty", F.struct("m.pattern", "m.pos").alias("key"), F.when(F.col("m").isNotNull(), F.struct(url.alias("url"), text.alias("text"))).alias("l"))
    rows = rows.select("doc_id", "empty", "key", F.when(valid_url(F.col("l.url")), F.col("l")).alias("l")).repartition("doc_id")
    uniq = (rows.groupBy("doc_id", F.col("l.url").alias("url"))
            .agg(F.min("key").alias("first"), F.max_by("l.text", "key").alias("text"), F.min("empty").alias("empty")))
    line = F.concat(F.lit("- ["), F.col("text"), F.lit("]("), F.col("url"), F.lit(")"))
    lines = F.array_sort(F.collect_list(F.when(F.col("url").isNotNull(), F.struct("first", line.alias("l")))))
    rendered = uniq.groupBy("doc_id").agg(F.min("empty").alias("empty"), F.array_join(F.transform(lines, lambda x: x["l"]), "\n").alias("rendered"))
    return rendered.select("doc_id", F.when(F.col("empty"), F.lit(NO_INPUT)).when(F.col("rendered") == "", F.lit(NO_VALID)).otherwise(F.col("rendered")).alias("content"))
