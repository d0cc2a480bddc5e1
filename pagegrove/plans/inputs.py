"""Inputs derived from the driver tables, built the same way in Spark and in
the DuckDB oracle.  Every derived input is a function of ``pages`` rows, so
its size grows with the data; none is bounded to one task (per page or per
host rows, never one concatenated corpus)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrove.functions.urls import url_host
from pagegrove.plans.sqlfrag import NL, TITLE_RAW, host, q, scheme_host

TITLE_RX = r"<title>([^<]*)</title>"
SCHEME_HOST_RX = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)"


def _link_lines() -> Column:
    t = F.regexp_extract("html", TITLE_RX, 1)
    u = F.col("url")
    return F.concat_ws("\n", F.concat(F.lit("["), t, F.lit("]("), u, F.lit(")")), u,
                       F.concat(F.lit('<a href="'), u, F.lit('">'), t, F.lit("</a>")))


def link_text(pages: DataFrame) -> DataFrame:
    """Per page: ``[title](url)``, ``url``, ``<a href="url">title</a>``."""
    return pages.select(F.col("page_id").alias("doc_id"), _link_lines().alias("text"))


LINK_TEXT_SQL = (
    f"SELECT page_id AS doc_id, concat_ws({NL}, '[' || t || '](' || url || ')', url, "
    f"'<a href=\"' || url || '\">' || t || '</a>') AS text "
    f"FROM (SELECT page_id, url, {TITLE_RAW} AS t FROM pages)")


#: Lines with links beside and inside other links; {h} scheme and host, {i} the page's id.
MIXED_LINES = ["see {h}/raw-{i}, [rel](/rel/{i}){h}/tail-{i}", '<a href="/r/{i}">{h}/inside-{i}</a>', "{h}/cut-{i}[B {i}]({h}/b/{i})", "[ ]( {h}/c/{i} )"]


def mixed_link_text(pages: DataFrame) -> DataFrame:
    """The lines of ``link_text``, then the mixed ones."""
    more = F.replace(F.replace(F.lit("\n".join(MIXED_LINES)), F.lit("{h}"), F.regexp_extract("url", SCHEME_HOST_RX, 1)), F.lit("{i}"), F.col("page_id").cast("string"))
    return pages.select(F.col("page_id").alias("doc_id"), F.concat_ws("\n", _link_lines(), more).alias("text"))


def url_requests(pages: DataFrame) -> DataFrame:
    """Per page one request list: ``- [title](url)``, bare ``url``, a blank
    line, ``see url`` (skipped) and one URL absent from ``pages``."""
    t = F.regexp_extract("html", TITLE_RX, 1)
    u = F.col("url")
    missing = F.concat(F.lower(F.regexp_extract(u, SCHEME_HOST_RX, 1)), F.lit("/missing-"),
                       F.col("page_id").cast("string"))
    text = F.concat_ws("\n", F.concat(F.lit("- ["), t, F.lit("]("), u, F.lit(")")), u, F.lit(""),
                       F.concat(F.lit("see "), u), missing)
    return pages.select(F.col("page_id").alias("request_id"), text.alias("text"))


URL_REQUESTS_SQL = (
    f"SELECT page_id AS request_id, concat_ws({NL}, '- [' || t || '](' || url || ')', url, '', "
    f"'see ' || url, {scheme_host('url')} || '/missing-' || CAST(page_id AS VARCHAR)) AS text "
    f"FROM (SELECT page_id, url, {TITLE_RAW} AS t FROM pages)")

# --- Fixed values: robots text published for every host ---------------------
ROBOTS_TEXT = "User-agent: *\nAllow: /en/\nDisallow: /"
# ---------------------------------------------------------------------------


def robots_texts(pages: DataFrame) -> DataFrame:
    """One robots.txt per host seen in ``pages``."""
    return (pages.select(url_host(F.col("url")).alias("host")).distinct()
            .select("host", F.lit(ROBOTS_TEXT).alias("robots_txt")))


ROBOTS_TEXTS_SQL = f"SELECT DISTINCT {host('url')} AS host, {q(ROBOTS_TEXT)} AS robots_txt FROM pages"
