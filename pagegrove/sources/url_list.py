"""Newline-delimited URL lists -> one row per requested URL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegrove.functions.text import py_strip, split_lines

# --- Fixed values -----------------------------------------------------------
FIRST_MD_TARGET = r"\[[^\n]*?\]\(([^\n]*?)\)"
URL_PREFIXES = ("http://", "https://")
# ---------------------------------------------------------------------------


def parse_url_list(df: DataFrame, text_col: str = "text", id_col: str = "request_id") -> DataFrame:
    """``(request_id, line_no, url)``: each non-blank, stripped line gives
    the target of its first Markdown link, else the whole line when it starts
    with ``http://``/``https://``, else nothing.  Targets are not validated
    and duplicates are kept.  ``line_no`` is the 0-based line position."""
    lines = df.select(F.col(id_col).alias("request_id"),
                      F.posexplode(split_lines(F.col(text_col))).alias("line_no", "raw"))
    line = py_strip(F.col("raw"))
    url = (F.when(line.rlike(FIRST_MD_TARGET), F.regexp_extract(line, FIRST_MD_TARGET, 1))
           .when(line.startswith(URL_PREFIXES[0]) | line.startswith(URL_PREFIXES[1]), line))
    return (lines.select("request_id", "line_no", F.when(line != "", url).alias("url"))
            .filter(F.col("url").isNotNull()))
