"""H1-H3: homepage title and description, read from the untouched tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagegrove.functions.text import cached_expr, py_strip, sanitize_text
from pagegrove.operators.dom import element_string, element_text, first_node, meta_content

# --- Fixed values -----------------------------------------------------------
NO_TITLE = "No Title"
NO_DESCRIPTION = "No Description"
# ---------------------------------------------------------------------------


def page_title(dom="dom") -> Column:
    """H1: only-string of the first ``title`` (when non-empty), else the
    text of the first ``h1``, else 'No Title'; whitespace-normalised."""
    t = first_node(dom, lambda n: n["tag"] == "title")
    s = element_string(dom, t)
    h1 = first_node(dom, lambda n: n["tag"] == "h1")
    raw = (F.when(t.isNotNull() & s.isNotNull() & (s != ""), py_strip(s))
           .when(h1.isNotNull(), element_text(dom, h1, strip=False))
           .otherwise(F.lit(NO_TITLE)))
    return sanitize_text(raw)


def page_description(dom="dom") -> Column:
    """H2: ``meta[name=description]`` else ``meta[property=og:description]``;
    a missing element or ``content`` attribute gives 'No Description'."""
    m = F.coalesce(meta_content(dom, "name", "description"),
                   meta_content(dom, "property", "og:description"))
    content = F.when(m.isNull(), F.lit(NO_DESCRIPTION)).otherwise(
        F.coalesce(m["attrs"]["content"], F.lit(NO_DESCRIPTION)))
    return sanitize_text(py_strip(content))


def site_info(pages_dom: DataFrame) -> DataFrame:
    """``(page_id, url, title, description)``; H3: a page without a tree
    (missing HTML) gets both defaults."""
    t, d = cached_expr(("site_info",), lambda: (page_title("dom"), page_description("dom")))
    return pages_dom.select(
        "page_id", "url",
        F.when(F.col("dom").isNull(), F.lit(NO_TITLE)).otherwise(t).alias("title"),
        F.when(F.col("dom").isNull(), F.lit(NO_DESCRIPTION)).otherwise(d).alias("description"),
    )
