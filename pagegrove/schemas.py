"""Explicit schemas of the data model (no inference anywhere)."""

from pyspark.sql import types as T

PAGES = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
])

# One element of the per-page ``dom`` array.  node_id is the pre-order
# position (= array index), end_id the last descendant's node_id, so
# "d is a proper descendant of a" is ``a.node_id < d.node_id <= a.end_id``.
DOM_NODE = T.StructType([
    T.StructField("node_id", T.IntegerType()),
    T.StructField("parent_id", T.IntegerType()),
    T.StructField("end_id", T.IntegerType()),
    T.StructField("depth", T.IntegerType()),
    T.StructField("boiler", T.BooleanType()),   # inside a boilerplate element, or one
    T.StructField("li_id", T.IntegerType()),    # the nearest ``li`` around it, itself included
    T.StructField("tag", T.StringType()),
    T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
    T.StructField("text", T.StringType()),
])
DOM = T.ArrayType(DOM_NODE)

URL_PARTS = T.StructType([
    T.StructField(n, T.StringType())
    for n in ("scheme", "netloc", "path", "params", "query", "fragment")
])

LINKS = "doc_id long, url string, text string, first_pattern int, first_pos int"
SITE_INFO = "page_id long, url string, title string, description string"
MARKDOWN_FILES = "page_id long, url string, filename string, content string, status string"
LLMS_TXT = "page_id long, site string, homepage_url string, content string, status string"
ROBOTS_RULES = "host string, agent string, rule_no int, allow boolean, path_prefix string"
