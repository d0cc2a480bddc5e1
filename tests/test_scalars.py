"""Goldens for F2, L1-L8, S2 and U2 (FIXTURES 2.1-2.3, 2.7)."""

from pyspark.sql import functions as F

from pagegrove.functions.text import sanitize_filename, sanitize_text, split_lines
from pagegrove.functions.urls import resolve_href
from pagegrove.operators.links import render_links
from pagegrove.sources.url_list import parse_url_list

FILENAMES = [
    ("https://x.com/a/b?c=d", "a_b_c_d.md"), ("https://x.com", "md"), ("https://x.com/", "md"),
    ("https://x.com?q=1", "md"), ("https://x.com/readme.md", "readme.md"),
    ("https://x.com/a-b.html", "a-b.html.md"), ("https://x.com/für", "für.md"),
    ("HTTPS://x.com/a", "HTTPS_x.com_a.md"), ("https://x.com/" + "a" * 300, "a" * 199 + ".md"),
    ("https://x.com/a_error", "a_error.md"), ("https://x.com_error", "md"),
    ("https://x.com/_error", "error.md"), ("/rel_error", "rel_error.md"),
]


def test_sanitize_filename(spark):
    df = spark.createDataFrame(FILENAMES, "u string, e string")
    for r in df.select("e", sanitize_filename("u").alias("f")).collect():
        assert r.f == r.e
        assert len(r.f) <= 203


def test_sanitize_text_idempotent(spark):
    df = spark.createDataFrame([(" a \t b　 ",), (None,), ("x  y",)], "s string")
    out = df.select(sanitize_text("s").alias("a")).select("a", sanitize_text("a").alias("b")).collect()
    assert [r.a for r in out] == ["a b", "", "x y"]
    assert all(r.a == r.b for r in out)


def test_split_lines(spark):
    df = spark.createDataFrame([("a\nb\r\n\nc\n",), ("",)], "s string")
    assert [r.x for r in df.select(split_lines("s").alias("x")).collect()] == [["a", "b", "", "c"], []]


LINKS = [
    ("[A](https://x.com/a)", "- [A](https://x.com/a)\n- [https://x.com/a)](https://x.com/a))"),
    ('<a href="https://x.com/a">A</a>', '- [https://x.com/a">A</a>](https://x.com/a">A</a>)'),
    ('<a href="https://x.com/a">Site A</a>', '- [https://x.com/a">Site](https://x.com/a">Site)'),
    ('<a href="https://x.com">https://y.com</a>',
     '- [https://x.com">https://y.com</a>](https://x.com">https://y.com</a>)\n- [https://x.com](https://y.com)'),
    ('<a class="k" href="https://x.com">https://y.com</a>',
     '- [https://x.com">https://y.com</a>](https://x.com">https://y.com</a>)'),
    ("[A](https://x.com) [B](https://x.com)", "- [B](https://x.com)\n- [https://x.com)](https://x.com))"),
    ("[](https://x.com)", "- [https://x.com](https://x.com)\n- [https://x.com)](https://x.com))"),
    ("[A]( https://x.com )", "- [https://x.com](https://x.com)"),
    ('[A](https://x.com "t")', '- [A](https://x.com "t")\n- [https://x.com](https://x.com)'),
    ("[a [b](https://x.com)", "- [a [b](https://x.com)\n- [https://x.com)](https://x.com))"),
    ("[A\nB](https://x.com)", "- [https://x.com)](https://x.com))"),
    ("https://x.com/a, https://x.com/a", "- [https://x.com/a,](https://x.com/a,)\n- [https://x.com/a](https://x.com/a)"),
    ("[A](ftp://h/f)", "- [A](ftp://h/f)"),
    ("[A](mailto:a@b.c) [A](/rel) HTTP://X.com", "No valid links found."),
    ("", "No input provided"),
]


def test_render_links(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(LINKS)], "doc_id long, text string")
    got = {r.doc_id: r.content for r in render_links(df).collect()}
    for i, (_, exp) in enumerate(LINKS):
        assert got[i] == exp, (LINKS[i][0], got[i])


URL_LINES = [
    ("- [A](https://x.com/a)", "https://x.com/a"), ("  https://x.com/b  ", "https://x.com/b"),
    ("https://x.com/b trailing", "https://x.com/b trailing"), ("see https://x.com/c", None),
    ("[A](/rel)", "/rel"), ("https://x.com/a [B](https://y.com)", "https://y.com"),
    ("[A](https://x.com) [B](https://y.com)", "https://x.com"), ("", None),
]


def test_parse_url_list(spark):
    text = "\n".join(line for line, _ in URL_LINES)
    df = spark.createDataFrame([(1, text)], "request_id long, text string")
    got = {r.line_no: r.url for r in parse_url_list(df).collect()}
    exp = {i: u for i, (_, u) in enumerate(URL_LINES) if u is not None}
    assert got == exp


JOINS = [("c", "https://h/a/c"), ("./c", "https://h/a/c"), ("../c", "https://h/c"), ("../../c", "https://h/c"),
         ("/c", "https://h/c"), ("//k/c", "https://k/c"), ("?y", "https://h/a/b?y"), ("#s", "https://h/a/b?q#s"),
         ("", "https://h/a/b?q"), ("http://k/c", "http://k/c"), ("/für", "https://h/f%C3%BCr")]


def test_resolve_href(spark):
    df = spark.createDataFrame([("https://h/a/b?q#f", h, e) for h, e in JOINS], "b string, h string, e string")
    for r in df.select("h", "e", resolve_href("b", "h").alias("r")).collect():
        assert r.r == r.e, r.h


def test_links_plan_is_native(spark):
    df = spark.createDataFrame([(1, "[A](https://x.com/a)")], "doc_id long, text string")
    plan = render_links(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ArrowEval" not in plan
    assert F is not None
