"""Goldens for D1-D9, P1-P3, H1-H3 (FIXTURES 2.4, 2.5) and invariants."""

from conftest import pages_df

from pagegrove.operators.dom import parse_html, with_dom
from pagegrove.operators.markdown import file_set, page_markdown
from pagegrove.operators.siteinfo import site_info

MD = [
    ('<html><head><title>T</title><meta name="description" content="D"></head><body><main><h1>Hi <b>there</b></h1>'
     '<p>One <i>two</i></p><p> </p><p>3</p></main></body></html>', "# Untitled Page\n\n## Hithere\n\nOnetwo\n\n3\n"),
    ('<html><title>T</title><meta name="description" content="D"><body><p>x</p></body></html>',
     "# Page Description\n\nD\n\n# T\n\nx\n"),
    ("<body><svg><title>Icon</title></svg><p>x</p></body>", "# Icon\n\nx\n"),
    ("<body><p>a<p>b</p></body>", "# Untitled Page\n\nab\n\nb\n"),
    ("<article><p>x</p></article>", "# Untitled Page\n\nx\n"),
    ("<body><p>out</p><article><p>in</p></article><main><p>m</p></main></body>", "# Untitled Page\n\nin\n"),
    ("<body><article><header><h1>H</h1></header><p>x</p></article></body>", "# Untitled Page\n\nx\n"),
    ("<body><p>x</p><h2>B</h2><h4>C</h4></body>", "# Untitled Page\n\n## B\n\nx\n"),
    ("<body><p>1</p><p></p><p>3</p><p></p><p>5</p><p>6</p></body>", "# Untitled Page\n\n1\n\n3\n\n5\n"),
    ("<p>x</p>", None),
    ("<html><head><title>T</title><body><p>x</p></body></html>", None),
]


def test_page_markdown_goldens(spark):
    df = pages_df(spark, [h for h, _ in MD], url=[f"https://x.com/p{i}" for i in range(len(MD))])
    out = {r.page_id: r for r in page_markdown(with_dom(df)).collect()}
    for i, (_, exp) in enumerate(MD):
        r = out[i]
        if exp is None:
            assert r.status == "error"
            assert r.content.startswith(f"Error processing https://x.com/p{i}: ")
            assert r.filename == f"p{i}_error.md"
        else:
            assert r.status == "ok" and r.content == exp, (i, r.content)
            assert r.content.count("\n\n") <= 5 + 3


INFO = [
    ('<title> A  B </title><meta name="description" content=" D ">', ("A B", "D")),
    ("<h1>H <b>x</b></h1>", ("H x", "No Description")),
    ("<title>a<b>c</b></title><h1>H</h1>", ("H", "No Description")),
    ('<meta property="og:description" content="O">', ("No Title", "O")),
    ('<meta property="og:description" content="O"><meta name="description" content="N">', ("No Title", "N")),
    ('<meta name="description">', ("No Title", "No Description")),
    ('<meta name="description" content="">', ("No Title", "")),
]


def test_homepage_info(spark):
    df = pages_df(spark, [h for h, _ in INFO])
    got = {r.page_id: (r.title, r.description) for r in site_info(with_dom(df)).collect()}
    assert [got[i] for i in range(len(INFO))] == [e for _, e in INFO]


def test_missing_page_defaults(spark):
    df = spark.createDataFrame([(1, "https://x.com/a", None)], "page_id long, url string, html string")
    r = site_info(with_dom(df)).collect()[0]
    assert (r.title, r.description) == ("No Title", "No Description")


def test_tree_rules():
    nodes = parse_html('<p>a<p>b</p></p><br><br></br><script>var t="</p>";</script><div/>x')
    tags = [n["tag"] for n in nodes]
    assert tags[:5] == ["#document", "p", "#text", "p", "#text"]
    p2 = nodes[3]
    assert p2["parent_id"] == 1  # no implied </p>: nested
    br = [n for n in nodes if n["tag"] == "br"]
    assert all(n["end_id"] == n["node_id"] for n in br)  # void elements hold nothing
    script_text = [n for n in nodes if n["tag"] == "#rawtext"]
    assert script_text and '"</p>"' in script_text[0]["text"]
    for m in nodes:  # the interval encoding matches the parents
        around, at = set(), m["parent_id"]
        while at is not None:
            around.add(at)
            at = nodes[at]["parent_id"]
        assert around == {n["node_id"] for n in nodes if n["node_id"] < m["node_id"] <= n["end_id"]}
        assert m["depth"] == len(around)


def test_page_size_is_no_matter(spark):
    """20,000 unclosed paragraphs and 4,000 headings: whole texts, nodes of fixed size."""
    deep = "<body>" + "<p>x" * 20_000
    wide = "<body><nav><h2>no</h2></nav>" + "".join(f"<h2>t{i}<aside>no</aside></h2>" for i in range(4_000))
    df = spark.createDataFrame([(1, "https://h/a", deep), (2, "https://h/b", wide)], "page_id long, url string, html string")
    got = {r.page_id: r.content for r in page_markdown(with_dom(df)).collect()}
    assert got[1].split("\n\n")[1] == "x" * 20_000
    assert [line for line in got[2].split("\n") if line.startswith("##")] == [f"## t{i}" for i in range(4_000)]
    assert got[2].count("no") == 0


def test_file_set_last_wins(spark):
    df = spark.createDataFrame([("a.md", 1, 0, "first"), ("a.md", 1, 3, "second"), ("b.md", 2, 0, "b")],
                               "filename string, request_id long, line_no int, content string")
    got = {r.filename: r.content for r in file_set(df).collect()}
    assert got == {"a.md": "second", "b.md": "b"}


def test_parsed_pages_leave_a_task_in_bounded_arrays(spark):
    """One batch of 3,000 pages: each array holds few nodes or little text, every page keeps its place."""
    import pyarrow as pa

    from pagegrove.operators import htmltree
    htmls = [f"<p>{i}</p>" * (i % 90) + "x" * (i % 7) * 1000 for i in range(3_000)]
    htmls[5], htmls[7] = None, ""
    arrays = list(htmltree.dom_chunks(iter([pa.array(htmls[:2_900]), pa.array([], pa.string()), pa.array(htmls[2_900:])])))
    rows = [r for a in arrays for r in a.to_pylist(maps_as_pydicts="strict")]
    assert rows == [parse_html(h) for h in htmls]
    assert max(len(a.flatten()) for a in arrays) < htmltree.CHUNK_NODES + 300 and 10 < len(arrays) < 100

    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    try:
        got = with_dom(pages_df(spark, htmls).coalesce(1)).selectExpr("page_id", "size(dom) AS n", "get(dom, 2).text AS text").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    want = [parse_html(h) for h in htmls]
    assert [(r.page_id, r.n, r.text) for r in sorted(got)] == [
        (i, len(d), d[2]["text"] if len(d) > 2 else None) if d else (i, None, None) for i, d in enumerate(want)]


def test_parse_memory_does_not_grow_with_the_batch():
    """Four times as many pages in one batch: the parse holds no more at its peak."""
    import tracemalloc

    import pyarrow as pa

    from pagegrove.operators import htmltree
    page = "<body>" + "<p class='c'>x<b>y</b></p>" * 40
    peaks = []
    for n in (600, 2_400):
        batch = pa.array([page] * n)
        tracemalloc.start()
        assert sum(len(a) for a in htmltree.dom_chunks(iter([batch]))) == n
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.2 * peaks[0], peaks
