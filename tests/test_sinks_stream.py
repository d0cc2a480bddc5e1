"""K1/K2 round trips and stream = batch."""

import os
import tempfile

from conftest import pages_df

from pyspark.sql import functions as F

from pagegrove.operators.dom import with_dom
from pagegrove.operators.markdown import page_markdown
from pagegrove.sources.sinks import exportable_llms, write_llms_txt, write_markdown
from pagegrove.streaming import stream as X


def test_export_guard(spark):
    df = spark.createDataFrame([(1, "a.com", "u", "ok text"), (2, "a.com", "u", "- [Error codes](x)"),
                                (3, "b.com", "u", "")], "page_id long, site string, homepage_url string, content string")
    assert [r.page_id for r in exportable_llms(df).collect()] == [1]


def test_sink_round_trip(spark):
    out = tempfile.mkdtemp(prefix="pagegrove-test-")
    df = spark.createDataFrame([(1, "a.com", "u", "doc a"), (2, "b.com", "u", "doc b")],
                               "page_id long, site string, homepage_url string, content string")
    write_llms_txt(df, os.path.join(out, "llms"))
    back = spark.read.parquet(os.path.join(out, "llms"))
    assert sorted((r.site, r.content) for r in back.collect()) == [("a.com", "doc a"), ("b.com", "doc b")]
    files = spark.createDataFrame([("a.md", "x")], "filename string, content string")
    assert write_markdown(files, os.path.join(out, "md"))
    assert not write_markdown(files.limit(0), os.path.join(out, "md2"))


def test_stream_equals_batch(spark):
    folder = tempfile.mkdtemp(prefix="pagegrove-stream-")
    df = pages_df(spark, ["<body><p>a</p></body>", "<body><article><h1>H</h1><p>b</p></article></body>"],
                  url=["https://x.com/a", "https://x.com/b"])
    df.write.mode("overwrite").parquet(os.path.join(folder, "in"))
    stream = X.read_page_stream(spark, os.path.join(folder, "in"), file_glob="*.parquet")
    streamed = X.run_to_table(spark, X.stream_page_markdown(stream), "t")
    batch = page_markdown(with_dom(df))
    assert sorted(map(tuple, streamed.collect())) == sorted(map(tuple, batch.collect()))


def test_first_seen_urls_across_files_and_restarts(spark):
    import time
    import uuid
    folder, run = tempfile.mkdtemp(prefix="pagegrove-urls-"), uuid.uuid4().hex
    rows = lambda urls: spark.createDataFrame([(i, u, None) for i, u in enumerate(urls)], "page_id long, url string, html string").coalesce(1)

    def arrive(urls, horizon="1 hour", run=run):
        rows(urls).write.mode("append").parquet(folder)
        s = X.read_page_stream(spark, folder, "*.parquet", 1).select("url")
        path, progress = X.drain(spark, X.first_seen_urls(s, horizon), "first_seen", run=run)
        return sorted(r.url for r in spark.read.schema("url string").parquet(path).collect()), progress
    assert arrive(["a", "b", "b"])[0] == ["a", "b"]
    got, progress = arrive(["b", "c", "a"])  # a new stream with the same name goes on
    assert got == ["a", "b", "c"]
    assert progress[-1].stateOperators[0].numRowsTotal == 3
    assert "rocksdb" in str(progress[-1].stateOperators[0].customMetrics)
    assert arrive(["c", "a", "d"])[0] == ["a", "b", "c", "d"]
    # with a short horizon state shrinks; what comes again after it is new
    folder, run = tempfile.mkdtemp(prefix="pagegrove-urls-"), uuid.uuid4().hex
    arrive([f"u{i}" for i in range(50)], "1 second", run)
    time.sleep(2)
    arrive(["x"], "1 second", run)
    time.sleep(2)
    got, progress = arrive(["y", "u3"], "1 second", run)
    assert got.count("u3") == 2 and got.count("u4") == 1
    assert min(p.stateOperators[0].numRowsTotal for p in progress) <= 3


def test_export_files_do_not_grow_as_tasks_times_sites(spark):
    out = tempfile.mkdtemp(prefix="pagegrove-test-")
    rows = [(i, f"s{i % 5}.com" if i % 3 else "hot.com", "u", os.urandom(500).hex()) for i in range(1200)]
    df = spark.createDataFrame(rows, "page_id long, site string, homepage_url string, content string").repartition(30)
    keys = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "128k"}
    for k, v in keys.items():
        spark.conf.set(k, v)
    write_llms_txt(df, os.path.join(out, "llms"))
    for k in keys:
        spark.conf.unset(k)
    files = {d: len([f for f in os.listdir(os.path.join(out, "llms", d)) if f.endswith(".parquet")]) for d in os.listdir(os.path.join(out, "llms")) if d.startswith("site=")}
    assert len(files) == 6 and sum(files.values()) < 60  # 30 tasks times 6 sites would be 180
    assert files["site=hot.com"] > 1  # a hot site is several tasks' work
    assert spark.read.parquet(os.path.join(out, "llms")).count() == 1200


def test_export_plan_has_one_python_node(spark):
    from pagegrove.operators.nav import nav_tree
    df = pages_df(spark, ["<body><nav><a href='/a'>Aa</a></nav></body>", "<body><nav><a href='/e'>Error</a></nav></body>"])
    tree = nav_tree(with_dom(df), "nav").select("page_id", F.lit("s").alias("site"), F.col("url").alias("homepage_url"), F.col("nav_md").alias("content"))
    got = exportable_llms(tree)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "MapInArrow" not in plan
    assert [r.page_id for r in got.collect()] == [0] and got.columns == tree.columns


def test_file_set_keeps_texts_out_of_the_aggregate(spark):
    from pagegrove.operators.markdown import file_set
    rows = [("a.md", 1, 1, "first"), ("a.md", 1, 2, "last"), ("b.md", 2, 1, "only"), ("a.md", 0, 9, "early"), ("c.md", 3, 3, "same"), ("c.md", 3, 3, "same")]
    got = file_set(spark.createDataFrame(rows, "filename string, request_id long, line_no int, content string"))
    assert sorted((r.filename, r.content) for r in got.collect()) == [("a.md", "last"), ("b.md", "only"), ("c.md", "same")]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "content" not in "".join(line for line in plan.splitlines() if "Aggregate" in line)


def test_homepage_parameters(spark):
    import pytest

    from pagegrove.operators.nav import homepage_llms, llms_document, nav_tree
    html = "<html><head><title>T</title></head><body><nav><a href='/a'>Aa</a></nav></body></html>"
    df = pages_df(spark, [html, html, html], url=["https://x.com/", None, ""])
    assert [r.content for r in homepage_llms(df, "https://x.com/", "nav").collect()] == ["# T\n\n> No Description\n\n## Navigation\n\n- [Aa](https://x.com/a)\n"]
    for bad in (("", "nav"), ("https://x.com/", "")):
        with pytest.raises(ValueError, match="Provide homepage URL"):
            homepage_llms(df, *bad)
    rows = nav_tree(with_dom(df), "nav").select("page_id", "status", llms_document(F.lit("t"), F.lit("d"), F.col("nav_md"), F.col("status")).alias("content")).collect()
    assert [r.status for r in sorted(rows)] == ["ok", "missing_params", "missing_params"]
    assert all(r.content.startswith("Error: Provide") for r in rows if r.status != "ok")


def test_fixed_raw_links_lie_outside_of_other_links(spark):
    from pagegrove.operators.links import render_links
    cases = [("[A](https://x.com/a)", "- [A](https://x.com/a)"), ('<a href="https://x.com/a">A</a> https://y.com', "- [https://y.com](https://y.com)\n- [A](https://x.com/a)"),
             ("https://a.com/[B](https://b.com)https://c.com", "- [B](https://b.com)\n- [https://a.com/](https://a.com/)\n- [https://c.com](https://c.com)"),
             ('<a href="https://x.com"><b>[in](https://in.com)</b></a>', "- [in](https://in.com)\n- [<b>[in](https://in.com)</b>](https://x.com)"),
             ("[A](/r) https://x.com [B](/s)", "- [https://x.com](https://x.com)"), ("", "No input provided"), (None, "No input provided"), ("x", "No valid links found.")]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r.content for r in render_links(df, mode="fixed").collect()}
    for i, (_, want) in enumerate(cases):
        assert got[i] == want, cases[i]
    plan = render_links(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("Scan") == 1
