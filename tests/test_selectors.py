"""D10/D11 selector subset and L5 fixed mode."""

import pytest
from conftest import pages_df
from pyspark.sql import functions as F

from pagegrove.operators.dom import with_dom
from pagegrove.operators.links import render_links
from pagegrove.operators.selectors import compile_selector, detect_site_type, matches

HTML = ('<html><body><header><nav id="top-nav" class="main nav"><a href="/a" data-test="menu-a">A</a></nav></header>'
        '<div class="ReactModal__Overlay"><ul><li><a href="#x">X</a></li></ul></div>'
        '<a href="//ext.com/y" title="ext">Y</a></body></html>')


@pytest.mark.parametrize("sel,expected_tags", [
    ("header nav", ["nav"]),
    ("nav > a", ["a"]),
    ("#top-nav", ["nav"]),
    (".nav", ["nav"]),
    ('[data-test^="menu"]', ["a"]),
    ('a[href]:not([href^="#"])', ["a", "a"]),
    ('[class*="nav"], li', ["nav", "li"]),
    ('[href$="y"]', ["a"]),
])
def test_selector_subset(spark, sel, expected_tags):
    df = with_dom(pages_df(spark, [HTML]))
    ids = df.select(matches("dom", sel).alias("ids"), "dom").collect()[0]
    assert [ids.dom[i].tag for i in ids.ids] == expected_tags


def test_unsupported_selector_raises():
    with pytest.raises(ValueError):
        compile_selector("a + b")
    with pytest.raises(ValueError):
        compile_selector("")


def test_site_type_flags(spark):
    df = with_dom(pages_df(spark, [HTML], url="https://shop.lego.com/x"))
    f = df.select(detect_site_type("dom", "url").alias("f")).collect()[0].f
    assert f.react and f.lego and not f.vue and not f.shopify


def test_fixed_mode_reads_html_links_right(spark):
    df = spark.createDataFrame([(1, '<a href="https://x.com/a">Site A</a>')], "doc_id long, text string")
    got = render_links(df, mode="fixed").collect()[0].content
    assert "- [Site A](https://x.com/a)" in got.split("\n")
    assert F is not None


def walk_up(spark, df, selector):
    """Ids by the predicate that walks up from each node."""
    from pagegrove.operators.selectors import compile_selector
    pred = compile_selector(selector, "dom")
    return {r.page_id: r.x for r in df.select("page_id", F.transform(F.filter("dom", pred), lambda n: n["node_id"]).alias("x")).collect()}


def test_flags_of_a_page_equal_the_walk_up(spark):
    import random
    r = random.Random(6)

    def tree(depth):
        return "".join(f"<{t} class='{r.choice('pqr')}'>{tree(depth - 1) if depth and r.random() < 0.7 else ''}</{t}>" for t in r.choices("abcd", k=r.randrange(1, 4)))
    df = with_dom(pages_df(spark, [tree(6) for _ in range(30)] + ["", None, "<a>", "<a><b><c>"])).cache()
    for selector in ("a b", "a > b", "a b c", "a > b c", "a b > c", "a > b > c", ".p a .q", "a, b c, d > *", "* * *", "a b:not(.p) c", "a .p > .q d"):
        got = {x.page_id: x.m for x in df.select("page_id", matches("dom", selector).alias("m")).collect()}
        assert got == walk_up(spark, df, selector), selector
    df.unpersist()


def test_steps_grow_with_the_nodes(spark):
    import time
    from pagegrove.operators.htmltree import parse_html  # noqa: F401
    took = []
    for n in (2_500, 20_000):
        df = with_dom(pages_df(spark, ["<a>" * n + "<b>" * n + "<c>" * n])).select("dom").cache()
        df.count()
        start = time.perf_counter()
        assert df.select(F.size(matches("dom", "a b c"))).first()[0] == n
        took.append(time.perf_counter() - start)
        df.unpersist()
    assert took[1] < 30 * max(took[0], 0.2)  # eight times the nodes; a walk up takes 500 times as long


def test_user_selectors_with_combinators(spark):
    from pagegrove.operators.nav import nav_tree
    html = '<body><div id="m"><p><span><a href="/x">Inside</a></span></p><a href="/y">Beside</a></div><nav><a href="/z">Nav</a></nav></body>'
    got = nav_tree(with_dom(pages_df(spark, [html])), "body > #m", "p a, nav > a").first()
    assert got.nav_md == "- [Inside](https://x.com/x)\n- [Nav](https://x.com/z)\n" and "root_flags" not in got.asDict()
