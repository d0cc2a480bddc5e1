"""Goldens for N1-N9, T1-T8 (FIXTURES 2.6) and robots (2.8)."""

import pytest
from conftest import pages_df

from pagegrove.operators.dom import with_dom
from pagegrove.operators.nav import check_params, nav_tree
from pagegrove.operators.site import allowed_urls, parse_robots


def nav(x):
    return f"<html><body><nav><ul>{x}</ul></nav></body></html>"


CASES = [
    (nav('<li><a href="/a">Alpha</a><ul><li><a href="/b">Beta</a></li></ul></li>'),
     "- [Alpha](https://x.com/a)\n  - [Beta](https://x.com/b)\n- [Beta](https://x.com/b)\n", "ok"),
    (nav('<li><a href="/a">Alpha</a><ul><li><a href="/b">Beta</a><ul><li><a href="/c">Gamma</a></li></ul></li></ul></li>'),
     "- [Alpha](https://x.com/a)\n  - [Beta](https://x.com/b)\n    - [Gamma](https://x.com/c)\n  - [Gamma](https://x.com/c)\n"
     "- [Beta](https://x.com/b)\n  - [Gamma](https://x.com/c)\n- [Gamma](https://x.com/c)\n", "ok"),
    ('<nav><ul><li><a href="/a">Alpha</a></li></ul></nav><nav><ul><li><a href="/a">Alpha</a></li></ul></nav>',
     "- [Alpha](https://x.com/a)\n", "ok"),
    (nav('<li><a href="c">Ccc</a></li><li><a href="/für">Für</a></li><li><a href="#top">Top</a></li>'
         '<li><a href="/q?x=1">Query</a></li>'),
     "- [Ccc](https://x.com/en/c)\n- [Für](https://x.com/f%C3%BCr)\n- [Top](https://x.com/en/#top)\n"
     "- [Query](https://x.com/q?x=1)\n", "ok"),
    (nav('<li><a href="javascript:void(0)">JS</a></li><li><a href="mailto:a@b.c">Mail</a></li>'
         '<li><a href="/javascript-guide">Guide</a></li>'), "", "ok"),
    (nav('<li><a href="/' + "p" * 99 + '">Long</a></li><li><a href="/' + "q" * 100 + '">Longer</a></li>'),
     "- [Long](https://x.com/" + "p" * 99 + ")\n", "ok"),
    (nav('<li><a href="/x">A</a><ul><li><a href="/s">Sub</a></li></ul></li><li><a href="/h">Home</a></li>'
         '<li><a href="/k">CLICK HERE</a></li>'), "- [Sub](https://x.com/s)\n", "ok"),
    (nav('<li><a href="/a" aria-label="Lab">Txt</a></li><li><a href="/b" title="Tip"><img></a></li>'
         '<li><a href="/c"></a></li><li><a>no href</a></li>'),
     "- [Lab](https://x.com/a)\n- [Tip](https://x.com/b)\n- [Untitled Link](https://x.com/c)\n", "ok"),
    (nav('<li><a href="/a">Aa</a><ul><a href="/b">Bb</a></ul></li>'), "", "cyclic_nav"),
    ("<html><body><div>nothing</div></body></html>", "", "no_nav"),
]


def test_nav_goldens(spark):
    df = pages_df(spark, [h for h, _, _ in CASES])
    got = {r.page_id: (r.nav_md, r.status) for r in nav_tree(with_dom(df), "nav").collect()}
    for i, (_, md, status) in enumerate(CASES):
        assert got[i] == (md, status), i


def test_context_selector_and_user_root(spark):
    html = ('<html><body><div id="side"><ul><li><button>Buy</button><ul><li><a href="/p">Prod</a></li></ul></li></ul>'
            '</div><nav><ul><li><a href="/n">Navi</a></li></ul></nav></body></html>')
    df = pages_df(spark, [html])
    r = nav_tree(with_dom(df), "#side", "button, a[href]").collect()[0]
    assert "- Buy\n  - [Prod](https://x.com/p)\n" in r.nav_md
    assert "- [Navi](https://x.com/n)\n" in r.nav_md


def test_tree_mode_keeps_each_link_once(spark):
    df = pages_df(spark, [CASES[1][0]])
    r = nav_tree(with_dom(df), "nav", mode="tree").collect()[0]
    assert r.nav_md == ("- [Alpha](https://x.com/a)\n  - [Beta](https://x.com/b)\n"
                        "    - [Gamma](https://x.com/c)\n")


def test_required_params():
    with pytest.raises(ValueError):
        check_params("https://x.com", "")


ROBOTS = [
    ("", "/a", True),
    ("User-agent: *\nDisallow: /a", "/a/b", False),
    ("User-agent: *\nAllow: /a/b\nDisallow: /a", "/a/b/c", True),
    ("User-agent: *\nDisallow: /a\nAllow: /a/b", "/a/b/c", False),
]


def test_robots(spark):
    texts = spark.createDataFrame([(f"h{i}.com", t) for i, (t, _, _) in enumerate(ROBOTS)], "host string, robots_txt string")
    urls = spark.createDataFrame([(i, f"https://h{i}.com{p}") for i, (_, p, _) in enumerate(ROBOTS)], "page_id long, url string")
    got = {r.page_id: r.allowed for r in allowed_urls(urls, parse_robots(texts)).collect()}
    assert got == {i: e for i, (_, _, e) in enumerate(ROBOTS)}
