"""U2 against goldens and R8/R9 against the standard library's parser."""

from itertools import product
from urllib.parse import quote, unquote, urlparse, urlunparse
from urllib.robotparser import RobotFileParser

from pagegrove.functions.urls import py_quote, py_unquote, py_urlunparse, resolve_href, url_parts
from pagegrove.operators.site import allowed_urls, parse_robots, robots_guidance
from pagegrove.plans.robots import AGENT, REFERENCES

BASE = "https://User@H.example/a/b?q#f"
RESOLVED = [
    (r"?q=a\b", r"https://User@h.example/a/b?q=a\b"), (r"#a\b", r"https://User@h.example/a/b?q#a\b"), (r"\x\y?z=\w#\v", r"https://User@h.example/x/y?z=\w#\v"),
    (r"\\K\c", "https://k/c"), ("///k/d", "https://k/d"), ("//k//d", "https://k//d"),
    ("https://User:Pw@H/", "https://User:Pw@h/"), ("http://User:Pw@H:80/X", "http://User:Pw@h/X"), ("https://u@H:8443", "https://u@h:8443/"),
    ("https://:p@h/", "https://:p@h/"), ("https://@h/", "https://h/"), ("https://u:@h/", "https://u@h/"), ("https://a@b@h/x", "https://a%40b@h/x"),
    ("https://ü[:p|w@h/", "https://%C3%BC%5B:p%7Cw@h/"),
    ("https://h:443/", "https://h/"), ("https://h:/x", "https://h/x"), ("https://h:0443/x", "https://h/x"), ("https://h:080/x", "https://h:80/x"),
    ("https://h:99999/x", "https://h:99999/x"), ("https://h:8x/", "https://h:8x/"), ("https://a b/", "https://a b/"), ("http://", "http://"), (" http:// ", " http:// "),
    ("https:c", "https://User@h.example/a/c"), ("https:/c", "https://User@h.example/c"), ("https:?z", "https://User@h.example/a/b?z"), ("https:", "https://User@h.example/a/b?q"),
    ("http:c", "http://c/"), ("http:/c/d", "http://c/d"), ("HTTPS:///k/d", "https://k/d"), ("https://ex%41mple.com/%41", "https://example.com/%41"),
    ("https://a%2fb/", "https://a%2fb/"), ("http://[::1]:80/x", "http://[::1]/x"), ("http://[::1/x", "http://[::1/x"), ("file:///a/../b", "file:///b"),
    ("javascript:alert('x y')", "javascript:alert('x y')"), ("MAILTO:ü@x?s=a b", "mailto:%C3%BC@x?s=a%20b"), ("a:b@c", "a:b@c"), ("./a:b", "https://User@h.example/a/a:b"),
    (" \t/c\n ", "https://User@h.example/c"), ("a\nb", "https://User@h.example/a/ab"), ("?", "https://User@h.example/a/b?"), ("#", "https://User@h.example/a/b?q#"),
    ("", "https://User@h.example/a/b?q"), ("c?#", "https://User@h.example/a/c?#"), ("?a'b\"<>", "https://User@h.example/a/b?a%27b%22%3C%3E"),
    ("#a`b'c", "https://User@h.example/a/b?q#a%60b'c"), ("?a#b?c#d", "https://User@h.example/a/b?a#b?c#d"), ("/a/%2e%2E/b/.", "https://User@h.example/b/"),
]


def test_references(spark):
    df = spark.createDataFrame([(BASE, h, e) for h, e in RESOLVED] + [("not a base", "/c", "/c"), ("http://h", "c", "http://h/c"), ("http:\\\\h\\a\\b", "c", "http://h/a/c")],
                               "b string, h string, e string")
    for r in df.select("b", "h", "e", resolve_href("b", "h").alias("r")).collect():
        assert r.r == r.e, r.h
    assert spark.createDataFrame([("http://h", None)], "b string, h string").select(resolve_href("b", "h")).first()[0] is None
    assert len(REFERENCES) > 20 and AGENT


def test_quoting_equals_the_standard_library(spark):
    texts = ["/caf%C3%A9%2f", "a+b%zz%", "%ff%C3x", "日本%E6%97", "", "%25%32", "%c3%28%e2%82", "/a;p?q#f", "/a;?#", "//h/x;y", "/a/~b_c.d-e!*'()[]", "HTTP://H/x?", "a:b", "/é\x7f \"<>|"]
    df = spark.createDataFrame([(x,) for x in texts], "u string")
    for r in df.select("u", py_unquote("u").alias("a"), py_quote("u").alias("b"), py_urlunparse(url_parts("u")).alias("c")).collect():
        assert (r.a, r.b, r.c) == (unquote(r.u), quote(r.u), urlunparse(urlparse(r.u)))


TEXTS = [
    "", "User-agent: *\nDisallow: /café", "User-agent: *\nDisallow: /caf%c3%a9", "User-agent: *\nDisallow: /a%2fb", "User-agent: *\nDisallow: /a/b;p",
    "User-agent: *\nDisallow: /a?x=é", "User-agent: *\nAllow: /a/b/c\nDisallow: /a\n", "User-agent: *\nDisallow: /a\nAllow: /a/b", "User-agent: *\nDisallow: *",
    "User-agent: *\nDisallow: /*.html", "User-agent: *\nDisallow: /a#frag", "User-agent: *\nDisallow:\nDisallow: /", "User-agent: *\nAllow:\nDisallow: /",
    "User-agent: bot\nDisallow: /\n\nUser-agent: *\nDisallow: /a", "User-agent: *\nDisallow: /a\n\nUser-agent: bot\nDisallow: /c", "User-agent: bot\nUser-agent: *\nDisallow: /a\n\nUser-agent: bot\nAllow: /",
    "User-agent: *\nDisallow: /a\n\nUser-agent: *\nDisallow: /c", "User-agent: bot\nCrawl-delay: 5\nUser-agent: other\nDisallow: /", "User-agent: bot\nRequest-rate: 1/5\n\nUser-agent: *\nDisallow: /",
    "User-agent: bot\n\nDisallow: /", "User-agent: bot\n \t\nDisallow: /a", "User-agent: bot # x\nDisallow : /a # /c\nfoo: bar\nno colon\nDisallow: /%63", "User-agent:\nDisallow: /a",
    "User-agent: BO\nDisallow: /a", "User-agent: b%6Ft\nDisallow: /a", "Disallow: /\nUser-agent: *\nAllow: /", "User-agent: bot\nUser-agent: x\r\nDisallow: /a\rDisallow: /c",
    "User-agent: *\nDisallow: //[x\nDisallow: /", "User-agent: *\nDisallow: /a/\nSitemap: https://h/s.xml\nUser-agent: bot\nDisallow: /c", "User-agent: *\nDisallow: HTTP://x/a\nDisallow: /a?",
]
PATHS = ["", "/", "/a", "/a/b", "/a/b/c", "/a%2Fb", "/a%2fb/x", "/caf%C3%A9", "/café", "/caf%c3%a9/menu", "/c", "/%63/d", "/a/b;p=1", "/a;b", "/a?x=%C3%A9&y", "/a?x=é", "/a#frag", "/x.html",
         "/%2A.html", "/*.html", "/%3Fq", "/a%23frag", "?a", "/%ff%fe", "/[x"]


def standard(text, agent, url):
    try:
        parser = RobotFileParser()
        parser.parse(text.splitlines())
        return parser.can_fetch(agent, url)
    except ValueError:
        return True


def test_robots_equal_the_standard_parser(spark):
    texts = spark.createDataFrame([(f"h{i}.example", t) for i, t in enumerate(TEXTS)], "host string, robots_txt string")
    cases = [(i, p, f"https://h{i}.example{p}") for i, p in product(range(len(TEXTS)), PATHS)]
    urls = spark.createDataFrame([(k, u) for k, (_, _, u) in enumerate(cases)], "page_id long, url string")
    rules = parse_robots(texts).cache()
    for agent in ("*", "bot", "Bot/2.1 (x)", "MyScraperBot", "other"):
        got = {r.page_id: r.allowed for r in allowed_urls(urls, rules, agent).collect()}
        for k, (i, _, url) in enumerate(cases):
            assert got[k] == standard(TEXTS[i], agent, url), (TEXTS[i], agent, url)
    odd = spark.createDataFrame([(1, "https://h1.example[/a"), (2, None), (3, "https://nowhere.example/a"), (4, "https://h1.example]x/café")], "page_id long, url string")
    assert all(r.allowed for r in allowed_urls(odd, rules).collect())
    rules.unpersist()


def test_guidance_lines(spark):
    text = "LLM: https://h/llms.txt # here\nUser-agent: *\nllm-FULL: https://h/%6clms-full.txt\nDisallow: /\nSitemap: /rel.xml\nSITEMAP:https://h/s.xml\nllm:\n"
    got = robots_guidance(spark.createDataFrame([("h", text), ("k", None), ("m", "")], "host string, robots_txt string")).collect()
    assert sorted((r.host, r.rule_no, r.directive, r.value) for r in got) == [
        ("h", 0, "llm", "https://h/llms.txt"), ("h", 2, "llm-full", "https://h/llms-full.txt"), ("h", 5, "sitemap", "https://h/s.xml")]
