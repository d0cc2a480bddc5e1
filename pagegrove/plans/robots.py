"""Queries on robots texts that are composed per host from the links of its
pages: several groups, rules in raw and in percent-encoded form, comments,
directives of the whole site.  The DuckDB side states the same result with its
own URL coding functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagegrove.functions.urls import pct_encode, resolve_href, url_host, url_parts
from pagegrove.operators import site as R
from pagegrove.plans import sqlfrag as S
from pagegrove.plans.catalog import SQL_SITE, pages, query, site_links
from pagegrove.plans.sqlfrag import q

AGENT = "MyScraperBot/1.0"
NON_ASCII = r"\x80-\x{10ffff}"
HREF = '<a href="(/[^"#?&;]*)">'

#: The lines of a host's text; {a} and {b} are paths of its links, {b} with percent-encoded bytes in lower case.
LINES = ["# rules of {host}", "User-agent: OtherBot", "Disallow: /", "", "user-agent : myscraper", "User-agent: Second#part", "Crawl-delay: 2", "Disallow: {a}  # as written",
         "Disallow: {b}", "Allow: /%65n%2f", "Disallow: /*.html", "DISALLOW: /e%73/", "", "Disallow: /fr/", "User-agent: *", "Disallow: /", "",
         "LLM: https://{host}/llms.txt", "LLM-full: https://{host}/llms-full.txt", "Sitemap: /not-absolute.xml"]


def robots_texts(pages_df: DataFrame) -> DataFrame:
    """``(host, robots_txt)``: rules name the least and the greatest
    non-ASCII path among the host's links (``/none`` where it has none)."""
    hrefs = F.filter(F.regexp_extract_all("html", F.lit(HREF), F.lit(1)), lambda h: h.rlike(f"[{NON_ASCII}]"))
    per_page = pages_df.select(url_host(F.col("url")).alias("host"), F.array_min(hrefs).alias("a"), F.array_max(hrefs).alias("b"))
    hosts = per_page.groupBy("host").agg(F.coalesce(F.min("a"), F.lit("/none")).alias("a"), F.coalesce(F.max("b"), F.lit("/none")).alias("b"))
    lower = F.array_join(F.transform(F.regexp_extract_all("b", F.lit(f"[{NON_ASCII}]+|[^{NON_ASCII}]+"), F.lit(0)),
                                     lambda t: F.when(t.rlike(f"^[{NON_ASCII}]"), F.lower(pct_encode(t, NON_ASCII))).otherwise(t)), "")
    text = F.lit("\n".join(LINES))
    for name, col in (("{host}", F.col("host")), ("{a}", F.col("a")), ("{b}", lower)):
        text = F.replace(text, F.lit(name), col)
    return hosts.select("host", text.alias("robots_txt"))


SQL_HOSTS = f"""
hrefs AS (SELECT {S.host('url')} AS host, unnest(regexp_extract_all(html, {q(HREF)}, 1)) AS href FROM pages),
hosts AS (
  SELECT h.host, coalesce(min(href), '/none') AS a, coalesce(max(href), '/none') AS b
  FROM (SELECT DISTINCT {S.host('url')} AS host FROM pages) h
  LEFT JOIN (SELECT * FROM hrefs WHERE regexp_matches(href, {q(f'[{NON_ASCII}]')})) USING (host) GROUP BY h.host)"""


def sql_canon(x: str) -> str:
    return f"replace(url_encode(url_decode({x})), '%2F', '/')"


@query("robots_group_rules", f"""
WITH {SQL_HOSTS},
r(group_no, agent, rule_no, directive, allow, path) AS (VALUES
  (1, 'OtherBot', 2, 'disallow', false, '/'),
  (3, 'myscraper', 6, 'crawl-delay', NULL, NULL), (3, 'Second', 6, 'crawl-delay', NULL, NULL),
  (3, 'myscraper', 7, 'disallow', false, '{{a}}'), (3, 'Second', 7, 'disallow', false, '{{a}}'),
  (3, 'myscraper', 8, 'disallow', false, '{{b}}'), (3, 'Second', 8, 'disallow', false, '{{b}}'),
  (3, 'myscraper', 9, 'allow', true, '/en/'), (3, 'Second', 9, 'allow', true, '/en/'),
  (3, 'myscraper', 10, 'disallow', false, '/%2A.html'), (3, 'Second', 10, 'disallow', false, '/%2A.html'),
  (3, 'myscraper', 11, 'disallow', false, '/es/'), (3, 'Second', 11, 'disallow', false, '/es/'),
  (5, '*', 15, 'disallow', false, '/'))
SELECT host, group_no, agent, rule_no, directive, allow,
       CASE path WHEN '{{a}}' THEN {sql_canon('a')} WHEN '{{b}}' THEN {sql_canon('b')} ELSE path END AS path_prefix
FROM hosts, r""")
def q_robots_group_rules(spark, sf):
    """Groups with several agents, comments, delays and encoded paths."""
    return R.parse_robots(robots_texts(pages(spark, sf)))


@query("robots_guidance", f"""
WITH {SQL_HOSTS}, g(rule_no, directive, name) AS (VALUES (17, 'llm', 'llms.txt'), (18, 'llm-full', 'llms-full.txt'))
SELECT host, rule_no, directive, 'https://' || host || '/' || name AS value FROM hosts, g""")
def q_robots_guidance(spark, sf):
    """LLM and sitemap lines of every host."""
    return R.robots_guidance(robots_texts(pages(spark, sf)))


@query("robots_links_allowed", SQL_SITE + f""",
{SQL_HOSTS},
targets AS (
  SELECT first_page_id AS page_id, url FROM sn
  UNION ALL SELECT page_id, url FROM pages),
t AS (SELECT *, {sql_canon("regexp_replace(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*', '')")} AS p, {S.host('url')} AS host FROM targets)
SELECT page_id, url, NOT (starts_with(p, {sql_canon('a')}) OR starts_with(p, {sql_canon('b')}) OR starts_with(p, '/es/')) AS allowed
FROM t JOIN hosts USING (host)""")
def q_robots_links_allowed(spark, sf):
    """Pages and the links of their navigation under a named agent's rules."""
    p = pages(spark, sf)
    links = site_links(spark, sf).select(F.col("first_page_id").alias("page_id"), "url")
    return R.allowed_urls(links.union(p.select("page_id", "url")), R.parse_robots(robots_texts(p)), AGENT)


# ---------------------------------------------------------------------------
# References of every shape against each page's URL
# ---------------------------------------------------------------------------

#: reference -> what it resolves to; {s} scheme, {h} host, {d} the page's folder, {p} its path, {q} its query with the mark, {i} its id
REFERENCES = [
    ("?q=a\\b", "{s}://{h}{p}?q=a\\b"), ("#a\\b", "{s}://{h}{p}{q}#a\\b"), ("", "{s}://{h}{p}{q}"), ("?", "{s}://{h}{p}?"), ("#", "{s}://{h}{p}{q}#"),
    ("\\x\\{i}?z=\\w#\\v", "{s}://{h}/x/{i}?z=\\w#\\v"), ("c{i}", "{s}://{h}{d}c{i}"), ("./c/%2e/{i}/%2E.", "{s}://{h}{d}c/"), ("../../../c", "{s}://{h}/c"),
    ("https://User:Pw@HOST.example:443/{i}", "https://User:Pw@host.example/{i}"), ("ftp://u@h:21", "ftp://u@h/"), ("http://:p w@h:080/%7e", "http://:p%20w@h/%7e"),
    ("http://a@b@h:8080?{i}", "http://a%40b@h:8080/?{i}"), ("//K.example:/c?é'#é`", "{s}://k.example/c?%C3%A9%27#%C3%A9%60"), ("\\\\k\\c", "{s}://k/c"),
    ("{s}:c{i}", "{s}://{h}{d}c{i}"), ("{s}:/c{i}", "{s}://{h}/c{i}"), ("{s}:", "{s}://{h}{p}{q}"), ("http://h:{i}x/", "http://h:{i}x/"), ("https://h:70000/", "https://h:70000/"),
    ("http://", "http://"), ("javascript:go('{i} x')", "javascript:go('{i} x')"), ("MailTo:ü@x?s=a b", "mailto:%C3%BC@x?s=a%20b"), ("http://[::1]:80/{i}", "http://[::1]/{i}"),
]


def _sql_filled(x: str) -> str:
    for name, col in (("{s}", "s"), ("{h}", "h"), ("{d}", "d"), ("{p}", "p"), ("{q}", "qs"), ("{i}", "page_id::VARCHAR")):
        x = f"replace({x}, '{name}', {col})"
    return x


@query("url_references", f"""
WITH u AS (
  SELECT page_id, url, split_part(url, '://', 1) AS s, split_part(split_part(url, '://', 2), '/', 1) AS h,
         split_part(split_part(url[strpos(url, '://') + 3 + strpos(url[strpos(url, '://') + 3:], '/') - 1:], '#', 1), '?', 1) AS p,
         CASE WHEN contains(url, '?') THEN '?' || split_part(split_part(url, '?', 2), '#', 1) ELSE '' END AS qs FROM pages),
f AS (SELECT *, left(p, length(p) - strpos(reverse(p), '/') + 1) AS d FROM u),
r(no, ref, want) AS (VALUES {', '.join(f'({i}, {q(a)}, {q(b)})' for i, (a, b) in enumerate(REFERENCES))})
SELECT page_id, no, {_sql_filled('ref')} AS ref, {_sql_filled('want')} AS resolved FROM f, r""")
def q_url_references(spark, sf):
    """Backslashes, user names, ports, empty parts and other schemes."""
    scheme = F.regexp_extract("url", "^([a-z]+):", 1)
    refs = F.posexplode(F.array(*[F.lit(a) for a, _ in REFERENCES])).alias("no", "ref")
    rows = pages(spark, sf).select("page_id", "url", refs)
    rows = rows.withColumn("ref", F.replace(F.replace("ref", F.lit("{s}"), scheme), F.lit("{i}"), F.col("page_id").cast("string")))
    return rows.select("page_id", "no", "ref", resolve_href(F.col("url"), F.col("ref")).alias("resolved"))


# ---------------------------------------------------------------------------
# URLs of every shape, stated part by part
# ---------------------------------------------------------------------------

#: URL, then scheme, netloc, path, params, query, fragment; {i} is the page's id
SPLIT_URLS = [
    ("HTTP://User@H:80/a;x/b;p={i}?q=1;r#f?g#h", "http", "User@H:80", "/a;x/b", "p={i}", "q=1;r", "f?g#h"),
    ("https://h/{i};", "https", "h", "/{i}", "", "", ""), ("//h/p;v", "", "h", "/p", "v", "", ""), ("mailto:a{i}@b;c", "mailto", "", "a{i}@b;c", "", "", ""),
    ("a;{i}/b", "", "", "a;{i}/b", "", "", ""), ("ftp://h/a;type=i;{i}", "ftp", "h", "/a", "type=i;{i}", "", ""), ("1x:{i}", "", "", "1x:{i}", "", "", ""),
    (" \thttps://h/\n{i}?#", "https", "h", "/{i}", "", "", ""), ("?{i}#", "", "", "", "", "{i}", ""), ("ws://h/a;{i}", "ws", "h", "/a;{i}", "", "", ""),
]
PARTS = ["scheme", "netloc", "path", "params", "query", "fragment"]


@query("url_split_shapes", f"""
WITH r(no, {', '.join(PARTS)}) AS (VALUES {', '.join(f"({k}, {', '.join(q(x) for x in row[1:])})" for k, row in enumerate(SPLIT_URLS))})
SELECT page_id, no, {', '.join(f"replace({c}, '{{i}}', page_id::VARCHAR) AS {c}" for c in PARTS)} FROM pages, r""")
def q_url_split_shapes(spark, sf):
    """Parameters, other schemes, white space and empty parts."""
    rows = pages(spark, sf).select("page_id", F.posexplode(F.array(*[F.lit(row[0]) for row in SPLIT_URLS])).alias("no", "u"))
    p = url_parts(F.replace("u", F.lit("{i}"), F.col("page_id").cast("string")))
    return rows.select("page_id", "no", p.alias("p")).select("page_id", "no", *[F.col(f"p.{c}").alias(c) for c in PARTS])
