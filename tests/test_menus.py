"""The menu graph against the page-local expansion and goldens."""

import random

from conftest import pages_df
from pyspark.sql import functions as F

from pagegrove.operators import menus as M
from pagegrove.operators.dom import with_dom
from pagegrove.operators.nav import nav_page_columns, nav_tree


def page(x, body="<body>"):
    return f"<html>{body}<nav><ul>{x}</ul></nav></body></html>"


def item(href, below="", text=None):
    return f'<li><a href="{href}">{text or "Link " + href}</a>{below}</li>'


def random_menu(r, depth=0):
    out = []
    for _ in range(r.randrange(1, 4)):
        href = f"/{r.randrange(6)}"
        kind = r.random()
        below = "" if depth > 2 or kind < 0.4 else f"<ul>{random_menu(r, depth + 1)}</ul>" if kind < 0.9 else f"<div><ul>{random_menu(r, depth + 1)}</ul></div>"
        out.append(r.choice([item(href, below), item(href, below, "new"), f'<a href="{href}">Bare {href}</a>' if depth == 0 else item(href), f"<li><i>x</i></li>{item(href, below, 'Ab')}",
                             '<li><a href="javascript:x">Js</a>' + below + "</li>", f'<nav><ul>{item(href)}</ul></nav>']))
    return "".join(out)


def random_pages(spark, n=60):
    r = random.Random(12)
    marks = ["<body>", "<body data-reactroot>", "<body data-v-app>", "<body data-shopify>"]
    htmls = [page(random_menu(r).replace("<div>", r.choice(["<div>", '<div role="menu">', '<div class="submenu">', '<div class="dropdown-menu">'])), r.choice(marks)) for _ in range(n)]
    htmls += [None, "", "<body>no menus</body>", page('<li><a href="/a">Aa</a><ul><a href="/b">Bb</a></ul></li>'), page("<li></li><a href='/z'>Zz</a><li><ul></ul></li><a href='/y'>Yy</a>")]
    return pages_df(spark, htmls).withColumn("title", F.lit("x"))


def test_rows_equal_the_page_local_expansion(spark):
    dom = with_dom(random_pages(spark)).cache()
    for mode in ("compat", "tree"):
        tree = nav_tree(dom, "nav", mode=mode)
        want = [(r.page_id, i, list(k.path), k.depth, k.title, k.full) for r in tree.select("page_id", "kept").collect() for i, k in enumerate(r.kept or [])]
        graphs = M.menu_graphs(dom, "nav", mode=mode)
        got = [(r.page_id, r.pos, list(r.path), r.depth, r.title, r.url) for r in M.menu_rows(graphs, mode).collect()]
        assert sorted(got) == sorted(want) and len(got) > 100
        md = {r.page_id: r.nav_md for r in tree.collect()}
        lines = {}
        for r in M.menu_rows(graphs, mode).orderBy("page_id", "pos").collect():
            lines[r.page_id] = lines.get(r.page_id, "") + r.line + "\n"
        assert all((md[p] or "") == lines.get(p, "") for p in md)
        sizes = {r.page_id: (r.n, r.status) for r in tree.select("page_id", F.size("rows").alias("n"), "status").collect()}
        for r in M.row_counts(graphs, mode).collect() if mode == "compat" else []:
            n, status = sizes[r.page_id]
            assert r.n_rows == (None if status == "cyclic_nav" else str(max(n or 0, 0)))
    looping = {r.page_id for r in M.nav_cycles(M.menu_graphs(dom, "nav")).collect()}
    assert looping == {r.page_id for r in nav_tree(dom, "nav").where("status = 'cyclic_nav'").collect()} and looping
    dom.unpersist()


def test_submenus_equal_the_page_local_form(spark):
    dom = with_dom(random_pages(spark)).cache()
    cols = nav_page_columns(dom, "nav")
    want = sorted((r.page_id, x.id, x.sub or -1) for r in cols.select("page_id", "links").collect() for x in r.links or [])
    got = M.nav_submenus(dom).collect()
    assert sorted((r.page_id, r.link, r.submenu or -1) for r in got) == want
    assert {"ul", "react", "vue", "shopify", None} == {r.via for r in got}
    dom.unpersist()


FRAMEWORKS = [
    ("https://x.com/", '<body data-react><ul><li><a href="/a">A</a><div aria-labelledby="t"></div><div role="menu"></div></li></ul>', 6, "react"),
    ("https://x.com/", '<body><div class="v-application"><ul><li><a href="/a">A</a><p></p><div class="v-menu__content"></div></li></ul></div>', 8, "vue"),
    ("https://www.lego.com/", '<body><ul><li><a href="/a">A</a><div data-test="meganav-content"></div></li></ul>', 6, "lego"),
    ("https://a.shopify.com/", '<body><ul><li><a href="/a">A</a><b><div class="meganav"></div></b></li></ul>', 7, "shopify"),
    ("https://x.com/", '<body data-react data-shopify><ul><li><a href="/a">A</a><div class="meganav"></div></li></ul>', None, None),  # the first framework only
    ("https://x.com/", '<body data-react><ul><li><a href="/a">A</a><div role="menu"><ul></ul></div><ul></ul></li></ul>', 8, "ul"),
    ("https://x.com/", '<body><div class="meganav"></div><a href="/a">A</a>', None, None),
    ("https://x.com/", '<body><li><b></b></li><li><i><li></li></i><a href="/a">A</a></li>', None, None),
]


def test_fallbacks(spark):
    rows = [(i, u, h) for i, (u, h, _, _) in enumerate(FRAMEWORKS)]
    dom = with_dom(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {r.page_id: r for r in M.nav_submenus(dom).collect()}
    for i, (_, _, submenu, via) in enumerate(FRAMEWORKS):
        assert (got[i].submenu, got[i].via) == (submenu, via), i
    assert got[6].item is None and got[7].item == 4
    assert M.nav_submenus(dom.limit(0)).count() == 0


def test_twenty_nested_links_are_walked_row_by_row(spark):
    chain = lambda n: "<body><nav><ul>" + "".join(f'<li><a href="/{j}">Link {j}</a><ul>' for j in range(n))
    dom = with_dom(pages_df(spark, [chain(20), chain(130), chain(3)]))
    graphs = M.menu_graphs(dom, "nav")
    assert [r.n_rows for r in M.row_counts(graphs).orderBy("page_id").collect()] == [str(2**20 - 1), str(2**130 - 1), "7"]
    rows = M.menu_rows(graphs.where("page_id != 1"))
    got = rows.where("page_id = 0").agg(F.count("*"), F.max("pos"), F.max("depth"), F.sum("depth")).first()
    assert tuple(got) == (2**20 - 1, 2**20 - 2, 19, 20 * 2**19 - (2**20 - 1))
    order = [r.line for r in rows.where("page_id = 2").orderBy("pos").collect()]
    url = lambda j: f"[Link {j}](https://x.com/{j})"
    assert order == [f"- {url(0)}", f"  - {url(1)}", f"    - {url(2)}", f"  - {url(2)}", f"- {url(1)}", f"  - {url(2)}", f"- {url(2)}"]


def test_cycles_of_one_and_of_two_menus():
    # a menu in a page holds all that lies in it, so there only loops of one menu occur; a graph may have longer ones
    assert M.find_cycle([1], {1: [0], 5: [1]}, [5, 5]) == (5, 1, [5])
    assert M.find_cycle([1], {1: [0], 5: [1], 9: [2]}, [5, 9, 5]) == (5, 2, [5, 9])
    assert M.find_cycle([1], {1: [0, 1]}, [None, 1]) == (1, 1, [1])
    assert M.find_cycle([1, 2], {1: [0], 2: [1], 5: []}, [5, 5]) is None
    assert M.find_cycle([1], {1: [], 5: [0]}, [5]) is None  # nothing opens it
    n = 5000  # steps in proportion to the menus: shared ones are entered once
    members = {m: [2 * m, 2 * m + 1] for m in range(n)} | {n: []}
    subs = [m // 2 + 1 for m in range(2 * n)]
    assert M.find_cycle([0], members, subs) is None
    assert M.tree_size([0], members, subs) == sum(2**k for k in range(1, n + 1))


def test_cycle_witness(spark):
    dom = with_dom(pages_df(spark, [page('<li><a href="/a">Aa</a><ul><li><a href="/c">Cc</a><ul><a href="/b">Bb</a></ul></li></ul></li>'), page(item("/x"))]))
    r, = M.nav_cycles(M.menu_graphs(dom, "nav")).collect()
    assert (r.page_id, r.menu, r.opener, r.title, r.url, list(r.way)) == (0, 12, 13, "Bb", "https://x.com/b", [12])


def test_graphs_become_objects_a_few_pages_at_a_time(spark):
    """A batch of thousands of menu graphs is never one list of Python objects."""
    import pyarrow as pa
    sizes = []

    class Batch:
        def __init__(self, rows):
            self.rows, self.num_rows = rows, rows.num_rows

        def slice(self, at, n):
            return Batch(self.rows.slice(at, n))

        def to_pylist(self):
            sizes.append(self.num_rows)
            return self.rows.to_pylist()
    link = {"id": 3, "title": "A", "url": "/a", "sub": None}
    rows = [{"page_id": i, "roots": [0], "menus": None, "links": [link] * (i % 3) or None} for i in range(1_000)]
    got = list(M._graphs([Batch(pa.RecordBatch.from_pylist(rows))]))
    assert got == [(i, [0], [], [link] * (i % 3)) for i in range(1_000)]
    assert max(sizes) <= M.SLICE_PAGES < 100
