"""Places and running sizes over ranges."""

import random

import pytest
from pyspark.sql import functions as F

from pagegrove.operators import ranking
from pagegrove.operators.ranking import with_running
from pagegrove.operators.site import PAGE_SEPARATOR, llms_full, sectioned_llms_txt


def test_places_and_sums_of_hot_groups(spark, monkeypatch):
    r = random.Random(2)
    rows = [("hot" if i % 3 else r.choice(["a", "b", None]), r.randrange(5), i, r.randrange(100)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, k long, id long, x long").repartition(6)
    seen = []
    kept = ranking.stage
    monkeypatch.setattr(ranking, "stage", lambda df, name: seen.append(kept(df, name)) or seen[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as for partitions of a large table
    got = {r.id: (r.rank, r.before) for r in with_running(df, ["g"], [F.desc("k"), F.asc("id")], {"before": "x"}).collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == len(rows)
    for g in ("hot", "a", "b", None):
        total = 0
        for place, (_, _, i, x) in enumerate(sorted((x for x in rows if x[0] == g), key=lambda x: (-x[1], x[2]))):
            assert got[i] == (place + 1, total)
            total += x
    spread = seen[0].where("g = 'hot'").groupBy("_part").count().collect()
    assert len(spread) >= 3 and max(x["count"] for x in spread) < 1500  # no task has the hot group
    assert with_running(df.limit(0), ["g"], [F.asc("id")], {"before": "x"}).count() == 0


def test_sections_of_one_hot_section(spark):
    links = [("s", f"https://s/a/{i}", f"t{i}", i % 7) for i in range(400)] + [("s", f"https://s/b{i}", "t", 1) for i in range(20)]
    df = spark.createDataFrame(links, "site string, url string, title string, n_pages long")
    got = {(r.section, r.chunk): r.content for r in sectioned_llms_txt(df, 50).collect()}
    hot = sorted((x for x in links if "/a/" in x[1]), key=lambda x: (-x[3], x[1]))
    for c in range(8):
        assert got["a", c] == "## a\n" + "\n".join(f"- [{t}]({u})" for _, u, t, _ in hot[50 * c:50 * c + 50])
    assert len(got) == 28 and not set(got) - {("a", c) for c in range(8)} - {(f"b{i}", 0) for i in range(20)}


@pytest.mark.parametrize("cap", [200, 1000])
def test_whole_site_text_is_cut_by_size(spark, cap):
    r = random.Random(cap)
    files = [(r.randrange(1 << 60), f"https://s{i % 2}.com/{i}", "x" * r.choice([0, 5, 40, 60, 90, 150, 700]), "error" if i % 11 == 0 else "ok") for i in range(300)]  # hashed ids
    df = spark.createDataFrame(files, "page_id long, url string, content string, status string")
    got = llms_full(df, cap).orderBy("site", "chunk").collect()
    for site in ("s0.com", "s1.com"):
        own = [r for r in got if r.site == site]
        want = [c for p, u, c, s in sorted(files) if s == "ok" and f"//{site}/" in u]
        assert PAGE_SEPARATOR.join(r.content for r in own) == PAGE_SEPARATOR.join(want)
        assert sum(r.n_pages for r in own) == len(want)
        assert all(len(r.content) <= cap or r.n_pages == 1 for r in own)
        joined = [len(a.content) + len(b.content) for a, b in zip(own, own[1:], strict=False)]
        assert sum(joined) / len(joined) > cap / 2  # chunks are not cut small
    assert llms_full(df.limit(0), cap).count() == 0
    assert [r.n_pages for r in llms_full(spark.createDataFrame([(5, None, "a", "ok"), (6, None, "b", "ok")], df.schema), cap).collect()] == [2]
