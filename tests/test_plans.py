"""Plan checks: page-local operators do not shuffle; link
conversion stays JVM-side."""

import re

from pagegrove.plans.catalog import REGISTRY

SF = "/root/testdata/sf0.001"


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_flagship_is_one_narrow_stage(spark):
    plan = _plan(REGISTRY["llms_txt"][0](spark, SF))
    exchanges = re.findall(r"Exchange (\w+)", plan)
    # only the round-robin spread of a tiny one-file input may appear
    assert all(e == "RoundRobinPartitioning" for e in exchanges), exchanges
    assert plan.count("ArrowEvalPython") == 1


def test_page_markdown_parses_once(spark):
    plan = _plan(REGISTRY["page_markdown"][0](spark, SF))
    assert plan.count("ArrowEvalPython") == 1
    assert "Window" not in plan and "Aggregate" not in plan


def test_link_plans_have_no_python(spark):
    for name in ("links_unique", "links_rendered"):
        plan = _plan(REGISTRY[name][0](spark, SF))
        assert "Python" not in plan and "Arrow" not in plan, name


def test_scan_prunes_html_for_url_queries(spark):
    plan = _plan(REGISTRY["sanitize_filename"][0](spark, SF))
    m = re.search(r"ReadSchema: (struct<[^>]*>)", plan)
    assert m and "html" not in m.group(1)
