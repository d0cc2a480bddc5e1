"""Headline-query benchmark.

Runs the headline queries at ``$BENCH_SF_DIR`` (default
/root/testdata/sf0.1) on ``local[$BENCH_CPUS]`` and prints one JSON line:
``{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}``.
Each query is fully executed (rows written to a no-op sink), so the time
covers parsing, the plan and the shuffle work, not just planning.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pagegrove.plans.catalog import REGISTRY  # noqa: E402
from pagegrove.session import get_spark  # noqa: E402

HEADLINE = ["links_unique", "links_rendered", "page_markdown", "homepage_info", "llms_txt", "nav_filtered",
            "nav_markdown", "markdown_file_set", "site_nav", "site_top_links", "llms_full"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark(cpus, app="pagegrove-bench")
    # warm-up on the smallest tables (not the benched data): JVM classes,
    # Python workers and the once-per-process expression builds
    warm_dir = os.environ.get("BENCH_WARM_DIR", "/root/testdata/sf0.001")
    if not os.path.exists(f"{warm_dir}/pages.parquet"):
        warm_dir = sf_dir
    for name in ("sanitize_filename", "page_markdown", "llms_txt", "site_nav"):
        REGISTRY[name][0](spark, warm_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        if name not in REGISTRY:
            continue
        t0 = time.perf_counter()
        df = REGISTRY[name][0](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir,
                      "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
