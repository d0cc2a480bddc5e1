"""Page source and request -> page lookup."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagegrove.schemas import PAGES


#: Scan bytes per core below which pages are spread over all cores.
SPREAD_BYTES = 32 << 20


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Crawled pages ``(page_id, url, html)`` with an explicit schema, so
    URL-only queries never read the ``html`` column (column pruning) and
    ``url``/``page_id`` filters reach the Parquet scan."""
    if not path.endswith(".parquet") and not path.endswith("/"):
        path = f"{path.rstrip('/')}/pages.parquet"
    return spark.read.schema(PAGES).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Give the per-page Python stage enough tasks.  A large input already
    has one split per file block and is left alone (no shuffle of the HTML);
    only an input whose estimated size is below one scan split per core is
    round-robin spread.  The estimate comes from file metadata: no job runs."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size < cores * SPREAD_BYTES else df


def resolve_pages(requests: DataFrame, pages: DataFrame, url_col: str = "url") -> DataFrame:
    """Every request row with its page (``page_id``/``html`` null when
    the URL is not in ``pages``); never drops a request.

    The page table is first reduced to the requested URLs with a left-semi
    join, whose build side is the (usually small) set of distinct requested
    URLs -- AQE broadcasts it when it is small, otherwise it is an ordinary
    shuffle join -- so the large ``html`` column is shuffled only for pages
    that were asked for.  ``pages.url`` is assumed unique (a crawl table
    keyed by URL).
    """
    wanted = requests.select(F.col(url_col).alias("url")).distinct()
    hits = pages.join(wanted, "url", "left_semi")
    return requests.join(hits.withColumnRenamed("url", url_col), url_col, "left")
