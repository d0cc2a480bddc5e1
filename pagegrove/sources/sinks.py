"""K1/K2: sinks.  Jobs write with ``mode('overwrite')`` so a retried job
(lost executor, restarted driver) replaces partial output instead of
appending to it; Spark's commit protocol makes each write atomic per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F



def exportable_llms(df: DataFrame) -> DataFrame:
    """K1 guard: content must be non-empty and must not contain ``Error``
    anywhere (which also suppresses legitimate text such as 'Error codes')."""
    c = F.col("content")
    # The predicate must run on the finished rows: pushed down, it would be
    # rebuilt from the whole per-page pipeline below the parse.  It also asks
    # for a row number, which no filter is moved below.
    numbered = df.withColumn("_row", F.monotonically_increasing_id())
    return numbered.filter(c.isNotNull() & (c != "") & ~c.contains("Error") & (F.col("_row") >= 0)).drop("_row")


def write_llms_txt(df: DataFrame, path: str) -> None:
    """K1: one document per homepage, partitioned by site.

    Rows are rebalanced by site before the write: small sites share a task, a
    site larger than the advisory partition size is split over several, so
    there are about as many files as sites and as the data's size asks for, not
    tasks times sites, and a hot site is no single task."""
    (exportable_llms(df).select("site", "page_id", "homepage_url", "content").hint("rebalance", F.col("site"))
     .write.mode("overwrite").partitionBy("site").parquet(path))


def write_markdown(df: DataFrame, path: str) -> bool:
    """K2: the Markdown file set as a ``(filename, content)`` dataset.
    Returns False (and writes nothing) when the set is empty."""
    if df.isEmpty():
        return False
    df.select("filename", "content").write.mode("overwrite").parquet(path)
    return True
