"""Places and running sums inside groups of any size.

A window over a whole group sorts it in one task.  Here rows are dealt by
ranges of (group, order), so a hot group lies in many partitions; places and
sums are counted inside each partition, and what the partitions before hold of
the group is added from a table with one row for each group and partition.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pagegrove.sources.staging import stage


def with_running(df: DataFrame, group: list[str], order: list[Column], sums: dict[str, str] | None = None, rank: str = "rank") -> DataFrame:
    """``df`` with ``rank`` (from 1) in its group's order and, for each
    ``name: column`` of ``sums``, the column's sum over the group's rows before.

    ``order`` must tell all rows of a group apart.  Null group values are a
    group of their own.  Rows are staged once, since the partition that a row
    is in must not change between the two reads."""
    sums = sums or {}
    ranged = df.repartitionByRange(*[F.col(c) for c in group], *order).withColumn("_part", F.spark_partition_id())
    rows = stage(ranged, "running")
    totals = rows.groupBy("_part", *group).agg(F.count(F.lit(1)).alias("_n"), *[F.sum(c).alias(f"_{name}") for name, c in sums.items()])
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition of the group
    offsets = totals.select(F.col("_part").alias("_p"), *[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)],
                            *[F.coalesce(F.sum(f"_{name}").over(before), F.lit(0)).alias(f"_o_{name}") for name in ("n", *sums)])
    same = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"_g{i}")) for i, c in enumerate(group)], F.col("_part") == F.col("_p"))
    local = Window.partitionBy("_part", *group).orderBy(*order)
    ahead = local.rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn(rank, F.row_number().over(local))
    for name, c in sums.items():
        placed = placed.withColumn(name, F.coalesce(F.sum(c).over(ahead), F.lit(0)))
    placed = placed.join(offsets, same)
    return placed.select(*df.columns, (F.col(rank) + F.col("_o_n")).alias(rank), *[(F.col(name) + F.col(f"_o_{name}")).alias(name) for name in sums])
