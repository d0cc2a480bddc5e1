"""Intermediate tables in the cluster's shared folder.

``stage`` fixes rows where a plan needs them twice in the same order or
partition; a lost executor then rereads them instead of computing them anew.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from pagegrove.session import checkpoint_dir


def stage(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once under ``spark.checkpoint.dir`` and read back."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
