"""Session helpers.

On a cluster the session is built by the platform; ``get_spark`` is for
tests, the bench and local runs.  Library code never creates a session.
"""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def get_spark(cpus: int | str = "*", app: str = "pagegrove",
              shuffle_partitions: int | None = None) -> SparkSession:
    parts = shuffle_partitions or (8 if cpus == "*" else max(int(cpus), 1))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(parts))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        # rows carry whole pages: keep Arrow batches small
        .config("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("PAGEGROVE_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SCRATCH: dict[str, str | None] = {}


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    Uses ``spark.checkpoint.dir`` when the cluster names one; only when it is
    unset (local tests) a fresh scratch folder is created for the session.
    On a cluster an unset folder is an error: executors share no local disk.
    """
    conf = spark.sparkContext.getConf()
    path = conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        # the setting cannot be changed while Spark runs, so the folder is remembered here
        path = _SCRATCH.setdefault(spark.sparkContext.applicationId, None) or tempfile.mkdtemp(prefix="pagegrove-ckpt-")
        _SCRATCH[spark.sparkContext.applicationId] = path
    spark.sparkContext.setCheckpointDir(path)
    return path
