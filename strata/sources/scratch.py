"""Where intermediate results go: the folder that a cluster shares, named in spark.checkpoint.dir."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def checkpoints(spark: SparkSession) -> str:
    """Make checkpoint() usable and return its folder: the session's spark.checkpoint.dir, else, in local mode only, a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints"))
    return sc.getCheckpointDir()
