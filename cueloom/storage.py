"""Where stages leave their tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. A temporary one where none is set and all runs on this machine; on a cluster that is an error, for executors would each write to their own disks."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="cueloom-ckpt-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def kept(df: DataFrame) -> DataFrame:
    """The table, computed once and written to the shared checkpoint folder; what is built on it starts from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
