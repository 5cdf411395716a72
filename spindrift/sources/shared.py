"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Unset, a local session gets a temporary folder; on a cluster that is an error."""
    context = spark.sparkContext
    there = context.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        there = tempfile.mkdtemp(prefix="spindrift-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(there)
    return there.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, with its lineage cut."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
