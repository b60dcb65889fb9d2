"""Cutting lineage in the cluster's shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Where lineage is cut in a local session that names no ``spark.checkpoint.dir``.
LOCAL_CHECKPOINTS = "file:///tmp/texweave-checkpoints"


def checkpoint_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one only where driver and executors are one process (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return named or LOCAL_CHECKPOINTS


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder and read from there; survives lost executors."""
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(checkpoint_dir(df.sparkSession))
    return df.checkpoint(True)
