"""Cutting long lineages: a plan is written to the session's checkpoint folder and read back."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: as the cluster says in ``spark.checkpoint.dir``; a local session's own else."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    return tempfile.mkdtemp(prefix="spark-")


def staged(df: DataFrame) -> DataFrame:
    context = df.sparkSession.sparkContext
    if not context.getConf().get("spark.checkpoint.dir", "") and not context.getCheckpointDir():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
