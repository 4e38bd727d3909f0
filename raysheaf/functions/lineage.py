"""Lineage cuts for loops, in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """df from a reliable checkpoint in the session's spark.checkpoint.dir. Where that is unset a session on one machine takes a temporary folder, and any other is an error."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, as ``cut`` takes it."""
    cut(spark.range(0))
    return spark.sparkContext.getCheckpointDir().rstrip("/")
