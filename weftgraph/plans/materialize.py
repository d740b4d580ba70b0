"""Cutting the lineage of iterative plans in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; local sessions without one get a temporary folder."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="weftgraph-"))
    return context.getCheckpointDir()


def materialized(df: DataFrame) -> DataFrame:
    """df, computed once and written to the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
