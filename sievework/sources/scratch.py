"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``. Only a session on one machine that has
    none set gets a temporary folder; elsewhere that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir is not set")
        base = "file://" + tempfile.mkdtemp(prefix="sievework-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written once: what reads it, or is computed again after the loss
    of an executor, finds the same rows."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
