"""The shared folder in which queries cut lineage and write tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoints(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, a temporary one, but on a local master only."""
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not sc.getCheckpointDir():
        if not configured and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
        sc.setCheckpointDir(configured or tempfile.mkdtemp(prefix="tesserae-"))
    return configured or sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder of its own for a query's tables."""
    return f"{checkpoints(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder."""
    checkpoints(df.sparkSession)
    return df.checkpoint()
