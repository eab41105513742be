"""The folder that driver and executors share, for tables and checkpoints of a run."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local master may do without the setting."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "/tmp/checkpoints"


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpoints(spark: SparkSession) -> None:
    """Sets the checkpoint folder where it is unset."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder(spark))
