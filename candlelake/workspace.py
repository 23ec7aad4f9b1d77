"""The shared work folder of a session."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """A new folder name under the shared folder of ``spark.checkpoint.dir``.

    On a single machine a temporary folder stands in where that setting is absent; a cluster must have it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="candlelake-")
    return f"{base.rstrip('/')}/candlelake-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Compute a DataFrame now and keep it in the shared checkpoint folder.

    For a result that several branches of one plan read: they share it, and it outlives the executors.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or work_dir(df.sparkSession))
    return df.checkpoint()
