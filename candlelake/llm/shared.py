"""Results that several later steps read, kept as tables in the cluster's shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame

from candlelake.workspace import work_dir


def keep(df: DataFrame) -> DataFrame:
    """Write a DataFrame once as Parquet under `spark.checkpoint.dir` and read it back.

    The copy cuts the lineage and survives lost executors. It is not deleted here, since the result is lazy; a
    cluster's own clean-up of that folder removes it.
    """
    path = work_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
