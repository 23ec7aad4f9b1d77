"""The training-data pipeline: quality rules, near copies, benchmark leaks, secrets, mixing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlelake.llm.decontamination import drop_contaminated
from candlelake.llm.mixing import mix_documents
from candlelake.llm.near_dedup import drop_near_duplicates
from candlelake.llm.quality import filter_quality
from candlelake.llm.queries import MIX
from candlelake.llm.secret_scan import redact_secrets, train_secret_model
from candlelake.llm.shared import keep

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]



def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass all quality rules."""
    return filter_quality(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced and n_chars counted again where one was."""
    clean = redact_secrets(docs.withColumn("__before", F.col("text")), train_secret_model(docs))
    changed = ~F.col("text").eqNullSafe(F.col("__before"))
    return clean.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training stream: a row per reading, by position, with the number of words it takes."""
    return mix_documents(docs, MIX)


STAGES: list[tuple[str, Stage]] = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("benchmark decontamination", decontamination),
    ("secret scan", secret_scan),
    ("source mixing", source_mixing),
]

#: Hash signatures and trained models have no SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over `documents`; what a stage returns is written as Parquet and read by the next."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = keep(docs)
    return docs
