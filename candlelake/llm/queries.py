"""The operators bound to the test tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlelake.llm.chat import conversation_digests, format_conversations
from candlelake.llm.decontamination import contaminated
from candlelake.llm.html_text import extract_text
from candlelake.llm.mixing import plan_mix
from candlelake.llm.near_dedup import near_duplicates
from candlelake.llm.oracles import ORACLES
from candlelake.llm.quality import judge_quality
from candlelake.llm.repeats import remove_repeats
from candlelake.llm.secret_scan import KINDS, scan_secrets, span_text, train_secret_model
from candlelake.llm.toxicity import score_toxicity, train_toxicity
from candlelake.llm.warc import read_packages, write_packages

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


@query
def op1_suffix_array_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = remove_repeats(table(spark, sf, "documents"), length=400, keep="none")
    return out.select(
        "doc_id",
        "n_bytes",
        F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x["stop"] - x["start"]), F.lit(0).cast("long")).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op2_minhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates(table(spark, sf, "documents"))


#: Weights 5, 2, 1; the first kind of source fades out over training and the last comes in.
MIX = [(5, 1.5, 0.5), (2, 1.0, 1.0), (1, 0.5, 1.5)]


@query
def op3_source_mixing(spark: SparkSession, sf: str) -> DataFrame:
    plan = plan_mix(table(spark, sf, "documents"), MIX)
    return plan.select("doc_id", "size", "source_size", "target", "taken", F.get("readings", F.lit(0))["position"].alias("position")).sort("position", "doc_id")


@query
def op4_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    found = scan_secrets(docs.select("doc_id", "text"), train_secret_model(docs))
    count = lambda kind: F.size(F.filter("base", lambda x: x["k"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")
    return found.select("doc_id", count(0), count(1), count(2), F.sha2(span_text("base"), 256).alias("base_sha256"), span_text("secrets").alias("spans"))

#: A public vocabulary that every worker has at this place.
TOKENIZER = os.environ.get("CHAT_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.json")


@query
def op5_chat_formatting(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    marks = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", marks), (-1, 1, "assistant", marks)], turns.schema)
    return conversation_digests(format_conversations(turns.unionAll(extra), TOKENIZER), TOKENIZER)


@query
def op6_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    model = train_toxicity(docs, table(spark, sf, "labels").filter(fold != 0))
    scored = score_toxicity(docs, model)
    return scored.select("doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query
def op7_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    judged = judge_quality(table(spark, sf, "documents")).withColumn("base_failed", failed)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (F.col("kept") & ~F.col("base_failed")).alias("kept"))


@query
def op8_warc_packages(spark: SparkSession, sf: str) -> DataFrame:
    records = read_packages(write_packages(table(spark, sf, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLES["op8_warc_packages"] = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first < page_id THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)"""


@query
def op9_benchmark_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


@query
def op10_html_extraction(spark: SparkSession, sf: str) -> DataFrame:
    return extract_text(table(spark, sf, "pages")).select("page_id", "url", "text", "n_chars")
