"""Reading topics as streams, and the framing of their payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlelake.schemas import DEPTH, KLINE, TICKER, TRADE

# Topic names and the record each one carries.
TOPICS = {"crypto_ticker": TICKER, "crypto_trades": TRADE, "crypto_klines": KLINE, "crypto_depth": DEPTH}
MAGIC = 0
HEADER_BYTES = 5
# The most a micro-batch takes in where the caller sets no bound.
BYTES_PER_TRIGGER = "1g"


def read_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    file_format: str = "parquet",
    files_per_trigger: int | None = None,
    **options: str,
) -> DataFrame:
    """Stream of the files that land under a path, with declared columns and a bounded intake.

    A micro-batch takes ``files_per_trigger`` files, or what an intake option names, or else a gigabyte of files. So the
    first batch over a long history is no larger than any other.
    """
    reader = spark.readStream.format(file_format).schema(schema).options(**options)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    elif not {"maxfilespertrigger", "maxbytespertrigger"} & {name.lower() for name in options}:
        reader = reader.option("maxBytesPerTrigger", BYTES_PER_TRIGGER)
    return reader.load(path)


def read_topic(spark: SparkSession, root: str, topic: str, columns: list[str] | None = None, **options) -> DataFrame:
    """Stream of one topic's records, landed under ``root/topic``; only ``columns`` if they are given."""
    rows = read_stream(spark, f"{root}/{topic}", TOPICS[topic], **options)
    return rows if columns is None else rows.select(*columns)


def unframe(df: DataFrame, column: str = "value") -> DataFrame:
    """Split a framed payload into ``magic``, ``schema_id`` and ``body``, and flag well-formed ones."""
    value = F.col(column)
    enough = F.length(value) > HEADER_BYTES
    magic = F.conv(F.hex(F.substring(value, 1, 1)), 16, 10).cast("int")
    return df.withColumns(
        {
            "magic": F.when(F.length(value) > 0, magic),
            "schema_id": F.when(enough, F.conv(F.hex(F.substring(value, 2, 4)), 16, 10).cast("bigint")),
            "body": F.when(enough, F.substring(value, F.lit(HEADER_BYTES + 1), F.length(value) - HEADER_BYTES)),
            "framed": F.coalesce(enough & (magic == MAGIC), F.lit(False)),
        }
    )


def frame(df: DataFrame, body: str, schema_id: str, name: str = "value") -> DataFrame:
    """Put the five header bytes in front of a binary body."""
    header = F.unhex(F.concat(F.lpad(F.hex(F.lit(MAGIC)), 2, "0"), F.lpad(F.hex(F.col(schema_id)), 8, "0")))
    return df.withColumn(name, F.concat(header, F.col(body)))


def frame_audit(df: DataFrame, topic: str = "topic", column: str = "value") -> DataFrame:
    """Messages and payload bytes per topic and schema id; malformed frames are counted as rejected."""
    rows = unframe(df.select(topic, column), column)
    return rows.groupBy(topic, F.when(F.col("framed"), F.col("schema_id")).alias("schema_id")).agg(
        F.count(F.lit(1)).alias("messages"),
        F.sum(F.coalesce(F.length("body"), F.lit(0))).alias("body_bytes"),
        F.count_if(~F.col("framed")).alias("rejected"),
    )
