"""Registry of queries, and the views of the test tables they start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlelake.functions.time import epoch_ms
from candlelake.operators.candles import trades_to_candles

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

DAY = 86_400_000
HOUR = 3_600_000
MINUTE = 60_000
#: 2024-01-16, 2024-01-20 13:00 and 13:37, 2024-01-31 (UTC)
SPLIT = 1_705_363_200_000
CUT = 1_705_755_600_000
AS_OF = 1_705_757_820_000
END = 1_706_659_200_000


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query, with its SQL if there is one."""

    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name!r} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")


def ticks(spark: SparkSession, sf: str) -> DataFrame:
    """Events as ticks: symbol, event_time, price, volume, id."""
    return table(spark, sf, "events").select(
        F.col("event_type").alias("symbol"),
        epoch_ms("ts").alias("event_time"),
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("volume"),
        F.col("event_id").alias("id"),
    )


def as_trades(df: DataFrame) -> DataFrame:
    return df.select(
        "symbol",
        F.col("event_time").alias("trade_time"),
        "price",
        F.col("volume").alias("quantity"),
        F.col("id").alias("agg_trade_id"),
    )


def trades(spark: SparkSession, sf: str) -> DataFrame:
    return as_trades(ticks(spark, sf))


def candles(spark: SparkSession, sf: str, interval: str = "1h") -> DataFrame:
    return trades_to_candles(trades(spark, sf), interval)


def klines(spark: SparkSession, sf: str, interval: str = "1h") -> DataFrame:
    """Candles as closed kline records."""
    from candlelake.schemas import interval_millis

    end = F.col("open_time") + interval_millis(interval) - 1
    return candles(spark, sf, interval).select(
        end.alias("event_time"),
        "symbol",
        F.col("open_time").alias("kline_start"),
        end.alias("kline_close"),
        F.lit("1m").alias("interval"),
        "open",
        "high",
        "low",
        "close",
        "volume",
        "quote_volume",
        "trade_count",
        F.lit(True).alias("is_closed"),
    )


# --- the same views in SQL -------------------------------------------------------------------------

TICKS = """ticks AS (
  SELECT event_type AS symbol, CAST(epoch_us(ts) // 1000 AS BIGINT) AS t, value AS price,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS qty, event_id AS id
  FROM events)"""


def ohlcv(name: str, source: str, size: int, where: str = "TRUE") -> str:
    return f"""{name} AS (
  SELECT symbol, t - t % {size} AS open_time,
         first(price ORDER BY t, id) AS open, max(price) AS high, min(price) AS low,
         last(price ORDER BY t, id) AS close, round(sum(qty), 8) AS volume,
         round(sum(price * qty), 8) AS quote_volume, count(*) AS trade_count
  FROM {source} WHERE {where} GROUP BY symbol, t - t % {size})"""


def again(name: str, source: str, size: int) -> str:
    """Candles from candles."""
    return f"""{name} AS (
  SELECT symbol, open_time - open_time % {size} AS open_time,
         first(open ORDER BY open_time) AS open, max(high) AS high, min(low) AS low,
         last(close ORDER BY open_time) AS close, round(sum(volume), 8) AS volume
  FROM {source} GROUP BY symbol, open_time - open_time % {size})"""


def sql(*parts: str) -> str:
    """CTEs followed by the final select."""
    *ctes, select = parts
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n" + select if ctes else select


C1H = f"{TICKS},\n{ohlcv('c1h', 'ticks', HOUR)}"
