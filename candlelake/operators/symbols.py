"""Symbols, their metadata and lists of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlelake.functions.text import base_coin, display_name, key_partition


def active_symbols(df: DataFrame) -> DataFrame:
    """Distinct symbols with their display name, sorted."""
    return (
        df.select("symbol")
        .distinct()
        .select("symbol", display_name("symbol").alias("name"), F.lit("crypto").alias("type"))
        .orderBy("symbol")
    )


def attach_meta(df: DataFrame, meta: DataFrame) -> DataFrame:
    """Add the metadata of each symbol's base coin (``meta`` is keyed by ``coin``).

    No broadcast is forced: Spark broadcasts the metadata where its size is under the configured limit
    and joins by key beyond it.
    """
    return df.withColumn("coin", base_coin("symbol")).join(meta, "coin", "left")


def merge_meta(fallback: DataFrame, fresh: DataFrame, key: str = "coin") -> DataFrame:
    """Metadata of both sets; a fresh entry replaces the fallback one as a whole."""
    columns = [c for c in fallback.columns if c != key]
    old = fallback.select(key, F.struct(*columns).alias("_old"))
    new = fresh.select(key, F.struct(*columns).alias("_new"))
    return old.join(new, key, "full").select(key, F.coalesce("_new", "_old").alias("_m")).select(key, "_m.*")


def join_watchlist(items: DataFrame, ticker: DataFrame) -> DataFrame:
    """Watchlist rows (symbol, price, change, color) with live values; old ones stay where none came."""
    live = ticker.select(
        "symbol", F.col("price").alias("_price"), F.col("change24h").alias("_change"), F.lit(True).alias("_hit")
    )
    rows = items.join(live, "symbol", "left")
    shown = F.when(F.coalesce("_change", F.lit(0.0)) >= 0, F.lit("green")).otherwise("red")
    return rows.withColumns(
        {
            "price": F.when(F.col("_hit"), F.col("_price")).otherwise(F.col("price")),
            "change": F.coalesce("_change", "change"),
            "color": F.when(F.col("_price") > 0, shown).otherwise(F.col("color")),
        }
    ).drop("_price", "_change", "_hit")


def partition_skew(df: DataFrame, key: str = "symbol", partitions: int = 12) -> DataFrame:
    """Rows and distinct keys each topic partition would receive."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_rows"))
    return (
        counts.groupBy(key_partition(key, partitions).alias("partition"))
        .agg(F.sum("_rows").alias("rows"), F.count(F.lit(1)).alias("keys"))
    )


def page(df: DataFrame, index: int, *order: str, size: int = 10) -> DataFrame:
    """One page of a sorted list; an index past the end gives the last page."""
    last = max(-(-df.count() // size), 1) - 1
    return df.orderBy(*order).offset(min(max(index, 0), last) * size).limit(size)
