"""Building candles: from trades, from finer candles, and per window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlelake.functions.time import bucket
from candlelake.operators.merge import best_candles
from candlelake.operators.series import CANDLE_CHUNK_ROWS, latest, over_chunks
from candlelake.operators.walk import newest_days
from candlelake.schemas import CANDLE_COLUMNS, interval_millis

#: Places candle sums are rounded to.
SUM_PLACES = 8


def _total(column: str):
    return F.round(F.sum(column), SUM_PLACES).alias(column)


def trades_to_candles(
    trades: DataFrame, interval: str, time: str = "trade_time", tie: Sequence[str] = ("agg_trade_id",)
) -> DataFrame:
    """Candles of an interval from (symbol, time, price, quantity) rows.

    One partial-and-final aggregate: open and close are the prices with the lowest and highest
    (time, tie) and are reduced before the shuffle like any other aggregate.
    """
    size = interval_millis(interval)
    order = F.struct(time, *tie) if tie else F.col(time)
    return trades.groupBy("symbol", bucket(time, size).alias("open_time")).agg(
        F.min_by("price", order).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order).alias("close"),
        F.round(F.sum("quantity"), SUM_PLACES).alias("volume"),
        F.round(F.sum(F.col("price") * F.col("quantity")), SUM_PLACES).alias("quote_volume"),
        F.count(F.lit(1)).alias("trade_count"),
    )


def resample(df: DataFrame, interval: str, unique: bool = False, base: str | None = None) -> DataFrame:
    """Candles of a longer interval.

    Copies of a candle are first reduced to the best one. ``unique`` skips that step (and its shuffle)
    where the input is known to hold one row per symbol and time, as our own tables do. ``base`` is the
    interval of the input, if known: a target below it is refused.
    """
    size = interval_millis(interval)
    if base is not None and size < interval_millis(base):
        raise ValueError(f"cannot resample {base} candles to {interval}")
    rows = df if unique else best_candles(df)
    sums = [_total(c) for c in ("volume", "quote_volume", "trade_count") if c in df.columns]
    return rows.groupBy("symbol", bucket("open_time", size).alias("_bucket")).agg(
        F.min_by("open", "open_time").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "open_time").alias("close"),
        *sums,
    ).withColumnRenamed("_bucket", "open_time")


def rollup(df: DataFrame, step: str = "1s", span: str = "1m", arrival: Sequence[str] = ()) -> DataFrame:
    """Closed ``span`` candles from ``step`` candles, as if missing steps were forward-filled.

    The filled rows are never built. A fill repeats a close, so it can only change a window whose first
    step is missing: that window opens at the previous window's close, and high and low must cover that
    price. Windows without any real row are not emitted. ``arrival`` orders copies of one step; the last
    one wins.
    """
    width = interval_millis(span)
    rows = latest(df, ["symbol", "open_time"], list(arrival)) if arrival else df
    bars = rows.groupBy("symbol", bucket("open_time", width).alias("_window")).agg(
        F.min("open_time").alias("_first"),
        F.min_by("open", "open_time").alias("open"),
        F.min_by("close", "open_time").alias("_first_close"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "open_time").alias("close"),
        _total("volume"),
        _total("quote_volume"),
        F.sum("trade_count").alias("trade_count"),
        F.count_if(F.col("volume") > 0).alias("real_steps"),
    ).withColumnRenamed("_window", "open_time")

    def carry(rows: DataFrame, w) -> DataFrame:
        seed = F.coalesce(F.lag("close").over(w), F.col("_first_close"))
        return rows.withColumn("_seed", F.when(F.col("_first") > F.col("open_time"), seed))

    carried = over_chunks(bars, ["symbol"], ["open_time"], width * CANDLE_CHUNK_ROWS, carry)
    return carried.select(
        (F.col("open_time") + (width - 1)).alias("event_time"),
        "symbol",
        F.col("open_time").alias("kline_start"),
        (F.col("open_time") + (width - 1)).alias("kline_close"),
        F.lit(span).alias("interval"),
        F.coalesce("_seed", "open").alias("open"),
        F.greatest("high", "_seed").alias("high"),
        F.least("low", "_seed").alias("low"),
        "close",
        "volume",
        "quote_volume",
        "trade_count",
        F.lit(True).alias("is_closed"),
        "real_steps",
    )


def current_bar(df: DataFrame, interval: str, symbols: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """The newest window of each symbol, aggregated from its finer candles, and the newest of those.

    With ``symbols``, only the newest days of a table stored by day are read, as many as these symbols need.
    """
    size = interval_millis(interval)
    rows = newest_days(df, symbols, 1, unit_ms=size)[0]
    bars = rows.groupBy("symbol", bucket("open_time", size).alias("_bucket")).agg(
        F.min_by("open", "open_time").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "open_time").alias("close"),
        _total("volume"),
        F.max("open_time").alias("source_time"),
    ).withColumnRenamed("_bucket", "open_time")
    return latest(bars, ["symbol"], ["open_time"]).select(*CANDLE_COLUMNS, "source_time")


def rollup_hourly(df: DataFrame) -> DataFrame:
    """Rows of the hourly table, from finer candles."""
    return resample(df, "1h")


def last_time(
    table: DataFrame, time: str = "kline_start", interval: str | None = "1m", symbols: Sequence[str] | DataFrame | None = None
) -> DataFrame:
    """Last stored time of each symbol; with ``symbols`` of these, out of the newest days that hold a row of each."""
    rows = table if interval is None else table.where(F.col("interval") == interval)
    return newest_days(rows, symbols, 1, time=time)[0].groupBy("symbol").agg(F.max(time).alias("last_time"))


def last_per_window(
    df: DataFrame, window_ms: int = 60_000, time: str = "event_time", value: str = "price", tie: Sequence[str] = ()
) -> DataFrame:
    """Last value in each window, stamped with the end of the window; empty windows are skipped."""
    order = F.struct(time, *tie) if tie else F.col(time)
    return df.groupBy("symbol", (bucket(time, window_ms) + window_ms).alias("_end")).agg(
        F.max_by(value, order).alias(value)
    ).withColumnRenamed("_end", time)


def overview(df: DataFrame) -> DataFrame:
    """Range summary of each symbol: high, low, volume, change and position of the last close."""
    total = df.groupBy("symbol").agg(
        F.min_by("open", "open_time").alias("first_open"),
        F.max_by("close", "open_time").alias("last_close"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        _total("volume"),
    )
    change = F.col("last_close") - F.col("first_open")
    span = F.col("high") - F.col("low")
    return total.select(
        "symbol",
        "last_close",
        "high",
        "low",
        "volume",
        F.round(change, 8).alias("change"),
        F.when(F.col("first_open") != 0, F.round(change / F.col("first_open") * 100, 2)).alias("change_pct"),
        F.round((F.col("last_close") - F.col("low")) / F.when(span == 0, 1.0).otherwise(span) * 100, 6).alias(
            "position_pct"
        ),
        (change >= 0).alias("is_up"),
    )
