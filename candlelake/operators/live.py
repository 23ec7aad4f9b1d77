"""Latest-state tables and live candles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlelake.functions.time import bucket
from candlelake.operators.candles import current_bar
from candlelake.operators.filters import require, select_symbols
from candlelake.operators.series import latest
from candlelake.operators.walk import DAY, newest_days
from candlelake.schemas import CANDLE_COLUMNS, interval_millis


def latest_ticker(
    df: DataFrame, symbols: Sequence[str] | DataFrame | None = None, order: Sequence[str] = ("event_time",)
) -> DataFrame:
    """Newest ticker of each symbol: price, 24 h change, bid, ask, volume, time."""
    rows = select_symbols(require(df, "symbol"), symbols)
    return latest(rows, ["symbol"], order)


def ticker_view(df: DataFrame) -> DataFrame:
    """Ticker records under the names a client reads."""
    zero = F.lit(0.0)
    return df.select(
        "symbol",
        F.coalesce("close", zero).alias("price"),
        F.coalesce("h24_price_change_pct", zero).alias("change24h"),
        F.coalesce("bid", zero).alias("bid"),
        F.coalesce("ask", zero).alias("ask"),
        F.coalesce("h24_volume", zero).alias("volume"),
        F.col("event_time"),
    )


def latest_indicators(df: DataFrame, as_map: bool = False) -> DataFrame:
    """Newest indicator row of each symbol; ``as_map`` keeps only the fields that have a value."""
    newest = latest(df, ["symbol"], ["timestamp"])
    if not as_map:
        return newest
    names = [c for c in ("sma20", "sma50", "ema12", "ema26") if c in df.columns]
    pairs = F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*names))
    present = F.map_filter(pairs, lambda _, v: v.isNotNull())
    return newest.select("symbol", present.alias("indicators"), "timestamp")


def enrich_live(
    candles: DataFrame, sub: DataFrame, ticker: DataFrame, interval: str, as_of: int
) -> DataFrame:
    """Candles with the live ticker applied to the newest one.

    While the newest candle's window is open at ``as_of`` and the ticker is newer than every finer
    candle, its price moves close, high and low. A ticker in a newer window appends a flat candle. Only
    one row per symbol decides; it meets the candles on (symbol, open time), so no symbol is gathered. Where candles are
    stored by day, newest times are looked for on the newest days that hold a row of each ticker.
    """
    size = interval_millis(interval)
    recent = lambda df: newest_days(df, ticker.select("symbol"), 1)[0] if DAY in df.columns else df
    last = recent(candles).groupBy("symbol").agg(F.max("open_time").alias("_last"))
    newest_sub = recent(sub).groupBy("symbol").agg(F.max("open_time").alias("_sub"))
    window = bucket("event_time", size)
    live = (
        ticker.where(F.col("price").isNotNull() & (F.col("price") != 0) & F.col("event_time").isNotNull())
        .select("symbol", F.col("price").alias("_price"), "event_time", window.alias("open_time"))
        .join(last, "symbol", "left")
        .join(newest_sub, "symbol", "left")
    )
    known = F.greatest(F.coalesce("_last", F.lit(0)), F.coalesce("_sub", F.lit(0)))
    moves = live.where(
        (F.col("open_time") == F.col("_last"))
        & (F.lit(as_of) < F.col("open_time") + size)
        & (F.col("event_time") > known)
    ).select("symbol", "open_time", "_price")
    opens = live.where(F.col("_last").isNull() | (F.col("open_time") > F.col("_last")))
    price = F.col("_price")
    updated = (
        candles.join(moves, ["symbol", "open_time"], "left")
        .withColumns(
            {
                "close": F.coalesce(price, "close"),
                "high": F.greatest("high", price),
                "low": F.least("low", price),
            }
        )
        .drop("_price")
    )
    flat = opens.select("symbol", "open_time", *[price.alias(c) for c in ("open", "high", "low", "close")], F.lit(0.0).alias("volume"))
    return updated.unionByName(flat, allowMissingColumns=True)


def live_candle(
    sub_1s: DataFrame, sub_1m: DataFrame, ticker: DataFrame, last: DataFrame, interval: str, as_of: int
) -> DataFrame:
    """The candle to show now, one row per symbol.

    It is the current bar of the finer candles, moved by a newer ticker while its window is open (not
    at 1m and below). A ticker in a newer window gives a flat candle; with neither, the last stored
    candle is shown under its own window.
    """
    size = interval_millis(interval)
    if interval == "1s":
        return latest(sub_1s.select(*CANDLE_COLUMNS), ["symbol"], ["open_time"])
    bar = current_bar(sub_1s if interval == "1m" else sub_1m, interval)
    if interval == "1m":
        return bar.drop("source_time")

    measures = ["open", "high", "low", "close", "volume"]
    bars = bar.select("symbol", F.struct("open_time", *measures, "source_time").alias("bar"))
    ticks = ticker.where((F.col("price") != 0) & F.col("event_time").isNotNull()).select(
        "symbol", F.struct("price", "event_time", bucket("event_time", size).alias("window")).alias("tick")
    )
    stored = latest(last.select(*CANDLE_COLUMNS), ["symbol"], ["open_time"]).select("symbol", F.struct(bucket("open_time", size).alias("open_time"), *measures).alias("stored"))
    rows = bars.join(ticks, "symbol", "full").join(stored, "symbol", "full")

    price = F.col("tick.price")
    flat = F.struct(
        F.col("tick.window").alias("open_time"),
        *[price.alias(c) for c in ("open", "high", "low", "close")],
        F.lit(0.0).alias("volume"),
    )
    plain = F.struct(*[F.col(f"bar.{c}").alias(c) for c in ("open_time", *measures)])
    moved = F.struct(
        F.col("bar.open_time").alias("open_time"),
        F.col("bar.open").alias("open"),
        F.greatest("bar.high", price).alias("high"),
        F.least("bar.low", price).alias("low"),
        price.alias("close"),
        F.col("bar.volume").alias("volume"),
    )
    same = F.col("tick.window") == F.col("bar.open_time")
    fresh = (F.col("tick.event_time") > F.col("bar.source_time")) & (F.lit(as_of) < F.col("bar.open_time") + size)
    newer = F.col("tick").isNotNull() & (
        F.col("bar").isNull() | (F.col("tick.window") > F.col("bar.open_time"))
    )
    shown = F.when(same & fresh, moved).when(newer, flat).when(F.col("bar").isNotNull(), plain).otherwise(F.col("stored"))
    return rows.withColumn("shown", shown).where(F.col("shown").isNotNull()).select("symbol", "shown.*")


def incremental(new: DataFrame, stored_last: DataFrame, step_ms: int = 60_000, start: int | None = None) -> DataFrame:
    """Rows of ``new`` from the minute after each symbol's last stored time; a new symbol starts at ``start``, or with its first row."""
    rows = new.join(stored_last, "symbol", "left")
    begin = F.coalesce(F.col("last_time") + step_ms, F.lit(start).cast("bigint"))
    return rows.where(begin.isNull() | (F.col("kline_start") >= begin)).drop("last_time")
