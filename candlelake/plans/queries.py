"""Candle queries over hot, warm and cold tiers, for all symbols in one plan.

Tiers are candle DataFrames (columns symbol, open_time, open, high, low, close, volume and optionally
is_closed). ``as_of`` stands for the present, so that a query gives the same answer every time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlelake.functions.time import bucket
from candlelake.operators.candles import resample
from candlelake.operators.filters import time_range
from candlelake.operators.merge import best_by_volume, fill_from_hourly, merge_candles
from candlelake.operators.series import last_n, latest
from candlelake.operators.walk import newest_days
from candlelake.schemas import CANDLE_COLUMNS, DAY_MS, RETENTION_DAYS, interval_millis

#: Candles a chunk of the two-step limit covers.
LIMIT_CHUNK = 10_000


def retention_cutoff(as_of: int, interval: str = "1m") -> int:
    """Time before which the warm tier no longer holds candles of an interval."""
    return as_of - RETENTION_DAYS[interval] * DAY_MS


def tiered_read(warm: DataFrame, cold: DataFrame, start: int, end: int, cutoff: int) -> DataFrame:
    """Candles in ``[start, end)``: from the cutoff on out of the warm tier, before it out of the cold one.

    The bounds are literals, so a tier that the range does not touch is not part of the plan.
    """
    parts = []
    if end > max(start, cutoff):
        parts.append(time_range(warm, max(start, cutoff), end, max_days=None))
    if min(end, cutoff) > start:
        parts.append(time_range(cold, start, min(end, cutoff), max_days=None))
    return merge_candles(*parts)


def collect_base(
    warm: DataFrame, cold: DataFrame, interval: str, limit: int, end: int, cutoff: int, symbols: Sequence[str] | DataFrame | None = None
) -> DataFrame:
    """Base candles of the last ``limit`` non-empty buckets before ``end``, per symbol.

    With ``symbols``, tiers that are stored by day are walked back from ``end`` as far as these need (see
    ``newest_days``), and the cold tier is left out where the warm one has enough.
    """
    return _last_buckets(_base(warm, cold, interval, limit, end, cutoff, symbols), interval_millis(interval), limit)


def _base(
    warm: DataFrame, cold: DataFrame, interval: str, limit: int, end: int, cutoff: int, symbols: Sequence[str] | DataFrame | None
) -> DataFrame:
    """One row per symbol and time: at least the last ``limit`` buckets before ``end``."""
    size = interval_millis(interval)
    recent, enough = newest_days(warm, symbols, limit, end, unit_ms=size, start=cutoff)
    if enough:
        return merge_candles(recent)
    older, _ = newest_days(cold, symbols, limit, min(end, cutoff), unit_ms=size)
    return merge_candles(recent.drop("day"), older.drop("day"))


def _last_buckets(base: DataFrame, size: int, limit: int) -> DataFrame:
    """Rows of the newest ``limit`` buckets of each symbol, so that each of these buckets is whole."""
    marked = base.withColumn("_bucket", bucket("open_time", size))
    buckets = marked.select("symbol", "_bucket").distinct()
    wanted = last_n(buckets, limit, ["symbol"], ["_bucket"], size * LIMIT_CHUNK)
    return marked.join(wanted, ["symbol", "_bucket"], "left_semi").drop("_bucket")


def _newest(df: DataFrame, interval: str, limit: int) -> DataFrame:
    """Newest candles, ascending within each symbol (the limit already gathered a symbol's few rows)."""
    rows = last_n(df, limit, ["symbol"], ["open_time"], interval_millis(interval) * LIMIT_CHUNK)
    return rows.select(*CANDLE_COLUMNS).sortWithinPartitions("symbol", "open_time")


def historical(
    warm: DataFrame,
    cold: DataFrame,
    hourly: DataFrame,
    interval: str,
    start: int,
    end: int,
    cutoff: int,
    limit: int = 500,
) -> DataFrame:
    """Candles of an interval in ``[start, end)``: both tiers, hourly rows for hours without fine ones."""
    size = interval_millis(interval)
    if size < interval_millis("1m"):
        raise ValueError("historical candles start at 1m")
    time_range(warm, start, end)  # refuses a bad range
    base = tiered_read(warm, cold, start, end, cutoff)
    if size >= interval_millis("1h"):
        base = fill_from_hourly(base, time_range(hourly, start, end, max_days=None))
    out = base if interval == "1m" else resample(base, interval, unique=True)
    return _newest(out.where((F.col("open_time") >= start) & (F.col("open_time") < end)), interval, limit)


def klines(
    hot: DataFrame,
    warm: DataFrame,
    cold: DataFrame,
    hourly: DataFrame,
    ticker: DataFrame,
    interval: str,
    limit: int,
    as_of: int,
    end: int | None = None,
    arrival: str = "open_time",
    symbols: Sequence[str] | DataFrame | None = None,
) -> DataFrame:
    """The newest ``limit`` candles of an interval, before ``end`` or as of now with the live ticker applied.

    ``symbols`` bounds what is read of tiers stored by day, as in ``collect_base``. One aggregate gives a bucket's candle
    and its newest finer candle; after the limit a symbol's candles are one row, which meets its ticker.
    """
    size = interval_millis(interval)
    if interval == "1s":
        hot = newest_days(hot, symbols, limit, end, unit_ms=size)[0]  # copies of a second count once
        return _newest(best_by_volume(hot, arrival), interval, limit)
    upto = as_of + 1 if end is None else end
    base = _base(warm, cold, interval, limit, upto, retention_cutoff(as_of), symbols)
    base = base.select(*CANDLE_COLUMNS, F.col("open_time").alias("_sub"))
    hour = interval_millis("1h")
    if size >= hour:
        # An hourly row counts for an hour without finer rows.
        coarse = newest_days(hourly, symbols, limit, upto, unit_ms=size)[0].select(*CANDLE_COLUMNS, F.col("open_time").alias("_sub"), F.lit(0).alias("_fine"))
        hours = _bars(base, hour).withColumn("_fine", F.lit(1)).unionByName(coarse.withColumn("open_time", bucket("open_time", hour)))
        base = latest(hours, ["symbol", "open_time"], ["_fine"]).drop("_fine")
    out = base if interval == "1m" else _bars(base, size)
    if end is not None:
        return _newest(out.where(F.col("open_time") < end), interval, limit)
    if interval == "1m":
        return _newest(out, interval, limit)
    return _with_ticker(last_n(out, limit, ["symbol"], ["open_time"], size * LIMIT_CHUNK), ticker, size, as_of, limit)


def _bars(rows: DataFrame, size: int) -> DataFrame:
    """Candles of ``size``, with the newest finer candle of each as ``_sub``."""
    return rows.groupBy("symbol", bucket("open_time", size).alias("_bucket")).agg(
        F.min_by("open", "open_time").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "open_time").alias("close"),
        F.round(F.sum("volume"), 8).alias("volume"),
        F.max("_sub").alias("_sub"),
    ).withColumnRenamed("_bucket", "open_time")


def _with_ticker(newest: DataFrame, ticker: DataFrame, size: int, as_of: int, limit: int) -> DataFrame:
    """The newest candles of each symbol with its ticker applied, by the rule of ``enrich_live``."""
    fields = [c for c in CANDLE_COLUMNS if c != "symbol"]
    rows = newest.groupBy("symbol").agg(F.sort_array(F.collect_list(F.struct(*fields, "_sub"))).alias("_candles"))
    price = F.col("_price")
    live = ticker.where(F.col("price").isNotNull() & (F.col("price") != 0) & F.col("event_time").isNotNull()).select(
        "symbol", F.col("price").alias("_price"), F.col("event_time").alias("_time"), bucket("event_time", size).alias("_window")
    )
    both = rows.join(live, "symbol", "full").withColumn("_last", F.try_element_at("_candles", F.lit(-1)))
    last = F.col("_last")
    open_ = (F.col("_window") == last["open_time"]) & (F.lit(as_of) < F.col("_window") + size)
    moves = open_ & (F.col("_time") > F.greatest(last["open_time"], last["_sub"]))
    moved = {"high": F.greatest(last["high"], price), "low": F.least(last["low"], price), "close": price}
    flat = {"open_time": F.col("_window"), "volume": F.lit(0.0), "_sub": F.col("_window")}
    with_moved = F.concat(F.slice("_candles", 1, F.size("_candles") - 1), F.array(F.struct(*[moved.get(c, last[c]).alias(c) for c in [*fields, "_sub"]])))
    with_flat = F.concat(F.coalesce("_candles", F.slice("_candles", 1, 0), F.array().cast(rows.schema["_candles"].dataType)), F.array(F.struct(*[flat.get(c, price).alias(c) for c in [*fields, "_sub"]])))
    opens = price.isNotNull() & (last.isNull() | (F.col("_window") > last["open_time"]))
    shown = F.when(moves, with_moved).when(opens, F.slice(with_flat, F.greatest(F.size(with_flat) - limit + 1, F.lit(1)), limit)).otherwise(F.col("_candles"))
    return both.select("symbol", F.inline(shown)).select(*CANDLE_COLUMNS)
