"""Merging overlapping candle sets by quality, and comparing or extending them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlelake.functions.time import bucket
from candlelake.operators.series import TICK_CHUNK_MS, last_n, latest, running_max
from candlelake.schemas import DAY_MS

KEY = ["symbol", "open_time"]
RANK = "_rank"


def _quality(columns: list[str], position: str | None) -> list:
    """Ordering of copies of one candle: closed, then volume, then later tier, then later row."""
    closed = [F.coalesce(F.col("is_closed"), F.lit(False))] if "is_closed" in columns else []
    out = [*closed, F.coalesce(F.col("volume"), F.lit(0.0))]
    if RANK in columns:
        out.append(F.col(RANK))
    if position:
        out.append(F.col(position))
    return out


def best_candles(df: DataFrame, position: str | None = None) -> DataFrame:
    """One row per symbol and open time: the best copy.

    An aggregate rather than a ranked window: copies are reduced before the shuffle, so a candle with
    very many copies does not pile up in one task.
    """
    return latest(df, KEY, _quality(df.columns, position))


def merge_candles(*tiers: DataFrame, position: str | None = None) -> DataFrame:
    """Union of candle sets by open time; on a clash the better candle wins, later tiers win ties."""
    ranked = [t.withColumn(RANK, F.lit(i)) for i, t in enumerate(tiers)]
    everything = ranked[0]
    for tier in ranked[1:]:
        everything = everything.unionByName(tier, allowMissingColumns=True)
    return best_candles(everything, position).drop(RANK)


def best_by_volume(df: DataFrame, arrival: str) -> DataFrame:
    """One row per symbol and open time: the largest volume, the first arrival among equals."""
    return latest(df, KEY, [F.col("volume"), -F.col(arrival)])


def fill_from_hourly(fine: DataFrame, hourly: DataFrame) -> DataFrame:
    """Fine candles plus the hourly ones of hours that hold no fine candle at all."""
    hour = bucket("open_time", 3_600_000)
    covered = fine.select("symbol", hour.alias("_hour")).distinct()
    missing = hourly.withColumn("_hour", hour).join(covered, ["symbol", "_hour"], "left_anti").drop("_hour")
    return fine.unionByName(missing, allowMissingColumns=True)


def prepend_older(live: DataFrame, older: DataFrame) -> DataFrame:
    """Live candles plus older ones from before each symbol's earliest live candle."""
    first = live.groupBy("symbol").agg(F.min("open_time").alias("_first"))
    keep = older.join(first, "symbol", "left").where(
        F.col("_first").isNull() | (F.col("open_time") < F.col("_first"))
    )
    return live.unionByName(keep.drop("_first"), allowMissingColumns=True)


def diff_candles(old: DataFrame, new: DataFrame, skip_last: bool = True) -> DataFrame:
    """Rows of ``new`` that change or extend ``old``, with ``change`` = ``updated`` or ``added``.

    Added rows lie after the symbol's last old candle. ``skip_last`` leaves that last candle alone.
    """
    watched = ["close", "high", "low", "volume"]
    last = old.groupBy("symbol").agg(F.max("open_time").alias("_last"))
    known = old.select(*KEY, F.struct(*watched).alias("_old"))
    rows = new.join(known, KEY, "left").join(last, "symbol", "left")
    differs = F.col("_old").isNotNull() & ~F.struct(*watched).eqNullSafe(F.col("_old"))
    if skip_last:
        differs = differs & (F.col("open_time") != F.col("_last"))
    added = F.col("_old").isNull() & (F.col("_last").isNull() | (F.col("open_time") > F.col("_last")))
    change = F.when(differs, F.lit("updated")).when(added, F.lit("added"))
    return rows.withColumn("change", change).where(F.col("change").isNotNull()).drop("_old", "_last")


def cap_series(df: DataFrame, rows: int, width_ms: int | None = None) -> DataFrame:
    """Keep the newest ``rows`` candles of each symbol.

    The limit is taken per time chunk of ``width_ms`` first, so that no task of the final limit gets a whole series; as
    wide as a day by default.
    """
    return last_n(df, rows, ["symbol"], ["open_time"], width_ms or DAY_MS)


def apply_update(
    series: DataFrame, update: DataFrame, interval: str, arrival: str = "seq", width_ms: int = TICK_CHUNK_MS,
    cap: int | None = None,
) -> DataFrame:
    """Apply live candle updates in order of arrival.

    At 1s only a candle newer than everything before it is taken. At other intervals a candle with the
    newest time so far replaces or extends the series. Anything older is ignored. With ``cap`` only
    that many newest candles of each symbol stay (a chart keeps ``SERIES_CAP`` at 1s, else ``SERIES_CAP_DEFAULT``).
    """
    newest = series.groupBy("symbol").agg(F.max("open_time").alias("_newest"))
    columns = series.columns
    seen = running_max(update, ["symbol"], [arrival, "open_time"], "open_time", width_ms, "_seen").join(newest, "symbol", "left")
    floor = F.greatest("_seen", "_newest")
    fresh = F.col("open_time") > floor if interval == "1s" else F.col("open_time") >= floor
    taken = seen.where(floor.isNull() | fresh)
    both = series.withColumn("_order", F.lit(None).cast("bigint")).unionByName(
        taken.select(*columns, F.col(arrival).cast("bigint").alias("_order"))
    )
    merged = latest(both, KEY, [F.coalesce(F.col("_order"), F.lit(-(2**63)).cast("bigint"))]).drop("_order")
    return merged if cap is None else cap_series(merged, cap)
