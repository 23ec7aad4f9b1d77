"""Gap filling, gap detection and gap repair."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlelake.functions.time import bucket, day_of
from candlelake.operators.candles import last_per_window
from candlelake.operators.filters import time_range
from candlelake.operators.series import CANDLE_CHUNK_ROWS, over_chunks, with_previous
from candlelake.schemas import DAY_MS, GAP_LOOKBACK_MS, MIN_GAP_MS, interval_millis


def gap_fill(df: DataFrame, step: str = "1s", span: str = "1m") -> DataFrame:
    """Candles with every missing step of a non-empty window filled from the previous close, volume 0.

    Each real candle generates the steps up to the next real one (and, as first of its window, those
    before it), so no join with a time grid is needed.
    """
    step_ms, span_ms = interval_millis(step), interval_millis(span)
    window = bucket("open_time", span_ms)
    optional = [c for c in ("quote_volume", "trade_count") if c in df.columns]

    def neighbours(rows: DataFrame, w) -> DataFrame:
        return rows.withColumns(
            {
                "_before": F.lag("open_time").over(w),
                "_close_before": F.lag("close").over(w),
                "_after": F.lead("open_time").over(w),
            }
        )

    rows = over_chunks(df, ["symbol"], ["open_time"], span_ms * CANDLE_CHUNK_ROWS, neighbours)
    first = F.col("_before").isNull() | (F.col("_before") < window)
    end = F.least(F.coalesce("_after", window + span_ms), window + span_ms)
    start = F.when(first, window).otherwise(F.col("open_time"))
    steps = rows.withColumn("_t", F.explode(F.sequence(start, end - step_ms, F.lit(step_ms).cast("bigint"))))
    real = F.col("_t") == F.col("open_time")
    price = F.when(F.col("_t") < F.col("open_time"), F.coalesce("_close_before", "close")).otherwise(F.col("close"))
    return steps.select(
        "symbol",
        F.col("_t").alias("open_time"),
        *[F.when(real, F.col(c)).otherwise(price).alias(c) for c in ("open", "high", "low")],
        price.alias("close"),
        F.when(real, F.col("volume")).otherwise(0.0).alias("volume"),
        *[F.when(real, F.col(c)).otherwise(0).alias(c) for c in optional],
        (~real).alias("filled"),
    )


def coverage(df: DataFrame, step: str = "1s", span: str = "1m") -> DataFrame:
    """Real against expected steps in each non-empty window."""
    expected = interval_millis(span) // interval_millis(step)
    return (
        df.groupBy("symbol", bucket("open_time", interval_millis(span)).alias("_window"))
        .agg(F.count_if(F.col("volume") > 0).alias("real"))
        .select(
            "symbol",
            F.col("_window").alias("open_time"),
            "real",
            F.lit(expected).alias("expected"),
            F.round(F.col("real") / expected, 6).alias("ratio"),
        )
    )


def find_gaps(
    ticks: DataFrame,
    as_of: int,
    min_gap_ms: int = MIN_GAP_MS,
    lookback_ms: int = GAP_LOOKBACK_MS,
    include_backfill: bool = False,
    tie: Sequence[str] = (),
    width_ms: int = DAY_MS,
) -> DataFrame:
    """Gaps longer than ``min_gap_ms`` between the minutes that hold a price, per symbol.

    Rows marked ``source = 'backfill'`` do not count unless asked for, so a repaired gap is found again. A table stored by
    day is read on the days of the look-back alone.
    """
    rows = time_range(ticks, as_of - lookback_ms, as_of, "event_time", max_days=None)
    if "source" in ticks.columns and not include_backfill:
        rows = rows.where(F.col("source").isNull() | (F.col("source") != "backfill"))
    points = last_per_window(rows, 60_000, tie=tie).select("symbol", "event_time")
    spaced = with_previous(points, ["symbol"], ["event_time"], width_ms, _before="event_time")
    elapsed = F.col("event_time") - F.col("_before")
    return spaced.where(elapsed > min_gap_ms).select(
        "symbol",
        (F.col("_before") + 60_000).alias("gap_start"),
        F.col("event_time").alias("gap_end"),
        elapsed.alias("elapsed_ms"),
    )


def repair_gaps(gaps: DataFrame, source: DataFrame, time: str = "kline_start", width_ms: int = DAY_MS) -> DataFrame:
    """Source rows that fall into a gap, both ends included.

    A range join as an equi join: gaps are listed under each time bucket they touch, source rows under
    their own, so the join key is (symbol, bucket) and a busy symbol is spread over its buckets. With buckets of a day, a
    source stored by day is joined on that too, so Spark may prune its partitions by the days of the gaps.
    """
    w = F.lit(width_ms).cast("bigint")
    listed = gaps.select(
        "symbol",
        "gap_start",
        "gap_end",
        F.explode(F.sequence(bucket("gap_start", width_ms), bucket("gap_end", width_ms), w)).alias("_bucket"),
    )
    rows = source.withColumn("_bucket", bucket(time, width_ms))
    inside = F.col(time).between(F.col("gap_start"), F.col("gap_end"))
    key = ["symbol", "_bucket"]
    if "day" in source.columns and width_ms == DAY_MS:
        listed, key = listed.withColumn("day", day_of("_bucket")), [*key, "day"]
    return rows.join(listed, key).where(inside).drop("_bucket")


def gap_days(gaps: DataFrame) -> DataFrame:
    """The days that gaps touch, one row each."""
    step = F.lit(DAY_MS).cast("bigint")
    return gaps.select(F.explode(F.sequence(bucket("gap_start", DAY_MS), bucket("gap_end", DAY_MS), step)).alias("_d")).select(day_of("_d").alias("day")).distinct()


def gap_summary(gaps: DataFrame, repaired: DataFrame | None = None) -> DataFrame:
    """Per symbol: gaps, their total length, gaps that got a row and rows written."""
    found = gaps.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("gaps"), F.sum(F.col("gap_end") - F.col("gap_start")).alias("missing_ms")
    )
    if repaired is None:
        return found
    per_gap = repaired.groupBy("symbol", "gap_start").agg(F.count(F.lit(1)).alias("_rows"))
    done = per_gap.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("filled_gaps"), F.sum("_rows").alias("repaired_rows")
    )
    return found.join(done, "symbol", "left").na.fill(0, ["filled_gaps", "repaired_rows"])
