"""Technical indicators over candle series (columns symbol, open_time, high, low, close, volume)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from candlelake.functions.numeric import money_flow, typical_price
from candlelake.operators.recurrence import Smooth, smooth
from candlelake.operators.series import CANDLE_CHUNK_ROWS, over_chunks, with_index, with_previous
from candlelake.schemas import interval_millis

KEYS = ["symbol"]
ORDER = ["open_time"]

# Thresholds (high, low) an oscillator is judged by.
RSI_LEVELS = (70.0, 30.0)
MFI_LEVELS = (80.0, 20.0)


def _width(interval: str) -> int:
    return interval_millis(interval) * CANDLE_CHUNK_ROWS


def _frame(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(-(n - 1), Window.currentRow)


def sma(
    df: DataFrame, interval: str, *periods: int, scale: int = 8, drop_warmup: bool = False, width_ms: int | None = None
) -> DataFrame:
    """Simple moving averages ``sma<n>`` of the close; NULL until n candles are there."""

    def build(rows: DataFrame, w: WindowSpec) -> DataFrame:
        # The borrowed rows are all there are before a chunk, so the position in it tells a full frame.
        seen = F.row_number().over(w)
        return rows.withColumns(
            {f"sma{n}": F.when(seen >= n, F.round(F.avg("close").over(_frame(w, n)), scale)) for n in periods}
        )

    out = over_chunks(df, KEYS, ORDER, width_ms or _width(interval), build, lookback=max(max(periods) - 1, 1))
    if drop_warmup:
        for n in periods:
            out = out.where(F.col(f"sma{n}").isNotNull())
    return out


def ema(
    df: DataFrame, interval: str, n: int, seed: str = "first", scale: int = 8, name: str | None = None
) -> DataFrame:
    """Exponential moving average with k = 2 / (n + 1).

    ``seed="first"`` starts at the first close and has a value on every row. ``seed="sma"`` starts with
    the mean of the first n closes and returns rows from there on.
    """
    if seed not in ("first", "sma"):
        raise ValueError(f"unknown seed {seed!r}")
    name = name or f"ema{n}"
    out = smooth(df, KEYS, ORDER, "close", [_ema(n, name, seed)], interval_millis(interval))
    if seed == "sma":
        out = out.where(F.col("idx") >= n - 1)
    return out.withColumn(name, F.round(name, scale)).drop("idx")


def _ema(n: int, name: str, seed: str = "first") -> Smooth:
    return Smooth(name, 1 - 2 / (n + 1), n if seed == "sma" else 0)


def rsi(df: DataFrame, interval: str, n: int = 14, scale: int = 2) -> DataFrame:
    """Relative strength index with Wilder smoothing; rows from the n-th change on.

    A row without a change has the value of the last row that moved, also where both averages have long become too small
    for a double. Before any loss the smoothed loss is exactly 0.
    """
    a = (n - 1) / n
    out = smooth(df, KEYS, ORDER, "close", [Smooth("_up", a, n, 1), Smooth("_down", a, n, -1)], interval_millis(interval))
    gone = (F.col("_up") <= 0) & (F.col("_down") <= 0)
    up, down = (F.when(gone, F.col("_moved")[side]).otherwise(F.col(f"_{side}")) for side in ("up", "down"))
    value = F.when(F.coalesce(down, F.lit(0.0)) <= 0, 100.0).otherwise(100 - 100 / (1 + up / F.when(down > 0, down).otherwise(1.0)))
    return out.where(F.col("idx") >= n).withColumn("rsi", F.round(value, scale)).drop("idx", "_up", "_down", "_moved")


def mfi(df: DataFrame, interval: str, n: int = 14, scale: int = 2, width_ms: int | None = None) -> DataFrame:
    """Money flow index over the last n flows; rows from the n-th flow on."""

    def build(rows: DataFrame, w: WindowSpec) -> DataFrame:
        flows = rows.withColumns({"_tp": typical_price(), "_mf": money_flow()}).withColumn(
            "_before", F.lag("_tp").over(w)
        )
        rising = F.col("_tp") >= F.col("_before")
        frame = _frame(w, n)
        return flows.withColumns(
            {
                "_pos": F.sum(F.when(rising, F.col("_mf")).otherwise(0.0)).over(frame),
                "_neg": F.sum(F.when(rising, 0.0).otherwise(F.col("_mf"))).over(frame),
                "_flows": F.row_number().over(w) - 1,
            }
        )

    flows = over_chunks(df, KEYS, ORDER, width_ms or _width(interval), build, lookback=n)
    value = F.when(F.col("_neg") == 0, 100.0).otherwise(
        100 - 100 / (1 + F.col("_pos") / F.when(F.col("_neg") == 0, 1.0).otherwise(F.col("_neg")))
    )
    return (
        flows.where(F.col("_flows") >= n)
        .withColumn("mfi", F.round(value, scale))
        .drop("_tp", "_mf", "_before", "_pos", "_neg", "_flows")
    )


def threshold_flags(
    df: DataFrame, column: str, high: float, low: float, interval: str | None = None
) -> DataFrame:
    """Add ``zone`` (overbought, oversold, neutral); with an interval also ``crossed`` into a new zone."""
    zone = (
        F.when(F.col(column) >= high, F.lit("overbought")).when(F.col(column) <= low, F.lit("oversold")).otherwise("neutral")
    )
    out = df.withColumn("zone", zone)
    if interval is None:
        return out
    out = with_previous(out, KEYS, ORDER, _width(interval), _before="zone")
    crossed = F.col("_before").isNotNull() & (F.col("_before") != F.col("zone"))
    return out.withColumn("crossed", crossed).drop("_before")


def normalize_series(df: DataFrame, interval: str, places: int = 6) -> DataFrame:
    """Position of each close in its series: ``x`` by index and ``y`` by range, both 0 to 1."""
    extent = df.groupBy("symbol").agg(
        F.min("close").alias("_min"), F.max("close").alias("_max"), F.count(F.lit(1)).alias("_n")
    )
    span = F.col("_max") - F.col("_min")
    steps = F.col("_n") - 1
    return (
        with_index(df, KEYS, ORDER, _width(interval))
        .join(extent, "symbol")
        .select(
            "symbol",
            "open_time",
            "close",
            F.round(F.when(steps > 0, F.col("idx") / F.when(steps > 0, steps).otherwise(1)).otherwise(0.0), places).alias("x"),
            F.round((F.col("close") - F.col("_min")) / F.when(span == 0, 1.0).otherwise(span), places).alias("y"),
        )
    )


def indicator_table(df: DataFrame, interval: str = "1m", scale: int = 8) -> DataFrame:
    """The stored indicator row of each closed candle: sma20, sma50, ema12, ema26 and the close."""
    out = smooth(df.select("symbol", "open_time", "close"), KEYS, ORDER, "close", [_ema(n, f"ema{n}") for n in (12, 26)], interval_millis(interval), (20, 50))
    found = [F.round(c, scale).alias(name) for c, name in (("mean20", "sma20"), ("mean50", "sma50"), ("ema12", "ema12"), ("ema26", "ema26"))]
    return out.select("symbol", F.col("open_time").alias("timestamp"), "close", *found)


_REGISTRY: dict[str, Callable[..., DataFrame]] = {"sma": sma, "ema": ema, "rsi": rsi, "mfi": mfi}


def register_indicator(name: str, fn: Callable[..., DataFrame]) -> None:
    """Make ``fn(df, interval, ...) -> DataFrame`` available under a name."""
    _REGISTRY[name] = fn


def indicator(name: str, df: DataFrame, interval: str, *args, **kwargs) -> DataFrame:
    """Run a registered indicator."""
    if name not in _REGISTRY:
        raise KeyError(f"no indicator named {name!r}")
    return _REGISTRY[name](df, interval, *args, **kwargs)
