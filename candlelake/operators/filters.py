"""Row filters and projections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlelake.functions.text import clean_symbol, is_symbol
from candlelake.functions.time import day_of, to_timestamp
from candlelake.schemas import DAY_MS

#: Short names of a stored candle and the columns they stand for.
PACKED = {
    "t": ("open_time", "bigint"),
    "o": ("open", "double"),
    "h": ("high", "double"),
    "l": ("low", "double"),
    "c": ("close", "double"),
    "v": ("volume", "double"),
    "qv": ("quote_volume", "double"),
    "n": ("trade_count", "bigint"),
    "x": ("is_closed", "boolean"),
}


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Drop rows where one of the columns is NULL or an empty text."""
    for c in columns:
        keep = F.col(c).isNotNull()
        if df.schema[c].dataType.typeName() == "string":
            keep = keep & (F.col(c) != "")
        df = df.where(keep)
    return df


def closed_only(df: DataFrame, interval: str | None = None) -> DataFrame:
    """Closed candles, of one interval if it is given."""
    out = df.where(F.col("is_closed"))
    return out if interval is None else out.where(F.col("interval") == interval)


def quote_filter(df: DataFrame, quote: str = "USDT", symbol: str = "symbol") -> DataFrame:
    return df.where(F.col(symbol).endswith(quote))


def normalize_symbol(df: DataFrame, symbol: str = "symbol", keep_rejects: bool = False) -> DataFrame:
    """Clean the symbol; drop malformed ones, or keep them and add ``valid`` with ``keep_rejects``."""
    out = df.withColumn(symbol, clean_symbol(symbol))
    valid = F.coalesce(is_symbol(symbol), F.lit(False))
    return out.withColumn("valid", valid) if keep_rejects else out.where(valid)


def time_range(
    df: DataFrame, start: int, end: int, time: str = "open_time", max_days: int | None = None
) -> DataFrame:
    """Rows in ``[start, end)``. A table with a ``day`` column is also pruned to the days in range.

    ``max_days`` refuses longer ranges, as a service may want to (``MAX_RANGE_DAYS``); by default none is too long.
    """
    if end <= start:
        raise ValueError("end must be greater than start")
    if max_days is not None and end - start > max_days * DAY_MS:
        raise ValueError(f"range cannot exceed {max_days} days")
    return before(df.where(F.col(time) >= start), end, time, start)


def before(df: DataFrame, end: int, time: str = "open_time", start: int | None = None) -> DataFrame:
    """Rows before ``end``, with the partition predicate that follows from the bounds."""
    out = df.where(F.col(time) < end)
    if "day" in df.columns:
        out = out.where(F.col("day") <= day_of(F.lit(end - 1).cast("bigint")))
        if start is not None:
            out = out.where(F.col("day") >= day_of(F.lit(start).cast("bigint")))
    return out


def last_hours(df: DataFrame, hours: int, as_of: int, time: str = "open_time") -> DataFrame:
    return time_range(df, as_of - hours * 3_600_000, as_of, time, max_days=None)


def with_timestamps(
    df: DataFrame, ingested_at: Column | None = None, **columns: str
) -> DataFrame:
    """Add a timestamp column for each ``new=epoch_ms_column`` pair, and the time of ingestion."""
    out = df.withColumns({new: to_timestamp(old) for new, old in columns.items()})
    return out.withColumn("ingested_at", F.current_timestamp() if ingested_at is None else ingested_at)


def to_candles(df: DataFrame, seconds: bool = False) -> DataFrame:
    """Project to the record a chart reads: ``openTime`` in ms, or ``time`` in seconds."""
    when = F.col("open_time").cast("bigint")
    head = F.floor(when / 1000).alias("time") if seconds else when.alias("openTime")
    prices = [F.col(c).cast("double").alias(c) for c in ("open", "high", "low", "close", "volume")]
    keys = [F.col("symbol")] if "symbol" in df.columns else []
    return df.select(*keys, head, *prices)


def select_symbols(df: DataFrame, symbols: Sequence[str] | DataFrame | None, symbol: str = "symbol") -> DataFrame:
    """Keep the listed symbols: a short literal list, or a table of symbols of any size."""
    if symbols is None:
        return df
    if isinstance(symbols, DataFrame):
        return df.join(symbols.select(symbol).distinct(), symbol, "left_semi")
    return df.where(F.col(symbol).isin(list(symbols)))


def search_symbols(df: DataFrame, text: str, symbol: str = "symbol", name: str = "name") -> DataFrame:
    """Rows whose symbol or name contains the text, upper and lower case alike."""
    if not text:
        return df
    wanted = F.lit(text.lower())
    hit = F.lower(symbol).contains(wanted)
    if name in df.columns:
        hit = hit | F.coalesce(F.lower(name).contains(wanted), F.lit(False))
    return df.where(hit)


def pack_candle(df: DataFrame, name: str = "candle") -> DataFrame:
    """Symbol, time and the candle as compact JSON."""
    body = F.struct(*[F.col(c).cast(kind).alias(k) for k, (c, kind) in PACKED.items() if c in df.columns])
    return df.select("symbol", "open_time", F.to_json(body).alias(name))


def unpack_candle(df: DataFrame, name: str = "candle") -> DataFrame:
    ddl = ", ".join(f"{k} {kind}" for k, (_, kind) in PACKED.items())
    body = df.select("symbol", F.from_json(name, ddl).alias("_c"))
    return body.select("symbol", *[F.col(f"_c.{k}").alias(c) for k, (c, _) in PACKED.items()])
