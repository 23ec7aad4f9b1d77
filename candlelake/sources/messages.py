"""Exchange messages (JSON text) to canonical records.

Each parser takes a DataFrame with a text column and returns the record's columns. Every field is read
as text first, because exchanges send numbers both as numbers and as strings. A message without its
required fields gives no row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from candlelake.functions.numeric import number, pct_change
from candlelake.operators.book import levels_json
from candlelake.schemas import LEVELS_DDL

# Message keys of each record field, in record order, and the type they are cast to.
TICKER_KEYS = [
    ("close", "c", "double"),
    ("bid", "b", "double"),
    ("ask", "a", "double"),
    ("h24_open", "o", "double"),
    ("h24_high", "h", "double"),
    ("h24_low", "l", "double"),
    ("h24_volume", "v", "double"),
    ("h24_quote_volume", "q", "double"),
    ("h24_price_change", "p", "double"),
    ("h24_price_change_pct", "P", "double"),
    ("h24_trade_count", "n", "bigint"),
]
KLINE_KEYS = [
    ("kline_start", "t", "bigint"),
    ("kline_close", "T", "bigint"),
    ("interval", "i", "string"),
    ("open", "o", "double"),
    ("high", "h", "double"),
    ("low", "l", "double"),
    ("close", "c", "double"),
    ("volume", "v", "double"),
    ("quote_volume", "q", "double"),
    ("trade_count", "n", "bigint"),
    ("is_closed", "x", "boolean"),
]
TRADE_KEYS = [
    ("agg_trade_id", "a", "bigint"),
    ("price", "p", "double"),
    ("quantity", "q", "double"),
    ("trade_time", "T", "bigint"),
    ("is_buyer_maker", "m", "boolean"),
]
# Slots of a positional kline row.
ROW_SLOTS = {
    "kline_start": (0, "bigint"),
    "open": (1, "double"),
    "high": (2, "double"),
    "low": (3, "double"),
    "close": (4, "double"),
    "volume": (5, "double"),
    "kline_close": (6, "bigint"),
    "quote_volume": (7, "double"),
    "trade_count": (8, "bigint"),
}

# Field names differ only in case ("p" and "P"), which a struct cannot hold when names are matched
# without case. A map keeps the keys as they are.
TEXT_MAP = "map<string,string>"


def _cast(value: Column, kind: str) -> Column:
    return value if kind == "string" else value.try_cast(kind)


def _head(m: Column) -> list[Column]:
    return [m["E"].try_cast("bigint").alias("event_time"), m["s"].alias("symbol")]


def _complete(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.where(F.col(c).isNotNull())
    return df


def _parsed(df: DataFrame, parsed: Column, *keep: str | Column, name: str = "_m") -> DataFrame:
    """Parse a message once per row.

    Filters on parsed fields would otherwise be pushed below the projection and parse the text again for
    each of them. A generator over the one parsed value stops that.
    """
    return df.select(*keep, F.explode(F.array(parsed)).alias(name))


def ticker_fields(m: Column, strict: bool = False) -> list[Column]:
    return [number(m[k], kind, strict).alias(c) for c, k, kind in TICKER_KEYS]


def parse_ticker(df: DataFrame, raw: str = "raw", strict: bool = False) -> DataFrame:
    """Ticker messages; absent numbers become 0, or NULL with ``strict``."""
    m = F.col("_m")
    rows = _parsed(df, F.from_json(raw, TEXT_MAP)).select(*_head(m), *ticker_fields(m, strict))
    return _complete(rows, "event_time", "symbol")


def explode_batch(df: DataFrame, raw: str = "raw", quote: str | None = "USDT", strict: bool = False) -> DataFrame:
    """Ticker records of an all-symbol message, which is a JSON array of tickers."""
    items = df.select(F.explode(F.from_json(raw, f"array<{TEXT_MAP}>")).alias("_m"))
    m = F.col("_m")
    rows = items.select(*_head(m), *ticker_fields(m, strict))
    rows = _complete(rows, "event_time", "symbol")
    return rows if quote is None else rows.where(F.col("symbol").endswith(quote))


def parse_trade(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Aggregate-trade messages."""
    m = F.col("_m")
    rows = _parsed(df, F.from_json(raw, TEXT_MAP)).select(
        *_head(m), *[_cast(m[k], kind).alias(c) for c, k, kind in TRADE_KEYS]
    )
    return _complete(rows, *rows.columns)


def parse_kline(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Kline messages, whose candle is nested under ``k``."""
    m, k = F.col("_m"), F.col("_k")
    nested = _parsed(_parsed(df, F.from_json(raw, TEXT_MAP)), F.from_json(m["k"], TEXT_MAP), "_m", name="_k")
    rows = nested.select(*_head(m), *[_cast(k[key], kind).alias(c) for c, key, kind in KLINE_KEYS])
    return _complete(rows, *rows.columns)


def parse_depth(df: DataFrame, raw: str = "raw", as_of: int | None = None) -> DataFrame:
    """Depth snapshots in both key spellings. A missing event time becomes ``as_of``."""
    levels = "array<array<string>>"
    m = F.from_json(
        raw, f"E string, s string, lastUpdateId string, u string, bids {levels}, asks {levels}, b {levels}, a {levels}"
    )
    rows = _parsed(df, m)

    def side(long: str, short: str) -> Column:
        filled = F.when(F.size(f"_m.{long}") > 0, F.col(f"_m.{long}")).otherwise(F.col(f"_m.{short}"))
        typed = F.transform(
            filled,
            lambda x: F.struct(
                F.get(x, F.lit(0)).try_cast("double").alias("price"), F.get(x, F.lit(1)).try_cast("double").alias("qty")
            ),
        )
        return F.coalesce(typed, F.array().cast(LEVELS_DDL))

    now = F.unix_millis(F.current_timestamp()) if as_of is None else F.lit(as_of).cast("bigint")
    return rows.where(F.col("_m").isNotNull()).select(
        F.coalesce(F.col("_m.E").try_cast("bigint"), now).alias("event_time"),
        F.upper(F.coalesce("_m.s", F.lit(""))).alias("symbol"),
        F.coalesce(
            F.col("_m.lastUpdateId").try_cast("bigint"), F.col("_m.u").try_cast("bigint"), F.lit(0).cast("bigint")
        ).alias("last_update_id"),
        side("bids", "b").alias("bids"),
        side("asks", "a").alias("asks"),
    )


def depth_record(df: DataFrame) -> DataFrame:
    """Parsed depth with its sides as JSON text, the form a depth record is stored in."""
    return df.withColumns({"bids": levels_json("bids"), "asks": levels_json("asks")})


def unwrap_envelope(df: DataFrame, raw: str = "raw", quote: str | None = "USDT") -> DataFrame:
    """Messages of a combined stream: ``event_type``, ``symbol`` and the bare ``payload``.

    Text that is no JSON object is dropped, and so is a payload of no known type. Partial depth carries
    no symbol; it is taken from the stream name.
    """
    outer = _parsed(df, F.from_json(raw, TEXT_MAP), *df.columns, name="_o").where(F.col("_o").isNotNull())
    body = outer.withColumn("_body", F.coalesce(F.col("_o")["data"], F.col(raw)))
    inner = _parsed(body, F.from_json("_body", TEXT_MAP), *body.columns, name="_i").where(F.col("_i").isNotNull())
    i = F.col("_i")
    depth = i["lastUpdateId"].isNotNull() | (i["e"] == "depthUpdate")
    kind = F.when(depth, F.lit("depth")).otherwise(i["e"])
    stream_symbol = F.upper(F.get(F.split(F.coalesce(F.col("_o")["stream"], F.lit("")), "@"), F.lit(0)))
    symbol = F.when(depth, F.upper(F.coalesce(i["s"], stream_symbol))).otherwise(i["s"])
    out = inner.withColumns({"event_type": kind, "symbol": symbol}).where(
        F.col("event_type").isin("depth", "aggTrade", "kline")
    )
    if quote is not None:
        out = out.where(F.col("symbol").endswith(quote))
    return out.withColumnRenamed("_body", "payload").drop("_o", "_i")


def parse_kline_rows(df: DataFrame, raw: str = "raw", symbol: str = "symbol", interval: str = "1m") -> DataFrame:
    """Closed klines from positional rows (JSON arrays of arrays); rows that do not parse are skipped."""
    items = df.select(F.col(symbol).alias("symbol"), F.explode(F.from_json(raw, "array<array<string>>")).alias("_r"))
    rows = items.withColumns({c: F.get("_r", F.lit(i)).try_cast(kind) for c, (i, kind) in ROW_SLOTS.items()})
    rows = _complete(rows, *ROW_SLOTS)
    return rows.select(
        F.col("kline_start").alias("event_time"),
        "symbol",
        "kline_start",
        "kline_close",
        F.lit(interval).alias("interval"),
        "open",
        "high",
        "low",
        "close",
        "volume",
        "quote_volume",
        "trade_count",
        F.lit(True).alias("is_closed"),
    )


def klines_to_ticks(df: DataFrame) -> DataFrame:
    """Tick rows that stand in for missing ones: price, bid and ask are the candle's close."""
    close = F.col("close")
    return df.select(
        "symbol",
        F.col("kline_start").alias("event_time"),
        close.alias("price"),
        close.alias("bid"),
        close.alias("ask"),
        "volume",
        "quote_volume",
        pct_change("open", "close").alias("price_change_pct"),
        "trade_count",
        F.lit("backfill").alias("source"),
    )


def symbol_universe(df: DataFrame, quote: str = "USDT", raw: str = "raw") -> DataFrame:
    """Tradable spot symbols of an exchange description, sorted."""
    item = "struct<symbol:string,quoteAsset:string,status:string,isSpotTradingAllowed:boolean>"
    items = df.select(F.explode(F.from_json(raw, f"symbols array<{item}>")["symbols"]).alias("_s"))
    return (
        items.where(
            (F.col("_s.quoteAsset") == quote)
            & (F.col("_s.status") == "TRADING")
            & F.coalesce("_s.isSpotTradingAllowed", F.lit(False))
        )
        .select("_s.symbol")
        .orderBy("symbol")
    )


# --- registry --------------------------------------------------------------------------------------

Parser = Callable[[DataFrame], DataFrame]
RECORDS = ("ticker", "trade", "kline", "depth")
_SOURCES: dict[str, dict[str, Parser]] = {}


def register_source(name: str, parsers: dict[str, Parser]) -> None:
    """Register an exchange: one ``DataFrame -> DataFrame`` parser for each kind of record."""
    missing = [r for r in RECORDS if r not in parsers]
    if missing:
        raise ValueError(f"source {name!r} lacks parsers for {missing}")
    _SOURCES[name] = dict(parsers)


def source(name: str) -> dict[str, Parser]:
    if name not in _SOURCES:
        raise KeyError(f"no source named {name!r}")
    return _SOURCES[name]


register_source("spot", {"ticker": parse_ticker, "trade": parse_trade, "kline": parse_kline, "depth": parse_depth})
