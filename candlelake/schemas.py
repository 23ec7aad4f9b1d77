"""Record schemas and the closed set of candle intervals."""

from __future__ import annotations

from pyspark.sql import types as T

# Interval names and their length in seconds.
INTERVAL_SECONDS = {
    "1s": 1,
    "1m": 60,
    "5m": 300,
    "15m": 900,
    "1h": 3600,
    "4h": 14400,
    "1d": 86400,
    "1w": 604800,
}

# Limits and defaults of the data model.
SYMBOL_PATTERN = "[A-Z0-9]{1,20}"
DAY_MS = 86_400_000
MAX_RANGE_DAYS = 365
HISTORY_START_MS = 1_500_000_000_000
RETENTION_DAYS = {"1s": 1, "1m": 90}
TICK_HISTORY_MS = 300_000
BOOK_TTL_MS = 300_000
SERIES_CAP = {"1s": 120}
SERIES_CAP_DEFAULT = 10_000
MIN_GAP_MS = 300_000
GAP_LOOKBACK_MS = 7 * DAY_MS
HEARTBEAT_MS = 5_000


def _fields(names: str, kind: T.DataType) -> list[T.StructField]:
    return [T.StructField(n, kind, True) for n in names.split()]


TICKER = T.StructType(
    [T.StructField("event_time", T.LongType(), False), T.StructField("symbol", T.StringType(), False)]
    + _fields(
        "close bid ask h24_open h24_high h24_low h24_volume h24_quote_volume "
        "h24_price_change h24_price_change_pct",
        T.DoubleType(),
    )
    + _fields("h24_trade_count", T.LongType())
)

TRADE = T.StructType(
    [
        T.StructField("event_time", T.LongType(), False),
        T.StructField("symbol", T.StringType(), False),
        T.StructField("agg_trade_id", T.LongType(), True),
        T.StructField("price", T.DoubleType(), True),
        T.StructField("quantity", T.DoubleType(), True),
        T.StructField("trade_time", T.LongType(), True),
        T.StructField("is_buyer_maker", T.BooleanType(), True),
    ]
)

KLINE = T.StructType(
    [
        T.StructField("event_time", T.LongType(), False),
        T.StructField("symbol", T.StringType(), False),
        T.StructField("kline_start", T.LongType(), False),
        T.StructField("kline_close", T.LongType(), False),
        T.StructField("interval", T.StringType(), False),
    ]
    + _fields("open high low close volume quote_volume", T.DoubleType())
    + _fields("trade_count", T.LongType())
    + [T.StructField("is_closed", T.BooleanType(), False)]
)

DEPTH = T.StructType(
    [
        T.StructField("event_time", T.LongType(), False),
        T.StructField("symbol", T.StringType(), False),
        T.StructField("last_update_id", T.LongType(), True),
        T.StructField("bids", T.StringType(), True),
        T.StructField("asks", T.StringType(), True),
    ]
)

#: One price level of an order book.
LEVELS_DDL = "array<struct<price:double,qty:double>>"

#: The columns a candle carries between operators.
CANDLE_COLUMNS = ["symbol", "open_time", "open", "high", "low", "close", "volume"]


def interval_seconds(name: str) -> int:
    """Length of an interval in seconds; raises ValueError for a name outside the closed set."""
    key = name.strip().lower()
    if key not in INTERVAL_SECONDS:
        raise ValueError(f"Unsupported interval: {name!r}")
    return INTERVAL_SECONDS[key]


def interval_millis(name: str) -> int:
    """Length of an interval in milliseconds."""
    return interval_seconds(name) * 1000
