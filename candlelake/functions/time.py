"""Time arithmetic on epoch milliseconds. Nothing here depends on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from candlelake.functions.text import strip
from candlelake.schemas import DAY_MS, INTERVAL_SECONDS


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def bucket(t: str | Column, size_ms: int) -> Column:
    """Start of the epoch-aligned bucket that holds ``t`` (weeks therefore start on Thursday)."""
    t = _c(t)
    return t - F.pmod(t, F.lit(size_ms).cast("bigint"))


def day_of(t: str | Column) -> Column:
    """UTC calendar day of an epoch-millisecond column."""
    return F.date_from_unix_date((bucket(t, DAY_MS) / DAY_MS).cast("int"))


def epoch_ms(ts: str | Column) -> Column:
    """Milliseconds since the epoch of a zone-less timestamp."""
    return F.timestamp_diff("MILLISECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), _c(ts))


def to_timestamp(t: str | Column) -> Column:
    return F.timestamp_millis(_c(t))


def rfc3339(t: str | Column) -> Column:
    """Text of the UTC second, like ``2024-01-01T00:00:00Z``."""
    t = _c(t)
    second = (F.pmod(t, F.lit(DAY_MS).cast("bigint")) / 1000).cast("int")
    return F.concat(
        day_of(t).cast("string"),
        F.format_string(
            "T%02d:%02d:%02dZ",
            (second / 3600).cast("int"),
            F.pmod((second / 60).cast("int"), F.lit(60)),
            F.pmod(second, F.lit(60)),
        ),
    )


def interval_name(text: str | Column) -> Column:
    """Interval text in its normal form: trimmed, lower case."""
    return F.lower(strip(text))


def interval_ms(text: str | Column) -> Column:
    """Milliseconds of an interval given as text; 0 for a name outside the closed set."""
    table = F.create_map(*[F.lit(x) for k, v in INTERVAL_SECONDS.items() for x in (k, v * 1000)])
    return F.coalesce(F.try_element_at(table, interval_name(text)).cast("bigint"), F.lit(0).cast("bigint"))
