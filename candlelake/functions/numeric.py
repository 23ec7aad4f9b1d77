"""Number functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def number(text: str | Column, kind: str = "double", strict: bool = False) -> Column:
    """Parse a number; 0 where it is absent or malformed, NULL instead if ``strict``."""
    value = _c(text).try_cast(kind)
    return value if strict else F.coalesce(value, F.lit(0).cast(kind))


def rounded(x: str | Column, scale: int) -> Column:
    """What ``round`` gives for a double, without its decimal text unless the value is near a tie, very large or not finite.

    ``x`` is looked at several times, so it should be a column rather than an expression.
    """
    x = _c(x)
    scaled = x * 10.0**scale
    near = F.rint(scaled)
    # Below 1e11 the product is off by less than 3e-5. Adding 0.0 drops the sign of a zero, as the decimal text does.
    safe = (F.abs(scaled) < 1e11) & (F.abs(scaled - near) < 0.4999)
    return F.when(safe, near / 10.0**scale + 0.0).otherwise(F.round(x, scale))


def pct_change(start: str | Column, end: str | Column) -> Column:
    """Change in percent; 0 where the start is 0."""
    start, end = _c(start), _c(end)
    return F.when(start != 0, (end - start) / start * 100).otherwise(F.lit(0.0))


def typical_price(high: str | Column = "high", low: str | Column = "low", close: str | Column = "close") -> Column:
    return (_c(high) + _c(low) + _c(close)) / 3


def money_flow() -> Column:
    return typical_price() * F.col("volume")


def direction(open_: str | Column = "open", close: str | Column = "close") -> Column:
    """``up`` where the close is at or above the open, else ``down``."""
    return F.when(_c(close) >= _c(open_), F.lit("up")).otherwise(F.lit("down"))


def compact_number(x: str | Column) -> Column:
    """Short text of a magnitude: 1.50B, 2.25M, 3.1K, 42.00."""
    x = _c(x)
    return (
        F.when(x >= 1e9, F.concat(F.format_string("%.2f", x / 1e9), F.lit("B")))
        .when(x >= 1e6, F.concat(F.format_string("%.2f", x / 1e6), F.lit("M")))
        .when(x >= 1e3, F.concat(F.format_string("%.1f", x / 1e3), F.lit("K")))
        .otherwise(F.format_string("%.2f", x))
    )
