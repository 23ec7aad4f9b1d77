"""Reading only the newest day partitions that a question about the newest rows needs."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import UTC, date, datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from candlelake.functions.time import bucket
from candlelake.operators.filters import before, select_symbols

DAY = "day"


def newest_days(
    table: DataFrame,
    symbols: Sequence[str] | DataFrame | None,
    n: int,
    end: int | None = None,
    time: str = "open_time",
    unit_ms: int | None = None,
    start: int | None = None,
) -> tuple[DataFrame, bool]:
    """Rows of the newest days that hold ``n`` rows of each wanted symbol, and whether all of them were met.

    The walk starts at the last day (before ``end``) and doubles the number of days until every symbol has its ``n`` rows,
    or ``n`` whole buckets of ``unit_ms``, or the days are over. Each step reads symbol and time of those days and hands
    one count to the driver. The bounds are literals on ``day``, so the plan opens no other partition. Symbols that the
    table lacks make the walk go to its first day. Without ``day`` column or wanted symbols there is nothing to walk on,
    and all rows before ``end`` come back.
    """
    rows = select_symbols(table, symbols)
    rows = rows if end is None else before(rows, end, time)
    rows = rows if start is None else rows.where(F.col(time) >= start)
    if symbols is None or DAY not in table.columns:
        return rows, False
    wanted = symbols.select("symbol").distinct().count() if isinstance(symbols, DataFrame) else len(set(symbols))
    first, last = table.agg(F.min(DAY), F.max(DAY)).first()  # partition values: no column of a file is read
    if last is None:
        return rows, wanted == 0
    if end is not None:
        last = min(str(last), str(datetime.fromtimestamp((end - 1) / 1000, UTC).date()))
    first, last = (d if isinstance(d, date) else date.fromisoformat(str(d)) for d in (first, last))
    # The oldest bucket may begin before the days that are read, so whole buckets take one more.
    counted = F.count("*") if unit_ms is None else F.count_distinct(bucket(time, unit_ms)) - 1
    days = 1
    while True:
        lower = max(first, last - timedelta(days=days - 1))
        part = rows.where(F.col(DAY).between(F.lit(lower), F.lit(last)))
        met = part.groupBy("symbol").agg(counted.alias("n")).where(F.col("n") >= n).count()
        if met >= wanted or lower <= first:
            return part, met >= wanted
        days *= 2
