"""Ordered-series helpers that stay parallel in time.

A window over ``partitionBy(symbol)`` would put the whole history of one symbol into one task. The
helpers here cut every series into time chunks and partition by (symbol, chunk), so one busy symbol
spreads over as many tasks as it has chunks. What a chunk must know about earlier chunks travels as a
small summary: one row per (symbol, chunk), never the rows themselves.

``order`` is a list of columns, time (epoch ms) first; the remaining ones break ties.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from candlelake.functions.time import bucket

CHUNK = "_chunk"
HALO = "_halo"

#: Chunk width for raw ticks, whose density per symbol has no bound.
TICK_CHUNK_MS = 3_600_000
#: Rows a chunk of candles holds at most (one candle per symbol and interval).
CANDLE_CHUNK_ROWS = 1024


def chunked(df: DataFrame, order: Sequence[str], width_ms: int) -> DataFrame:
    return df.withColumn(CHUNK, bucket(order[0], width_ms))


def chunk_window(keys: Sequence[str], order: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys, CHUNK).orderBy(*order)


def chunk_scan(keys: Sequence[str]) -> WindowSpec:
    """Window over chunk summaries: one row per chunk, so its size is span / width."""
    return Window.partitionBy(*keys).orderBy(CHUNK)


def _neighbour_rows(base: DataFrame, keys: Sequence[str], order: Sequence[str], ahead: bool) -> DataFrame:
    """The row just before (or after) each chunk, labelled with that chunk."""
    pick, step = (F.min_by, F.lag) if ahead else (F.max_by, F.lead)
    columns = [c for c in base.columns if c != CHUNK]
    edge = base.groupBy(*keys, CHUNK).agg(
        pick(F.struct(*columns), F.struct(*order)).alias("_row")
    )
    moved = edge.select("_row", step(CHUNK).over(chunk_scan(keys)).alias(CHUNK))
    return moved.where(F.col(CHUNK).isNotNull()).select("_row.*", CHUNK)


def _tail_rows(base: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int) -> DataFrame:
    """The last ``rows`` rows before each chunk, labelled with that chunk.

    A sparse chunk may hold fewer rows than asked for, so a tail can serve several later chunks. Row
    counts per chunk give, for every chunk, the earlier chunks that are near enough; only those pairs
    are joined with the tails.
    """
    scan = chunk_scan(keys)
    counts = (
        base.groupBy(*keys, CHUNK)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn("_end", F.sum("_rows").over(scan))
        .withColumn("_target", F.lead(CHUNK).over(scan))
    )
    near = Window.partitionBy(*keys).orderBy("_end").rangeBetween(-(rows - 1), 0)
    pairs = (
        counts.withColumn("_sources", F.collect_list(F.struct(F.col(CHUNK).alias("source"), "_end")).over(near))
        .where(F.col("_target").isNotNull())
        .select(*keys, "_target", F.col("_end").alias("_upto"), F.explode("_sources").alias("_s"))
        .select(*keys, F.col("_s.source").alias(CHUNK), "_target", (F.col("_upto") - F.col("_s._end")).alias("_skip"))
    )
    newest_first = Window.partitionBy(*keys, CHUNK).orderBy(*[F.col(c).desc() for c in order])
    tails = base.withColumn("_back", F.row_number().over(newest_first)).where(F.col("_back") <= rows)
    return (
        tails.join(pairs, [*keys, CHUNK])
        .where(F.col("_back") + F.col("_skip") <= rows)
        .drop(CHUNK, "_back", "_skip")
        .withColumnRenamed("_target", CHUNK)
    )


def over_chunks(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    width_ms: int,
    build: Callable[[DataFrame, WindowSpec], DataFrame],
    lookback: int = 1,
    ahead: bool = False,
) -> DataFrame:
    """Run a bounded window computation chunk by chunk, with the same answer as on whole series.

    Every chunk also sees the ``lookback`` rows before it (one row after it with ``ahead``); ``build``
    gets these rows and the chunk window, and the borrowed rows are removed from its result.
    """
    if ahead and lookback != 1:
        raise ValueError("only one row of look-ahead is supported")
    base = chunked(df, order, width_ms)
    if lookback == 1:
        halo = _neighbour_rows(base, keys, order, ahead)
    else:
        halo = _tail_rows(base, keys, order, lookback)
    rows = base.withColumn(HALO, F.lit(False)).unionByName(halo.withColumn(HALO, F.lit(True)))
    out = build(rows, chunk_window(keys, order))
    return out.where(~F.col(HALO)).drop(CHUNK, HALO)


def with_previous(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], width_ms: int, ahead: bool = False, **columns: str
) -> DataFrame:
    """Add, for each ``new=old`` pair, column ``new`` with ``old`` of the previous (next) row."""
    step = F.lead if ahead else F.lag

    def build(rows: DataFrame, w: WindowSpec) -> DataFrame:
        return rows.withColumns({new: step(old).over(w) for new, old in columns.items()})

    return over_chunks(df, keys, order, width_ms, build, ahead=ahead)


def with_index(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], width_ms: int, name: str = "idx"
) -> DataFrame:
    """Add the 0-based position of each row in its series; keeps the chunk column."""
    base = chunked(df, order, width_ms)
    scan = chunk_scan(keys).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        base.groupBy(*keys, CHUNK)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select(*keys, CHUNK, F.coalesce(F.sum("_rows").over(scan), F.lit(0)).alias("_offset"))
    )
    local = base.withColumn("_pos", F.row_number().over(chunk_window(keys, order)) - 1)
    return local.join(offsets, [*keys, CHUNK]).withColumn(name, F.col("_offset") + F.col("_pos")).drop("_offset")


def running_max(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, width_ms: int, name: str
) -> DataFrame:
    """Add the largest ``value`` seen in earlier rows of the series (NULL on the first row)."""
    base = chunked(df, order, width_ms)
    before = chunk_scan(keys).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        base.groupBy(*keys, CHUNK)
        .agg(F.max(value).alias("_top"))
        .select(*keys, CHUNK, F.max("_top").over(before).alias("_carry"))
    )
    local = chunk_window(keys, order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        base.join(carry, [*keys, CHUNK])
        .withColumn(name, F.greatest(F.max(value).over(local), F.col("_carry")))
        .drop(CHUNK, "_carry")
    )


def forward_fill(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, width_ms: int
) -> DataFrame:
    """Replace NULLs in ``column`` by the last value before them in the series."""
    base = chunked(df, order, width_ms)
    before = chunk_scan(keys).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        base.groupBy(*keys, CHUNK)
        .agg(F.max_by(column, F.when(F.col(column).isNotNull(), F.struct(*order))).alias("_end"))
        .select(*keys, CHUNK, F.last("_end", ignorenulls=True).over(before).alias("_carry"))
    )
    local = F.last(column, ignorenulls=True).over(chunk_window(keys, order).rowsBetween(Window.unboundedPreceding, 0))
    filled = base.withColumn(column, local).join(carry, [*keys, CHUNK])
    return filled.withColumn(column, F.coalesce(column, "_carry")).drop(CHUNK, "_carry")


def last_n(
    df: DataFrame, n: int, keys: Sequence[str], order: Sequence[str], width_ms: int | None = None
) -> DataFrame:
    """The newest ``n`` rows of each series.

    With ``width_ms`` the limit is taken per time chunk first, which caps what one task of the final
    limit can receive; both steps use Spark's group limit, which already prunes before the shuffle.
    """
    newest = [F.col(c).desc() for c in order]
    out = df
    if width_ms:
        w = Window.partitionBy(*keys, CHUNK).orderBy(*newest)
        out = chunked(out, order, width_ms).withColumn("_rn", F.row_number().over(w))
        out = out.where(F.col("_rn") <= n).drop("_rn", CHUNK)
    w = Window.partitionBy(*keys).orderBy(*newest)
    return out.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key: the one with the highest order. Pre-aggregates before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    ranked = F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])
    return (
        df.groupBy(*keys).agg(F.max_by(F.struct(*rest), ranked).alias("_row")).select(*keys, "_row.*").select(*df.columns)
    )
