"""Table jobs: loading, repair, retention and compaction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from candlelake.functions.time import day_of
from candlelake.operators.candles import last_time
from candlelake.operators.filters import select_symbols, time_range
from candlelake.operators.gaps import find_gaps, gap_days, gap_summary, repair_gaps
from candlelake.operators.live import incremental
from candlelake.schemas import DAY_MS, GAP_LOOKBACK_MS, MIN_GAP_MS, RETENTION_DAYS
from candlelake.sources.messages import klines_to_ticks
from candlelake.sources.tables import DAY, append_klines, backfill_points, read_ticks, write_points
from candlelake.workspace import cut

# Size a data file is brought to, and the number of small files worth a rewrite.
TARGET_FILE_BYTES = 128 * 1024 * 1024
MIN_INPUT_FILES = 5


def populate(source: DataFrame, table: str, days: int, as_of: int, symbols: Sequence[str] | DataFrame | None = None) -> None:
    """Load the last ``days`` of klines of the listed symbols, all symbols in one job."""
    append_klines(_window(source, days, as_of, symbols), table)


def _window(source: DataFrame, days: int, as_of: int, symbols) -> DataFrame:
    return time_range(select_symbols(source, symbols), as_of - days * DAY_MS, as_of, "kline_start", max_days=None)


def load_history(source: DataFrame, table: str, as_of: int, mode: str = "incremental") -> None:
    """Append klines up to the last whole minute: all of them, or those after each symbol's last stored one."""
    if mode not in ("incremental", "backfill"):
        raise ValueError(f"unknown mode {mode!r}")
    rows = source.where(F.col("kline_start") < as_of - as_of % 60_000)
    if mode == "incremental":
        rows = incremental(rows, last_time(source.sparkSession.table(table), symbols=rows.select("symbol").distinct()))
    append_klines(rows, table)


def backfill_gaps(
    ticks: DataFrame,
    klines: DataFrame,
    as_of: int,
    min_gap_ms: int = MIN_GAP_MS,
    lookback_ms: int = GAP_LOOKBACK_MS,
) -> DataFrame:
    """Tick rows that repair the gaps of the recent past, taken from a kline source."""
    gaps = find_gaps(ticks, as_of, min_gap_ms, lookback_ms)
    return klines_to_ticks(repair_gaps(gaps, klines))


def repair_points(
    spark: SparkSession,
    path: str,
    klines: DataFrame,
    as_of: int,
    min_gap_ms: int = MIN_GAP_MS,
    lookback_ms: int = GAP_LOOKBACK_MS,
    include_backfill: bool = False,
) -> DataFrame:
    """Find the gaps of the stored tick points, land points from a kline source in them, and sum up what was done.

    Both tables are read on few days only: the points on those of the look-back, a source stored by day on those that a
    gap touches (their number is bounded by the look-back, so they come to the driver). Landed points carry
    ``source = 'backfill'``. Since such points do not count as price, the next run finds the same gaps and writes the same
    points again, which changes nothing; with ``include_backfill`` it finds what is still missing. Runs when called.
    """
    ticks = read_ticks(spark.read.parquet(path))
    gaps = cut(find_gaps(ticks, as_of, min_gap_ms, lookback_ms, include_backfill))
    if DAY in klines.columns:
        klines = klines.where(F.col(DAY).isin([r[0] for r in gap_days(gaps).collect()]))
    repaired = cut(repair_gaps(gaps, klines))
    if not repaired.isEmpty():
        write_points(backfill_points(klines_to_ticks(repaired)), path)
    return gap_summary(gaps, repaired)


def _table_replace(df: DataFrame, table: str) -> None:
    """Overwrite the day partitions that occur in ``df``, which may be read from the same table.

    New files are staged and swapped in on commit. ``insertInto`` takes the overwrite mode from the
    session, so it is set for the time of the write.
    """
    spark = df.sparkSession
    mode = "spark.sql.sources.partitionOverwriteMode"
    before = spark.conf.get(mode)
    spark.conf.set(mode, "dynamic")
    try:
        df.select(*spark.table(table).columns).write.insertInto(table, overwrite=True)
    finally:
        spark.conf.set(mode, before)


def _drop_days(spark, table: str, days: Sequence) -> None:
    if days:
        parts = ", ".join(f"PARTITION ({DAY} = DATE '{d}')" for d in days)
        spark.sql(f"ALTER TABLE {table} DROP IF EXISTS {parts}")


def apply_retention(df_table: str, spark, as_of: int, days: int = RETENTION_DAYS["1m"], interval: str = "1m") -> None:
    """Delete closed candles of an interval that are older than ``days``.

    A day that holds nothing else is dropped as a partition. Only days with both expired and other rows
    are rewritten; a row exactly at the cutoff stays.
    """
    cutoff = as_of - max(days, 1) * DAY_MS
    expired = F.coalesce(
        (F.col("interval") == interval) & F.col("is_closed") & (F.col("kline_start") < cutoff), F.lit(False)
    )
    old = spark.table(df_table).where(F.col(DAY) <= day_of(F.lit(cutoff).cast("bigint")))
    # One row per day: partition bookkeeping, not data.
    per_day = old.groupBy(DAY).agg(F.count(F.lit(1)).alias("rows"), F.count_if(expired).alias("expired")).collect()
    mixed = [r[DAY] for r in per_day if 0 < r["expired"] < r["rows"]]
    if mixed:
        kept = old.where(F.col(DAY).isin(mixed)).where(~expired)
        _table_replace(kept.hint("rebalance", DAY).sortWithinPartitions(DAY, "symbol", "kline_start"), df_table)
    _drop_days(spark, df_table, [r[DAY] for r in per_day if r["expired"] == r["rows"]])


def file_report(df: DataFrame, target_bytes: int = TARGET_FILE_BYTES) -> DataFrame:
    """Data files of each day: how many, how large, how many clearly under the target size."""
    files = df.select(DAY, "_metadata.file_path", "_metadata.file_size").distinct()
    return files.groupBy(DAY).agg(
        F.count(F.lit(1)).alias("files"),
        F.sum("file_size").alias("bytes"),
        F.count_if(F.col("file_size") < target_bytes * 3 // 4).alias("small_files"),
    )


def compact(
    table: str, spark, *sort: str, target_bytes: int = TARGET_FILE_BYTES, min_files: int = MIN_INPUT_FILES
) -> None:
    """Rewrite days with at least ``min_files`` small files to files of about the target size.

    The rows of a day are spread by hash over as many tasks as the day needs files, so a large day is
    rewritten in parallel.
    """
    rows = spark.table(table)
    # One row per day: partition bookkeeping, not data.
    todo = file_report(rows, target_bytes).where(F.col("small_files") >= min_files).collect()
    if not todo:
        return
    need = {r[DAY]: max(1, -(-r["bytes"] // target_bytes)) for r in todo}
    sort = sort or ("symbol", "kline_start")
    slots = F.create_map(*[F.lit(x) for day, n in need.items() for x in (day, n)])
    slot = F.pmod(F.xxhash64(*sort), F.element_at(slots, F.col(DAY)))
    picked = rows.where(F.col(DAY).isin(list(need))).withColumn("_slot", slot)
    packed = picked.repartition(sum(need.values()), DAY, "_slot").sortWithinPartitions(DAY, *sort).drop("_slot")
    _table_replace(packed, table)
