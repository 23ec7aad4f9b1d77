"""Day-partitioned lakehouse tables: creating, appending, upserting and reading them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from candlelake.functions.time import day_of, to_timestamp
from candlelake.operators.filters import before, closed_only, select_symbols, time_range
from candlelake.operators.series import last_n, latest
from candlelake.operators.walk import newest_days
from candlelake.schemas import DAY_MS, KLINE, TICKER, TRADE

DAY = "day"
SHARD = "shard"
#: Shards of a new latest-value table, and the name of the marker file that keeps their number.
SHARDS = 16
SHARDS_MARK = "_shards_"

_TS = T.TimestampType()


def _with(schema: T.StructType, **extra: T.DataType) -> T.StructType:
    return T.StructType([*schema.fields, *[T.StructField(n, t, True) for n, t in extra.items()]])


# Table names; for each the columns and the epoch-ms column its day comes from.
TABLES = {
    "coin_ticker": (_with(TICKER, event_timestamp=_TS, ingested_at=_TS), "event_time"),
    "coin_trades": (_with(TRADE, event_timestamp=_TS, trade_timestamp=_TS, ingested_at=_TS), "trade_time"),
    "coin_klines": (_with(KLINE, kline_timestamp=_TS, ingested_at=_TS), "kline_start"),
    "klines_hourly": (
        T.StructType(
            [T.StructField("symbol", T.StringType()), T.StructField("open_time", T.LongType())]
            + [T.StructField(c, T.DoubleType()) for c in ("open", "high", "low", "close", "volume", "quote_volume")]
            + [T.StructField("trade_count", T.LongType())]
        ),
        "open_time",
    ),
}


def ensure_tables(spark: SparkSession, database: str, location: str | None = None, names: Sequence[str] = ()) -> None:
    """Create the database and its day-partitioned tables where they do not exist yet."""
    place = f" LOCATION '{location}'" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database}{place}")
    for name in names or TABLES:
        schema, _ = TABLES[name]
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {database}.{name} ({columns}, {DAY} DATE) "
            f"USING parquet PARTITIONED BY ({DAY}) OPTIONS (compression 'zstd')"
        )


def with_day(df: DataFrame, time: str) -> DataFrame:
    return df.withColumn(DAY, day_of(time))


def spread(df: DataFrame, part: str, *sort: str) -> DataFrame:
    """Rows gathered by partition value for writing.

    Rebalancing lets adaptive execution join small partitions and split a large day over several tasks,
    so a busy day is neither one task nor one file.
    """
    return df.hint("rebalance", part).sortWithinPartitions(part, *sort)


def append_rows(df: DataFrame, table: str, time: str, *sort: str) -> None:
    """Append to a day-partitioned table, clustered by ``sort`` inside each file."""
    columns = df.sparkSession.table(table).columns
    rows = with_day(df, time)
    for c in columns:
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast(df.sparkSession.table(table).schema[c].dataType))
    spread(rows, DAY, *sort).select(*columns).write.insertInto(table)


def append_klines(df: DataFrame, table: str) -> None:
    """Append klines with their timestamp and time of ingestion, sorted by symbol and time."""
    stamped = df.withColumns({"kline_timestamp": to_timestamp("kline_start"), "ingested_at": F.current_timestamp()})
    append_rows(stamped, table, "kline_start", "symbol", "kline_start")


def replace_partitions(df: DataFrame, path: str, part: str, *sort: str) -> None:
    """Overwrite exactly the partitions that occur in ``df``; replaying the same rows changes nothing."""
    (
        spread(df, part, *sort)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy(part)
        .parquet(path)
    )


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def _has_rows(spark: SparkSession, path: str) -> bool:
    """Whether a folder holds partitions."""
    if not _exists(spark, path):
        return False
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    return any("=" in f.getPath().getName() for f in root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root))


def upsert(df: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], part: str) -> None:
    """Merge rows into a partitioned table: one row per key, the one with the highest order.

    Only partitions that the new rows touch are read and rewritten. The partition must be a function of
    the key. Stored rows lose ties against new ones, so a replayed batch leaves the table as it was. Columns that
    the batch lacks keep their stored values, also in rows that it replaces; columns that the table lacks are added.
    """
    spark = df.sparkSession
    kept: list[str] = []
    new = df.withColumn("_new", F.lit(1))
    if _has_rows(spark, path):
        touched = [r[0] for r in df.select(part).distinct().collect()]  # partition values, not rows
        stored = spark.read.option("mergeSchema", "true").parquet(path).where(F.col(part).isin(touched))
        changed = [c for c in df.columns if c in stored.columns and c != part and stored.schema[c].dataType != df.schema[c].dataType]
        if changed:
            raise ValueError(f"columns {changed} have another type in the table")
        kept = [c for c in stored.columns if c not in df.columns]
        stored = stored.withColumn(part, F.col(part).cast(df.schema[part].dataType))
        new = new.unionByName(stored.withColumn("_new", F.lit(0)), allowMissingColumns=True)
    merged = latest(new, [*keys, part], [*order, "_new"]).drop("_new")
    if kept:
        old = stored.select(*keys, part, *[F.col(c).alias(f"_{c}") for c in kept])
        merged = merged.join(old, [*keys, part], "left").withColumns({c: F.coalesce(c, f"_{c}") for c in kept}).drop(*[f"_{c}" for c in kept])
    replace_partitions(merged, path, part, *keys)


def upsert_series(df: DataFrame, path: str, order: Sequence[str], time: str = "open_time", keys: Sequence[str] = ("symbol",)) -> None:
    """Upsert into a series keyed by (keys, time), stored by day."""
    upsert(with_day(df, time), path, [*keys, time], order, DAY)


def _shards(spark: SparkSession, path: str, wanted: int | None) -> int:
    """Shards of a latest-value table: as its first writer laid down in a marker file, which readers skip."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    marks = [f.getPath().getName() for f in files.listStatus(root)] if files.exists(root) else []
    stored = [int(name.removeprefix(SHARDS_MARK)) for name in marks if name.startswith(SHARDS_MARK)]
    if stored and wanted not in (None, stored[0]):
        raise ValueError(f"the table has {stored[0]} shards, not {wanted}")
    if stored:
        return stored[0]
    count = wanted or SHARDS
    files.create(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{SHARDS_MARK}{count}"), True).close()
    return count


def upsert_latest(df: DataFrame, path: str, order: Sequence[str], key: str = "symbol", shards: int | None = None) -> None:
    """Upsert into a latest-value table with one row per key, stored by hash shard of the key.

    Only shards that the batch touches are rewritten, so a table of many keys wants many. Their number is laid down by the
    first call and kept with the table: another one would leave stale copies, and is refused.
    """
    sharded = df.withColumn(SHARD, F.pmod(F.hash(key), F.lit(_shards(df.sparkSession, path, shards))))
    upsert(sharded, path, [key], order, SHARD)


def read_latest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop(SHARD)


# The columns of a stored point that are tags; the rest are fields.
POINT_TAGS = ["measurement", "symbol", "exchange", "interval", "source"]
LIVE, BACKFILL = "live", "backfill"


def candle_points(df: DataFrame, exchange: str = "spot") -> DataFrame:
    """Points of the candle measurement: closed 1m candles only."""
    rows = closed_only(df, "1m")
    return rows.select(
        F.lit("candles").alias("measurement"),
        "symbol",
        F.lit(exchange).alias("exchange"),
        "interval",
        F.lit(LIVE).alias("source"),
        F.col("kline_start").alias("time"),
        "open", "high", "low", "close", "volume", "quote_volume", "trade_count", "is_closed", "event_time",
    )


def tick_points(df: DataFrame, exchange: str = "spot") -> DataFrame:
    """Points of the tick measurement, from ticker records; their tag ``source`` tells live ones from repairs."""
    source = F.coalesce(F.col("source"), F.lit(LIVE)) if "source" in df.columns else F.lit(LIVE)
    return df.where(F.col("symbol").isNotNull()).select(
        F.lit("market_ticks").alias("measurement"),
        "symbol",
        F.lit(exchange).alias("exchange"),
        F.lit("tick").alias("interval"),
        source.alias("source"),
        F.col("event_time").alias("time"),
        F.col("close").alias("price"),
        "bid",
        "ask",
        F.col("h24_volume").alias("volume"),
        F.col("h24_quote_volume").alias("quote_volume"),
        F.col("h24_price_change_pct").alias("price_change_pct"),
        F.col("h24_trade_count").alias("trade_count"),
        "event_time",
    )


def backfill_points(ticks: DataFrame, exchange: str = "spot") -> DataFrame:
    """Points of the tick measurement, from rows that repair a gap (see ``klines_to_ticks``)."""
    renamed = {"price": "close", "volume": "h24_volume", "quote_volume": "h24_quote_volume", "price_change_pct": "h24_price_change_pct", "trade_count": "h24_trade_count"}
    return tick_points(ticks.withColumnsRenamed(renamed), exchange)


def read_ticks(points: DataFrame) -> DataFrame:
    """Stored points of the tick measurement as ticks: symbol, event_time, price, source and the day."""
    rows = points.where(F.col("measurement") == "market_ticks")
    return rows.select("symbol", F.col("time").alias("event_time"), "price", "source", DAY)


def write_points(points: DataFrame, path: str) -> None:
    """Write points; one with the same tags and time replaces the stored one."""
    upsert_series(points, path, ["event_time"], time="time", keys=POINT_TAGS)


def read_candles(
    df: DataFrame,
    symbols: Sequence[str] | DataFrame | None,
    interval: str,
    start: int | None = None,
    end: int | None = None,
    n: int | None = None,
    time: str = "open_time",
    width_ms: int = 30 * DAY_MS,
) -> DataFrame:
    """Candles of one interval in ``[start, end)``, the newest ``n`` of each symbol.

    The newest ``n`` of given symbols are looked for backwards, day by day (see ``newest_days``).
    """
    rows = select_symbols(df, symbols)
    if "interval" in df.columns:
        rows = rows.where(F.col("interval") == interval)
    if n is not None and symbols is not None:
        rows = newest_days(rows, symbols, n, end, time, start=start)[0]
    if start is not None and end is not None:
        rows = time_range(rows, start, end, time, max_days=None)
    elif end is not None:
        rows = before(rows, end, time)
    elif start is not None:
        rows = rows.where(F.col(time) >= start)
        rows = rows.where(F.col(DAY) >= day_of(F.lit(start).cast("bigint"))) if DAY in df.columns else rows
    return rows if n is None else last_n(rows, n, ["symbol"], [time], width_ms)


def read_points(df: DataFrame, fields: Sequence[str], keys: Sequence[str] = ("symbol", "time")) -> DataFrame:
    """Points stored one field per row, turned into one row per key with a column for each field."""
    return df.groupBy(*keys).pivot("field", list(fields)).agg(F.max("value"))


def read_cold(
    table: DataFrame,
    symbols: Sequence[str] | DataFrame | None = None,
    end: int | None = None,
    start: int | None = None,
    n: int | None = None,
    interval: str = "1m",
) -> DataFrame:
    """Closed candles of the lakehouse table in ``[start, end)`` or before ``end``, newest ``n`` per symbol."""
    rows = read_candles(closed_only(table, interval), symbols, interval, start, end, n, time="kline_start")
    return rows.select(
        "symbol", F.col("kline_start").alias("open_time"), "open", "high", "low", "close", "volume", "is_closed"
    )
