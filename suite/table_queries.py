"""Writing to lakehouse tables and reading back. Tables live in a new folder of the shared work directory."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from candlelake.operators.series import latest
from candlelake.plans import maintenance
from candlelake.sources import tables
from candlelake.workspace import work_dir
from suite.base import C1H, CUT, DAY, HOUR, MINUTE, SPLIT, TICKS, candles, klines, ohlcv, query, sql
from suite.candle_queries import OHLCV, OHLCV_COLUMNS
from suite.series_queries import USERS, nation_tickers

STORED = ["symbol", "kline_start", "open", "high", "low", "close", "volume"]
STORED_SQL = "symbol, open_time AS kline_start, open, high, low, close, volume"


def new_table(spark, name="coin_klines"):
    """A table of its own for this run."""
    database = f"run_{uuid.uuid4().hex}"
    tables.ensure_tables(spark, database, work_dir(spark), [name])
    return f"{database}.{name}"


def stored_klines(spark, sf, interval="1h"):
    name = new_table(spark)
    tables.append_klines(klines(spark, sf, interval), name)
    return name


@query(
    "table_roundtrip",
    sql(C1H, f"SELECT {STORED_SQL}, TRUE AS stamped, CAST(CAST(epoch_ms(open_time) AS DATE) AS VARCHAR) AS day FROM c1h"),
)
def table_roundtrip(spark, sf):
    out = spark.table(stored_klines(spark, sf))
    same = F.unix_millis("kline_timestamp") == F.col("kline_start")
    return out.select(*STORED, (same & F.col("ingested_at").isNotNull()).alias("stamped"), F.col("day").cast("string").alias("day"))


@query(
    "cold_read",
    sql(
        C1H,
        f"""SELECT {OHLCV}, TRUE AS is_closed FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) AS n
        FROM c1h WHERE open_time >= {SPLIT - 5 * DAY} AND open_time < {SPLIT}) WHERE n <= 40""",
    ),
)
def cold_read(spark, sf):
    return tables.read_cold(spark.table(stored_klines(spark, sf)), None, SPLIT, SPLIT - 5 * DAY, 40)


@query(
    "points_roundtrip",
    sql(
        C1H,
        f"SELECT 'candles' AS measurement, symbol, 'spot' AS exchange, open_time AS time, open, high, low, close + CASE WHEN open_time >= {SPLIT} THEN 1 ELSE 0 END AS close, volume FROM c1h",
    ),
)
def points_roundtrip(spark, sf):
    path = work_dir(spark)
    points = tables.candle_points(klines(spark, sf))
    tables.write_points(points, path)
    # A later copy of half the points, twice: the second write changes nothing.
    newer = points.where(F.col("time") >= SPLIT).withColumns(
        {"close": F.col("close") + 1, "event_time": F.col("event_time") + 1}
    )
    tables.write_points(newer, path)
    tables.write_points(newer, path)
    return spark.read.parquet(path).select(
        "measurement", "symbol", "exchange", "time", "open", "high", "low", "close", "volume"
    )


@query("read_points", sql(C1H, "SELECT symbol, open_time AS time, close, volume FROM c1h"))
def read_points(spark, sf):
    long = candles(spark, sf).select(
        "symbol",
        F.col("open_time").alias("time"),
        F.explode(F.create_map(F.lit("close"), "close", F.lit("volume"), "volume")).alias("field", "value"),
    )
    return tables.read_points(long, ["close", "volume"])


@query(
    "upsert_series",
    sql(C1H, f"SELECT symbol, open_time, close + CASE WHEN open_time >= {SPLIT} AND open_time < {CUT} THEN 1 ELSE 0 END AS close FROM c1h"),
)
def upsert_series(spark, sf):
    path = work_dir(spark)
    rows = candles(spark, sf).select("symbol", "open_time", "close").withColumn("event_time", F.lit(1))
    tables.upsert_series(rows.where(F.col("open_time") < CUT), path, ["event_time"])
    changed = rows.where(F.col("open_time") >= SPLIT).withColumns(
        {"close": F.col("close") + F.when(F.col("open_time") < CUT, 1).otherwise(0), "event_time": F.lit(2)}
    )
    tables.upsert_series(changed, path, ["event_time"])
    stale = changed.withColumns({"close": F.lit(-1.0), "event_time": F.lit(0)})
    tables.upsert_series(stale, path, ["event_time"])
    return spark.read.parquet(path).select("symbol", "open_time", "close")


@query("upsert_latest", sql(USERS, "SELECT symbol, price AS close, event_time FROM tk"))
def upsert_latest(spark, sf):
    path = work_dir(spark)
    rows = nation_tickers(spark, sf).select("symbol", "close", "event_time", "id")
    late = F.col("event_time") >= SPLIT
    for part in (rows.where(late), rows.where(~late), rows.where(late)):
        tables.upsert_latest(latest(part, ["symbol"], ["event_time", "id"]), path, ["event_time", "id"])
    return tables.read_latest(spark, path).drop("id")


@query("retention", sql(C1H, f"SELECT {STORED_SQL} FROM c1h WHERE open_time >= {CUT} - 3 * {DAY} OR symbol = 'view'"))
def retention(spark, sf):
    name = new_table(spark)
    # Candles of one symbol are still open and outlive the cutoff.
    rows = klines(spark, sf).withColumn("is_closed", F.col("symbol") != "view")
    tables.append_klines(rows, name)
    maintenance.apply_retention(name, spark, as_of=CUT, days=3)
    return spark.table(name).select(*STORED)


@query("retention_days", sql(C1H, f"SELECT DISTINCT CAST(CAST(epoch_ms(open_time) AS DATE) AS VARCHAR) AS day FROM c1h WHERE open_time >= {CUT} - 3 * {DAY}"))
def retention_days(spark, sf):
    name = stored_klines(spark, sf)
    maintenance.apply_retention(name, spark, as_of=CUT, days=3)
    return spark.sql(f"SHOW PARTITIONS {name}").select(F.split("partition", "=")[1].alias("day"))


@query("compact", sql(C1H, f"SELECT {STORED_SQL}, 1 AS files FROM c1h"))
def compact(spark, sf):
    name = new_table(spark)
    rows = klines(spark, sf)
    for part in range(6):
        tables.append_klines(rows.where(F.pmod((F.col("kline_start") / HOUR).cast("bigint"), F.lit(6)) == part), name)
    maintenance.compact(name, spark, min_files=2)
    out = spark.table(name)
    return out.select(*STORED, "day").join(
        maintenance.file_report(out).select("day", F.col("files").cast("int").alias("files")), "day"
    ).drop("day")


@query(
    "populate",
    sql(C1H, f"SELECT {STORED_SQL} FROM c1h WHERE open_time >= {CUT} - 10 * {DAY} AND open_time < {CUT} AND symbol IN ('click', 'error')"),
)
def populate(spark, sf):
    name = new_table(spark)
    maintenance.populate(klines(spark, sf), name, 10, CUT, ["click", "error"])
    return spark.table(name).select(*STORED)


@query("load_history", sql(C1H, f"SELECT {STORED_SQL} FROM c1h WHERE open_time < {CUT}"))
def load_history(spark, sf):
    name = new_table(spark)
    rows = klines(spark, sf)
    part = (F.col("symbol") != "view") & (F.col("kline_start") < SPLIT + F.length("symbol") * HOUR)
    maintenance.load_history(rows.where(part), name, CUT, "backfill")
    maintenance.load_history(rows, name, CUT)
    maintenance.load_history(rows, name, CUT)
    return spark.table(name).select(*STORED)


@query(
    "hourly_table",
    sql(TICKS, ohlcv("m", "ticks", MINUTE), f"""SELECT symbol, open_time - open_time % {HOUR} AS open_time, first(open ORDER BY open_time) AS open,
    max(high) AS high, min(low) AS low, last(close ORDER BY open_time) AS close, round(sum(volume), 8) AS volume, CAST(sum(trade_count) AS BIGINT) AS trade_count
    FROM m GROUP BY 1, 2"""),
)
def hourly_table(spark, sf):
    from candlelake.operators.candles import rollup_hourly

    path = work_dir(spark)
    hourly = rollup_hourly(candles(spark, sf, "1m"))
    tables.upsert_series(hourly, path, ["trade_count"])
    return spark.read.parquet(path).select(*OHLCV_COLUMNS, "trade_count")
