"""Tables: writing, replaying, retention and compaction."""

import uuid

import pytest
from pyspark.sql import functions as F

from candlelake.plans import maintenance
from candlelake.schemas import DAY_MS, HISTORY_START_MS
from candlelake.sources import tables
from candlelake.workspace import cut, work_dir

H = 3_600_000


@pytest.fixture
def table(spark, tmp_path):
    database = f"t_{uuid.uuid4().hex}"
    tables.ensure_tables(spark, database, str(tmp_path / "db"))
    return f"{database}.coin_klines"


def klines(spark, hours, symbols=("A", "B"), interval="1m", closed=True, start=0):
    df = spark.range(hours).select((F.col("id") * H + start).alias("kline_start"))
    df = df.withColumn("symbol", F.explode(F.array(*[F.lit(s) for s in symbols])))
    price = (F.col("kline_start") / H).cast("double")
    return df.select(
        F.col("kline_start").alias("event_time"), "symbol", "kline_start", (F.col("kline_start") + 59_999).alias("kline_close"),
        F.lit(interval).alias("interval"), *[price.alias(c) for c in ("open", "high", "low", "close")],
        F.lit(1.0).alias("volume"), F.lit(2.0).alias("quote_volume"), F.lit(3).cast("bigint").alias("trade_count"),
        F.lit(closed).alias("is_closed"),
    )


def days(spark, name):
    return sorted(str(r[0]).split("=")[1] for r in spark.sql(f"SHOW PARTITIONS {name}").collect())


def test_all_tables_exist_and_creation_repeats(spark, table, tmp_path):
    database = table.split(".")[0]
    tables.ensure_tables(spark, database, str(tmp_path / "db"))
    names = {r["tableName"] for r in spark.sql(f"SHOW TABLES IN {database}").collect()}
    assert names == set(tables.TABLES)
    for name, (schema, _) in tables.TABLES.items():
        assert spark.table(f"{database}.{name}").columns == [*schema.fieldNames(), "day"]


def test_append_is_clustered_and_pruned(spark, table):
    tables.append_klines(klines(spark, 72).repartition(5), table)
    assert days(spark, table) == ["1970-01-01", "1970-01-02", "1970-01-03"]
    per_file = spark.table(table).select(F.input_file_name().alias("f"), F.monotonically_increasing_id().alias("i"), "symbol", "kline_start")
    rows = [tuple(r) for r in per_file.orderBy("f", "i").select("f", "symbol", "kline_start").collect()]
    assert rows == sorted(rows)
    out = tables.read_cold(spark.table(table), ["A"], end=DAY_MS + 2 * H, start=DAY_MS)
    assert sorted(r["open_time"] for r in out.collect()) == [DAY_MS, DAY_MS + H]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "PushedFilters: [IsNotNull(is_closed)" in plan


def test_cold_read_limits_and_order_of_bounds(spark, table):
    tables.append_klines(klines(spark, 48), table)
    tables.append_klines(klines(spark, 48, closed=False, start=1), table)
    out = tables.read_cold(spark.table(table), None, end=30 * H, n=3)
    assert sorted((r["symbol"], r["open_time"] // H) for r in out.collect()) == [(s, h) for s in "AB" for h in (27, 28, 29)]


def test_other_records_land_too(spark, table):
    database = table.split(".")[0]
    ticks = spark.createDataFrame([(DAY_MS + 1, "A", 1.0)], "event_time bigint, symbol string, close double")
    tables.append_rows(ticks, f"{database}.coin_ticker", "event_time", "symbol", "event_time")
    row = spark.table(f"{database}.coin_ticker").first()
    assert (row["close"], row["bid"], str(row["day"])) == (1.0, None, "1970-01-02")


def test_upsert_keeps_the_newest_and_replays(spark, tmp_path):
    path = str(tmp_path / "series")
    ddl = "symbol string, open_time bigint, close double, event_time bigint"
    first = spark.createDataFrame([("A", 0, 1.0, 5), ("A", DAY_MS, 2.0, 5), ("B", 0, 3.0, 5)], ddl)
    tables.upsert_series(first, path, ["event_time"])
    second = spark.createDataFrame([("A", 0, 9.0, 6), ("B", 0, 8.0, 4), ("C", 0, 7.0, 1), ("C", 0, 6.0, 0)], ddl)
    for _ in range(2):
        tables.upsert_series(second, path, ["event_time"])
        got = sorted((r["symbol"], r["open_time"], r["close"]) for r in spark.read.parquet(path).collect())
        assert got == [("A", 0, 9.0), ("A", DAY_MS, 2.0), ("B", 0, 3.0), ("C", 0, 7.0)]


def test_upsert_leaves_other_partitions_alone(spark, tmp_path):
    path = str(tmp_path / "series")
    ddl = "symbol string, open_time bigint, close double"
    tables.upsert_series(spark.createDataFrame([("A", 0, 1.0), ("A", DAY_MS, 2.0)], ddl), path, ["close"])
    before = {f for f in spark.read.parquet(path).inputFiles() if "1970-01-01" in f}
    tables.upsert_series(spark.createDataFrame([("A", DAY_MS, 3.0)], ddl), path, ["close"])
    after = {f for f in spark.read.parquet(path).inputFiles() if "1970-01-01" in f}
    assert before == after


def test_upsert_latest(spark, tmp_path):
    path = str(tmp_path / "latest")
    ddl = "symbol string, price double, event_time bigint"
    for rows in ([("A", 1.0, 5), ("B", 2.0, 5)], [("A", 3.0, 4), ("B", 4.0, 6), ("C", 5.0, 1)]):
        tables.upsert_latest(spark.createDataFrame(rows, ddl), path, ["event_time"])
    assert sorted(tuple(r) for r in tables.read_latest(spark, path).collect()) == [("A", 1.0, 5), ("B", 4.0, 6), ("C", 5.0, 1)]


def test_points(spark):
    rows = klines(spark, 1).unionByName(klines(spark, 1, closed=False)).unionByName(klines(spark, 1, interval="1s"))
    assert tables.candle_points(rows).count() == 2
    long = spark.createDataFrame([("A", 1, "o", 1.0), ("A", 1, "c", 2.0), ("A", 2, "c", 3.0)], "symbol string, time bigint, field string, value double")
    got = sorted(tuple(r) for r in tables.read_points(long, ["o", "c"]).collect())
    assert got == [("A", 1, 1.0, 2.0), ("A", 2, None, 3.0)]


def test_retention(spark, table):
    tables.append_klines(klines(spark, 96), table)
    tables.append_klines(klines(spark, 24, interval="1h", symbols=("A",)), table)
    tables.append_klines(klines(spark, 24, closed=False, symbols=("C",), start=DAY_MS), table)
    cutoff = 2 * DAY_MS + 5 * H
    untouched = {f for f in spark.table(table).inputFiles() if "1970-01-04" in f}
    maintenance.apply_retention(table, spark, as_of=cutoff + 2 * DAY_MS, days=2)
    left = spark.table(table)
    closed = left.where("interval = '1m' AND is_closed")
    assert closed.agg(F.min("kline_start")).first()[0] == cutoff  # the row exactly at the cutoff stays
    assert closed.count() == 2 * (96 - 53)
    assert left.where("interval = '1h'").count() == 24 and left.where("NOT is_closed").count() == 24
    assert {f for f in left.inputFiles() if "1970-01-04" in f} == untouched


def test_retention_drops_whole_days_and_keeps_at_least_one(spark, table):
    tables.append_klines(klines(spark, 72), table)
    maintenance.apply_retention(table, spark, as_of=3 * DAY_MS, days=0)
    assert days(spark, table) == ["1970-01-03"]
    maintenance.apply_retention(table, spark, as_of=3 * DAY_MS, days=1)
    assert spark.table(table).count() == 48


def test_compact(spark, table):
    for part in range(6):
        tables.append_klines(klines(spark, 48, symbols=(f"S{part}",)), table)
    rows = sorted(tuple(r) for r in spark.table(table).drop("ingested_at", "kline_timestamp").collect())
    report = {str(r["day"]): r["files"] for r in maintenance.file_report(spark.table(table)).collect()}
    assert report == {"1970-01-01": 6, "1970-01-02": 6}
    maintenance.compact(table, spark, min_files=7)
    assert maintenance.file_report(spark.table(table)).first()["files"] == 6
    maintenance.compact(table, spark)
    assert {r["files"] for r in maintenance.file_report(spark.table(table)).collect()} == {1}
    assert sorted(tuple(r) for r in spark.table(table).drop("ingested_at", "kline_timestamp").collect()) == rows


def test_compact_splits_a_large_day(spark, table):
    for part in range(5):
        tables.append_klines(klines(spark, 24, symbols=(f"S{part}",)), table)
    size = maintenance.file_report(spark.table(table)).first()["bytes"]
    maintenance.compact(table, spark, target_bytes=size // 3)
    assert 1 < maintenance.file_report(spark.table(table)).first()["files"] <= 4
    assert spark.table(table).count() == 120


def test_load_history(spark, table):
    start = HISTORY_START_MS - HISTORY_START_MS % H + H
    source = klines(spark, 10, start=start)
    as_of = start + 8 * H + 30_000
    maintenance.load_history(source.where(f"symbol = 'A' AND kline_start < {start + 3 * H}"), table, as_of, "backfill")
    for _ in range(2):
        maintenance.load_history(source, table, as_of)
        assert {r["symbol"]: r["count"] for r in spark.table(table).groupBy("symbol").count().collect()} == {"A": 8, "B": 8}
    with pytest.raises(ValueError):
        maintenance.load_history(source, table, as_of, "sometimes")


def test_populate(spark, table):
    maintenance.populate(klines(spark, 72), table, 1, 3 * DAY_MS, ["B"])
    out = spark.table(table)
    assert out.count() == 24 and {r["symbol"] for r in out.collect()} == {"B"}


def test_backfill_gaps(spark):
    ticks = spark.createDataFrame([("A", 0, 1.0), ("A", 5 * H, 1.0)], "symbol string, event_time bigint, price double")
    out = maintenance.backfill_gaps(ticks, klines(spark, 10), as_of=DAY_MS)
    assert sorted((r["symbol"], r["event_time"] // H, r["source"]) for r in out.collect()) == [("A", h, "backfill") for h in (1, 2, 3, 4, 5)]


def test_work_dir_follows_the_session(spark):
    a, b = work_dir(spark), work_dir(spark)
    assert a != b
    base = spark.conf.get("spark.checkpoint.dir", None)
    assert base is None or a.startswith(base)


def test_cut_goes_to_the_checkpoint_folder(spark):
    df = cut(spark.range(5).withColumn("x", F.rand()))
    assert df.collect() == df.collect()
    assert df.sparkSession.sparkContext.getCheckpointDir() is not None


def test_upsert_keeps_columns_that_a_batch_lacks(spark, tmp_path):
    path = str(tmp_path / "kept")
    full = spark.createDataFrame([("A", 0, 1.0, 5.0), ("B", 0, 2.0, 6.0)], "symbol string, open_time bigint, close double, volume double")
    tables.upsert_series(full, path, ["close"])
    tables.upsert_series(full.where("symbol = 'A'").drop("volume").withColumn("close", F.lit(9.0)), path, ["close"])
    out = {r["symbol"]: (r["close"], r["volume"]) for r in spark.read.parquet(path).collect()}
    assert out == {"A": (9.0, 5.0), "B": (2.0, 6.0)}
    with pytest.raises(ValueError):
        tables.upsert_series(full.withColumn("volume", F.lit("x")), path, ["close"])


def scanned(df):
    """(partition filters, files) of every scan of the plan that ran."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return [line[line.index("PartitionFilters") :].split("]")[0] for line in plan.splitlines() if "PartitionFilters" in line]


def test_newest_rows_open_the_newest_days_only(spark, tmp_path):
    from candlelake.operators.candles import last_time
    from candlelake.operators.walk import newest_days
    from candlelake.plans import queries as P

    path = str(tmp_path / "days")
    rows = klines(spark, 90 * 24, symbols=("A", "B")).unionByName(klines(spark, 24, symbols=("OLD",)))
    tables.with_day(rows, "kline_start").write.partitionBy("day").parquet(path)
    table = spark.read.parquet(path)
    out = last_time(table, symbols=["A", "B"])
    assert {r.symbol: r.last_time for r in out.collect()} == {"A": (90 * 24 - 1) * H, "B": (90 * 24 - 1) * H}
    assert all(">= 1970-03-31" in f and "<= 1970-03-31" in f for f in scanned(out))
    found, met = newest_days(table, ["A", "B"], 1, time="kline_start")
    assert met and found.select("day").distinct().count() == 1
    found, met = newest_days(table, ["A", "B"], 30, time="kline_start", end=50 * DAY_MS + H)
    assert met and sorted(str(r.day) for r in found.select("day").distinct().collect()) == [f"1970-02-{d}" for d in (17, 18, 19, 20)]
    found, met = newest_days(table, ["A", "OLD"], 1, time="kline_start")
    assert met and found.select("day").distinct().count() == 90
    found, met = newest_days(table, spark.createDataFrame([("NONE",)], "symbol string"), 1, time="kline_start")
    assert not met and found.count() == 0
    cold = tables.read_cold(table, ["A"], n=5)
    assert sorted(r.open_time for r in cold.collect()) == [(90 * 24 - i) * H for i in range(5, 0, -1)]
    bars = table.withColumnRenamed("kline_start", "open_time").select("symbol", "open_time", "open", "high", "low", "close", "volume", "day")
    base = P.collect_base(bars, bars.where("false"), "4h", 3, 90 * DAY_MS, 0, ["A", "B"])
    assert base.count() == 24 and base.select(F.min("open_time")).first()[0] == (90 * 24 - 12) * H


def test_newest_days_of_whole_buckets(spark, tmp_path):
    """A week that begins before the days that are read does not count as met."""
    from candlelake.operators.walk import newest_days

    path = str(tmp_path / "weeks")
    tables.with_day(klines(spark, 40 * 24, symbols=("A",)), "kline_start").write.partitionBy("day").parquet(path)
    week = 7 * DAY_MS
    found, met = newest_days(spark.read.parquet(path), ["A"], 2, end=40 * DAY_MS, time="kline_start", unit_ms=week)
    whole = found.groupBy((F.col("kline_start") - F.col("kline_start") % week).alias("w")).count().orderBy("w").collect()
    assert met and [r["count"] for r in whole[-2:]] == [168, (40 * DAY_MS % week) // H] and len(whole) > 2


def test_repaired_points_are_landed_once_and_read_few_days(spark, tmp_path):
    path, source = str(tmp_path / "points"), str(tmp_path / "klines")
    live = spark.createDataFrame([("A", h * H, 1.0) for h in range(0, 240) if not 100 < h < 110], "symbol string, event_time bigint, price double")
    none = [F.lit(None).cast("double").alias(c) for c in ("bid", "ask", "volume", "quote_volume", "price_change_pct")]
    tables.write_points(tables.backfill_points(live.select("*", *none, F.lit(None).cast("bigint").alias("trade_count"))), path)
    tables.with_day(klines(spark, 240, symbols=("A",)), "kline_start").write.partitionBy("day").parquet(source)
    stored = spark.read.parquet(source)
    for _ in range(2):
        done = maintenance.repair_points(spark, path, stored, as_of=240 * H, min_gap_ms=2 * H).collect()
        assert [(r.symbol, r.gaps, r.filled_gaps) for r in done] == [("A", 1, 1)]
        points = spark.read.parquet(path)
        assert points.count() == 241 and points.where("source = 'backfill'").count() == 10  # both ends of a gap count
    assert maintenance.repair_points(spark, path, stored, as_of=240 * H, min_gap_ms=2 * H, include_backfill=True).collect() == []
    gaps_found = maintenance.find_gaps(tables.read_ticks(spark.read.parquet(path)), 240 * H, 2 * H)
    assert any("day" in f and ">=" in f for f in scanned(gaps_found))
    assert [str(r[0]) for r in maintenance.gap_days(gaps_found).collect()] == ["1970-01-05"]


def test_the_number_of_shards_stays_with_the_table(spark, tmp_path):
    path = str(tmp_path / "latest")
    ddl = "symbol string, close double, event_time bigint"
    tables.upsert_latest(spark.createDataFrame([("A", 1.0, 1), ("B", 2.0, 1)], ddl), path, ["event_time"], shards=3)
    tables.upsert_latest(spark.createDataFrame([("A", 5.0, 2), ("C", 3.0, 1)], ddl), path, ["event_time"])
    assert sorted(tuple(r) for r in tables.read_latest(spark, path).collect()) == [("A", 5.0, 2), ("B", 2.0, 1), ("C", 3.0, 1)]
    assert spark.read.parquet(path).agg(F.max("shard")).first()[0] < 3
    with pytest.raises(ValueError, match="3 shards"):
        tables.upsert_latest(spark.createDataFrame([("A", 1.0, 1)], ddl), path, ["event_time"], shards=16)
