import hashlib

import pytest
from pyspark.sql import functions as F

from candlelake import schemas
from candlelake.functions import numeric, text, time
from candlelake.operators import filters, symbols


def column(spark, values, expr, ddl="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {ddl}")
    return [r[0] for r in df.select("i", expr.alias("y")).orderBy("i").select("y").collect()]


@pytest.mark.parametrize(
    "raw, clean, valid",
    [
        ("btcusdt", "BTCUSDT", True),
        ("  ETHUSDT  ", "ETHUSDT", True),
        ("\tsolusdt\n", "SOLUSDT", True),
        ("1INCHUSDT", "1INCHUSDT", True),
        ("A" * 20, "A" * 20, True),
        ("A" * 21, "A" * 21, False),
        ("BTC/USDT", "BTC/USDT", False),
        ("DROP_TABLE", "DROP_TABLE", False),
        ("BTC​USDT", "BTC​USDT", False),
        ("BTC\x00USDT", "BTC\x00USDT", False),
        ("BTC ", "BTC ", False),
        ("'; DROP TABLE x; --", "'; DROP TABLE X; --", False),
        ("", "", False),
    ],
)
def test_symbols(spark, raw, clean, valid):
    df = spark.createDataFrame([(raw,)], "symbol string")
    row = filters.normalize_symbol(df, keep_rejects=True).first()
    assert (row["symbol"], row["valid"]) == (clean, valid)
    assert filters.normalize_symbol(df).count() == int(valid)


def test_null_symbol_is_rejected(spark):
    df = spark.createDataFrame([(None,), ("BTC",)], "symbol string")
    assert [r[0] for r in filters.normalize_symbol(df).collect()] == ["BTC"]


def test_intervals(spark):
    names = ["1s", "1M", "  1H  ", "4H", "1D", "1W", "5m", "15m", "2m", "", None]
    seconds = [1, 60, 3600, 14400, 86400, 604800, 300, 900, 0, 0, 0]
    assert column(spark, names, time.interval_ms("x")) == [s * 1000 for s in seconds]
    assert schemas.interval_millis(" 1H ") == 3_600_000
    with pytest.raises(ValueError):
        schemas.interval_millis("2m")


def test_buckets_start_at_the_epoch(spark):
    week = 7 * schemas.DAY_MS
    monday = 1_704_067_200_000  # 2024-01-01
    assert column(spark, [monday, -1, 0], time.bucket("x", week), "bigint") == [1_703_721_600_000, -week, 0]


def test_time_text_does_not_depend_on_the_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for z in ("UTC", "America/New_York"):
            spark.conf.set("spark.sql.session.timeZone", z)
            got = column(spark, [1704067200000, 1704067199999, 0], time.rfc3339("x"), "bigint")
            assert got == ["2024-01-01T00:00:00Z", "2023-12-31T23:59:59Z", "1970-01-01T00:00:00Z"]
            days = column(spark, [1704067199999, -1], time.day_of("x").cast("string"), "bigint")
            assert days == ["2023-12-31", "1969-12-31"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_names(spark):
    pairs = ["BTCUSDT", "ETHBTC", "ETHEUR", "USDT"]
    assert column(spark, pairs, text.display_name("x")) == ["BTC / USDT", "ETH / BTC", "ETHEUR", " / USDT"]
    pairs = ["BTCUSDT", "1INCHUSDT", "ETHBTC", "BNBETH", "USDT", "XYZ", "BTCUSDTBUSD"]
    assert column(spark, pairs, text.base_coin("x")) == ["BTC", "1INCH", "ETH", "BNB", "USDT", "XYZ", "BTCUSDT"]


def test_active_symbols_are_sorted(spark):
    df = spark.createDataFrame([("ETHBTC",), ("BTCUSDT",), ("ETHBTC",)], "symbol string")
    assert [tuple(r) for r in symbols.active_symbols(df).collect()] == [
        ("BTCUSDT", "BTC / USDT", "crypto"),
        ("ETHBTC", "ETH / BTC", "crypto"),
    ]


@pytest.mark.parametrize("partitions", [12, 7, 1])
def test_key_partition(spark, partitions):
    keys = ["BTCUSDT", "ETHUSDT", "", "é", *[f"S{i}" for i in range(50)]]
    want = [int(hashlib.md5(k.encode()).hexdigest(), 16) % partitions for k in keys]
    assert column(spark, keys, text.key_partition("x", partitions)) == want


def test_numbers(spark):
    assert column(spark, ["1.5", "x", None], numeric.number("x")) == [1.5, 0.0, 0.0]
    assert column(spark, ["1.5", "x", None], numeric.number("x", strict=True)) == [1.5, None, None]
    assert column(spark, [2e9, 2.5e6, 3100.0, 42.0], numeric.compact_number("x"), "double") == ["2.00B", "2.50M", "3.1K", "42.00"]
    df = spark.createDataFrame([(100.0, 110.0), (0.0, 5.0)], "open double, close double")
    assert [r[0] for r in df.select(numeric.pct_change("open", "close")).collect()] == [10.0, 0.0]


def test_rounded_is_round(spark):
    tie = [0.00005, 0.00015, 1.00005, 2.00015, 14.28565, 99999999.99995, -0.00005, -2.00015]
    odd = [0.0, -0.0, -0.00003, float("inf"), float("-inf"), float("nan"), None, 5e-324, 1e300, 1e7 + 0.00005]
    shares = [100 * i / n for n in range(1, 60) for i in range(n)]
    for scale in (3, 4):
        got = column(spark, tie + odd + shares, numeric.rounded("x", scale), "double")
        assert list(map(repr, got)) == list(map(repr, column(spark, tie + odd + shares, F.round("x", scale), "double")))


def test_time_range_is_half_open_and_checked(spark, candles):
    df = candles([(t, 1, 1, 1, 1, 1) for t in (0, 10, 20)])
    assert [r["open_time"] for r in filters.time_range(df, 0, 20).collect()] == [0, 10]
    with pytest.raises(ValueError):
        filters.time_range(df, 20, 20)
    with pytest.raises(ValueError):
        filters.time_range(df, 0, 400 * schemas.DAY_MS, max_days=365)


def test_time_range_prunes_days(spark, tmp_path):
    day = schemas.DAY_MS
    df = spark.range(10).select((F.col("id") * day).alias("open_time")).withColumn("day", time.day_of("open_time"))
    df.write.partitionBy("day").parquet(str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    out = filters.time_range(stored, 3 * day, 5 * day)
    assert sorted(r["open_time"] // day for r in out.collect()) == [3, 4]
    assert len(out.inputFiles()) >= 2
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan


def test_search_and_page(spark):
    df = spark.createDataFrame([(f"S{i:02d}", f"Name {i}") for i in range(25)], "symbol string, name string")
    assert filters.search_symbols(df, "NAME 2").count() == 6
    assert filters.search_symbols(df, "").count() == 25
    assert [r[0] for r in symbols.page(df, 99, "symbol").collect()] == [f"S{i:02d}" for i in range(20, 25)]
    assert [r[0] for r in symbols.page(df, -1, "symbol").collect()] == [f"S{i:02d}" for i in range(10)]


def test_pack_and_unpack(spark, candles):
    df = candles([(0, 1, 2, 0.5, 1.5, 10, True)])
    packed = filters.pack_candle(df)
    assert packed.first()["candle"] == '{"t":0,"o":1.0,"h":2.0,"l":0.5,"c":1.5,"v":10.0,"x":true}'
    back = filters.unpack_candle(packed).select(*df.columns)
    assert back.collect() == df.collect()


def test_to_candles(spark, candles):
    row = filters.to_candles(candles([(60_000, 1, 2, 0, 1, 3)])).first()
    assert row.asDict() == {"symbol": "BTCUSDT", "openTime": 60_000, "open": 1, "high": 2, "low": 0, "close": 1, "volume": 3}
    assert filters.to_candles(candles([(60_500, 1, 2, 0, 1, 3)]), seconds=True).first()["time"] == 60
