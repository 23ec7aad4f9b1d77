"""Streaming forms, run over files of the events table that land in order of time."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import functions as F

from candlelake.schemas import KLINE, TRADE
from candlelake.sources import tables, topics
from candlelake.sources.tables import with_day
from candlelake.streaming import stateful, streams, windows
from candlelake.workspace import work_dir
from suite.base import C1H, DAY, END, HOUR, MINUTE, TICKS, candles, klines, ohlcv, query, sql, ticks
from suite.candle_queries import GRID
from suite.series_queries import NUMBERED, THROTTLE, _ema_sql, _sma_sql

#: Steps the files land in; each becomes one micro-batch.
STEPS = 4
FILES = 2
#: A symbol without rows for this long (wall clock, ms) gets its open windows by timer.
SILENT = 1000


def landed(spark, df, time, path):
    """Write rows in ``STEPS`` runs, each later in time than the one before, and stream them back."""
    width = 31 * DAY // STEPS
    step = F.least(F.greatest(F.floor((F.col(time) - (END - 31 * DAY)) / width), F.lit(0)), F.lit(STEPS - 1))
    stored = df.withColumn("_step", step)
    for i in range(STEPS):
        part = stored.where(F.col("_step") == i).drop("_step")
        part.repartition(FILES).sortWithinPartitions(time).write.mode("append").parquet(path)
    return topics.read_stream(spark, path, df.schema, files_per_trigger=FILES)


@contextmanager
def state_partitions(spark):
    """One state partition per core: adaptive execution does not merge the partitions of a stateful stream."""
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(spark.sparkContext.defaultParallelism))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def finished(stream, spark, time=None, silent_ms=0):
    """Run a stream over all input that is there; returns what it wrote.

    A stream with timers is left to flush by them ``silent_ms`` after the last of its input.
    """
    work = work_dir(spark)
    with state_partitions(spark):
        query_ = streams.start_sink(stream, f"{work}/out", f"{work}/checkpoint", time, once=True)
        streams.drain(query_, silent_ms) if silent_ms else query_.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{work}/out")


def trade_rows(spark, sf):
    return ticks(spark, sf).select(
        "event_time",
        "symbol",
        F.col("id").alias("agg_trade_id"),
        "price",
        F.col("volume").alias("quantity"),
        F.col("event_time").alias("trade_time"),
        (F.pmod("id", F.lit(2)) == 0).alias("is_buyer_maker"),
    )


@query(
    "stream_ohlcv",
    sql(
        TICKS,
        ohlcv("c", "ticks", HOUR),
        "SELECT symbol, open_time, open, high, low, close, volume, trade_count FROM c",
    ),
)
def stream_ohlcv(spark, sf):
    source = landed(spark, trade_rows(spark, sf), "event_time", work_dir(spark) + "/crypto_trades")
    streams.use_rocksdb(spark)
    return finished(windows.stream_candles(source, "1h", idle_ms=SILENT, quiet_ms=SILENT), spark, silent_ms=SILENT)


@query(
    "stream_trades",
    sql(TICKS, "SELECT symbol, t AS event_time, id AS agg_trade_id, price, CAST(CAST(epoch_ms(t) AS DATE) AS VARCHAR) AS day, TRUE AS stamped FROM ticks"),
)
def stream_trades(spark, sf):
    root = work_dir(spark)
    rows = trade_rows(spark, sf)
    landed(spark, rows.select(*[F.col(f.name).cast(f.dataType) for f in TRADE]), "event_time", root + "/crypto_trades")
    stream = streams.trade_stream(topics.read_topic(spark, root, "crypto_trades", files_per_trigger=FILES))
    out = finished(with_day(stream, "trade_time"), spark)
    return out.select(
        "symbol", "event_time", "agg_trade_id", "price", F.col("day").cast("string").alias("day"), (F.unix_millis("trade_timestamp") == F.col("trade_time")).alias("stamped")
    )


@query(
    "stream_dedup",
    sql(TICKS, "SELECT symbol, t AS event_time, min(price) AS close FROM ticks GROUP BY symbol, t"),
)
def stream_dedup(spark, sf):
    # Every ticker arrives twice.
    rows = ticks(spark, sf).groupBy("symbol", "event_time").agg(F.min("price").alias("close"))
    twice = rows.unionByName(rows)
    source = landed(spark, twice, "event_time", work_dir(spark) + "/crypto_ticker")
    return finished(streams.ticker_stream(source), spark).drop("event_timestamp")


@query(
    "stream_klines",
    sql(C1H, f"SELECT symbol, open_time AS kline_start, open, high, low, close, volume FROM c1h WHERE (open_time // {HOUR}) % 5 <> 0"),
)
def stream_klines(spark, sf):
    # Every kline arrives twice; some are still open.
    rows = klines(spark, sf).withColumn("is_closed", F.pmod((F.col("kline_start") / HOUR).cast("bigint"), F.lit(5)) != 0)
    twice = rows.unionByName(rows).select(*[F.col(f.name).cast(f.dataType) for f in KLINE])
    root = work_dir(spark)
    landed(spark, twice, "kline_start", root + "/crypto_klines")
    stream = streams.kline_stream(topics.read_topic(spark, root, "crypto_klines", files_per_trigger=FILES))
    return finished(stream, spark).select("symbol", "kline_start", "open", "high", "low", "close", "volume")


@query(
    "stream_rollup",
    sql(
        TICKS,
        ohlcv("m", "ticks", MINUTE),
        GRID,
        f"""SELECT symbol, w AS kline_start, first(open ORDER BY open_time) AS open, max(high) AS high, min(low) AS low,
        last(close ORDER BY open_time) AS close, round(sum(volume), 8) AS volume, CAST(sum(trade_count) AS BIGINT) AS trade_count FROM f
        GROUP BY symbol, w""",
    ),
)
def stream_rollup(spark, sf):
    streams.use_rocksdb(spark)
    rows = candles(spark, sf, "1m").withColumn("event_time", F.lit(1))
    # An earlier copy of each step, with other prices, must lose against the later one.
    stale = rows.withColumns({"close": F.col("close") + 5, "volume": F.lit(0.0), "event_time": F.lit(0)})
    source = landed(spark, rows.unionByName(stale), "open_time", work_dir(spark) + "/candles")
    out = finished(windows.stream_rollup(source, "1m", "1h", idle_ms=SILENT, quiet_ms=SILENT), spark, silent_ms=SILENT)
    return out.select("symbol", "kline_start", "open", "high", "low", "close", "volume", "trade_count")


@query(
    "stream_indicators",
    sql(
        C1H, NUMBERED, _ema_sql(12, "a"), _ema_sql(26, "b"),
        f"m AS (SELECT symbol, open_time, close, {_sma_sql(20)}, {_sma_sql(50)} FROM c1h)",
        """SELECT m.symbol, m.open_time AS timestamp, m.close, round(m.sma20, 6) AS sma20, round(m.sma50, 6) AS sma50,
        round(a.y, 6) AS ema12, round(b.y, 6) AS ema26 FROM m JOIN a USING (symbol, open_time) JOIN b USING (symbol, open_time)""",
    ),
)
def stream_indicators(spark, sf):
    streams.use_rocksdb(spark)
    source = landed(spark, candles(spark, sf), "open_time", work_dir(spark) + "/candles")
    return finished(stateful.stream_indicators(source, scale=6), spark)


@query("stream_throttle", sql(TICKS, THROTTLE, "SELECT symbol, event_time, price, reason FROM w WHERE reason <> 'skipped'"))
def stream_throttle(spark, sf):
    streams.use_rocksdb(spark)
    rows = ticks(spark, sf).select("symbol", "event_time", (F.floor(F.col("price") / 40) * 40.0).alias("price"), "id")
    source = landed(spark, rows, "event_time", work_dir(spark) + "/ticks")
    return finished(stateful.stream_throttle(source, HOUR, tie=["id"]), spark)


@query(
    "stream_live",
    sql(
        TICKS,
        f"""x AS (SELECT symbol, t AS event_time, t - t % {DAY} AS open_time, floor(price / 100) * 100 AS p, t, id FROM ticks),
        y AS (SELECT *, lag(p) OVER (PARTITION BY symbol ORDER BY t, id) AS b, lag(open_time) OVER (PARTITION BY symbol ORDER BY t, id) AS w FROM x)""",
        "SELECT symbol, event_time, open_time, p AS close FROM y WHERE b IS NULL OR b <> p OR w <> open_time",
    ),
)
def stream_live(spark, sf):
    streams.use_rocksdb(spark)
    price = F.floor(F.col("price") / 100) * 100.0
    rows = ticks(spark, sf).select(
        "symbol", "event_time", (F.col("event_time") - F.pmod("event_time", F.lit(DAY).cast("bigint"))).alias("open_time"),
        *[price.alias(c) for c in ("open", "high", "low", "close")], F.lit(0.0).alias("volume"), "id",
    )
    source = landed(spark, rows, "event_time", work_dir(spark) + "/ticks")
    return finished(stateful.stream_live_candle(source, tie=["id"]), spark).select("symbol", "event_time", "open_time", "close")


@query(
    "stream_history",
    sql(
        TICKS,
        f"""SELECT symbol, t AS event_time, price, count(*) OVER w AS held, max(price) OVER w AS top FROM ticks
        WINDOW w AS (PARTITION BY symbol ORDER BY t RANGE BETWEEN {3 * HOUR} PRECEDING AND CURRENT ROW)""",
    ),
)
def stream_history(spark, sf):
    """Ticks of the last three hours per symbol; what is silent for seven days by the wall clock leaves state."""
    streams.use_rocksdb(spark)
    source = landed(spark, ticks(spark, sf).select("symbol", "event_time", "price"), "event_time", work_dir(spark) + "/ticks")
    return finished(stateful.stream_history(source, 3 * HOUR, ttl_ms=7 * DAY), spark, silent_ms=1)


@query(
    "stream_fanout",
    sql(
        TICKS,
        ohlcv("c", "ticks", HOUR),
        """SELECT symbol, open_time, close, 'series' AS sink FROM c
        UNION ALL SELECT symbol, open_time, close, 'latest' AS sink FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) AS n FROM c) WHERE n = 1""",
    ),
)
def stream_fanout(spark, sf):
    """One stream of candles, growing hour by hour, upserted into a series and into a latest-value table."""
    root = work_dir(spark)
    rows = candles(spark, sf).select("symbol", "open_time", "close", F.lit(1).alias("seq"))
    source = landed(spark, rows, "open_time", root + "/candles")

    def series(batch, batch_id):
        tables.upsert_series(batch, f"{root}/series", ["seq"])

    def newest(batch, batch_id):
        from candlelake.operators.series import latest

        tables.upsert_latest(latest(batch, ["symbol"], ["open_time"]), f"{root}/latest", ["open_time"])

    with state_partitions(spark):
        streams.fan_out(source, {"series": series, "latest": newest}, f"{root}/checkpoint", once=True).awaitTermination()
    columns = ["symbol", "open_time", "close"]
    stored = spark.read.parquet(f"{root}/series").select(*columns, F.lit("series").alias("sink"))
    return stored.unionByName(tables.read_latest(spark, f"{root}/latest").select(*columns, F.lit("latest").alias("sink")))
