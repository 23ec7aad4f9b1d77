"""Streams of tickers, trades and klines, their sinks, and windowed candles."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence
from datetime import datetime
from time import sleep, time_ns

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from candlelake.functions.time import to_timestamp
from candlelake.operators.filters import closed_only, require
from candlelake.schemas import interval_seconds
from candlelake.sources.tables import with_day

# How late rows may come, and how often a sink commits.
TICKER_DELAY = "1 minute"
KLINE_DELAY = "2 minutes"
TRIGGER = "1 minute"

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Keep operator state in RocksDB, outside the JVM heap; custom state operators need it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def ticker_stream(df: DataFrame) -> DataFrame:
    """Tickers with their timestamp, one per symbol and event time."""
    rows = require(df, "event_time").withColumn("event_timestamp", to_timestamp("event_time"))
    return rows.withWatermark("event_timestamp", TICKER_DELAY).dropDuplicates(["symbol", "event_timestamp"])


def trade_stream(df: DataFrame, dedup: bool = False) -> DataFrame:
    """Trades with their timestamps; with ``dedup`` one per symbol and trade id."""
    rows = require(df, "event_time").withColumns(
        {"event_timestamp": to_timestamp("event_time"), "trade_timestamp": to_timestamp("trade_time")}
    )
    if not dedup:
        return rows
    return rows.withWatermark("event_timestamp", TICKER_DELAY).dropDuplicatesWithinWatermark(["symbol", "agg_trade_id"])


def kline_stream(df: DataFrame, interval: str = "1m") -> DataFrame:
    """Closed klines of one interval, one per symbol and start.

    Deduplication is bounded by the watermark, so its state does not grow with the stream.
    """
    rows = closed_only(require(df, "kline_start"), interval).withColumn("kline_timestamp", to_timestamp("kline_start"))
    return rows.withWatermark("kline_timestamp", KLINE_DELAY).dropDuplicatesWithinWatermark(["symbol", "kline_start"])


def stream_candles(
    trades: DataFrame, interval: str, delay: str = TICKER_DELAY, time: str = "trade_time", tie: Sequence[str] = ("agg_trade_id",)
) -> DataFrame:
    """Candles of an interval from a stream of trades, emitted once when the watermark passes them.

    Tumbling windows count from the epoch, so they are the buckets of the batch form.
    """
    order = F.struct(time, *tie) if tie else F.col(time)
    stamped = trades.withColumn("_ts", to_timestamp(time)).withWatermark("_ts", delay)
    bars = stamped.groupBy("symbol", F.window("_ts", f"{interval_seconds(interval)} seconds")).agg(
        F.min_by("price", order).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order).alias("close"),
        F.round(F.sum("quantity"), 8).alias("volume"),
        F.count(F.lit(1)).alias("trade_count"),
    )
    return bars.withColumn("open_time", F.unix_millis("window.start")).drop("window")


def start_sink(
    df: DataFrame, path: str, checkpoint: str, time: str | None = None, once: bool = False, trigger: str = TRIGGER
) -> StreamingQuery:
    """Append a stream to files partitioned by day, exactly once through its checkpoint.

    ``once`` takes all input that is there and stops.
    """
    rows = with_day(df, time) if time else df
    writer = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
    writer = writer.outputMode("append")
    if time:
        writer = writer.partitionBy("day")
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=trigger)
    return writer.start()


class Marks:
    """The last batch that each sink of a stream took, as one empty file per sink, named by the batch."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.root = path
        self.files = self.path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _folder(self, name: str):  # noqa: ANN202
        return self.path(f"{self.root}/{name}")

    def _all(self, name: str) -> list[int]:
        folder = self._folder(name)
        return [int(f.getPath().getName()) for f in self.files.listStatus(folder)] if self.files.exists(folder) else []

    def last(self, name: str) -> int:
        return max(self._all(name), default=-1)

    def set(self, name: str, batch_id: int) -> None:
        before = self._all(name)
        self.files.create(self.path(f"{self.root}/{name}/{batch_id}"), True).close()
        for old in before:
            if old < batch_id:
                self.files.delete(self.path(f"{self.root}/{name}/{old}"), False)


def fan_out(
    df: DataFrame,
    sinks: dict[str, Callable[[DataFrame, int], None]],
    checkpoint: str,
    mode: str = "append",
    once: bool = False,
    trigger: str = TRIGGER,
) -> StreamingQuery:
    """Write each micro-batch of one stream to several sinks.

    The batch is computed once and kept while the sinks read it. A failing sink fails the batch, which is then repeated;
    a sink that had taken it is left out, since each one's last batch is marked next to the checkpoint. So sinks may
    append. Only where the process dies between a sink's write and its mark does that sink see a batch again.
    """
    marks = Marks(df.sparkSession, f"{checkpoint.rstrip('/')}-sinks")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            for name, sink in sinks.items():
                if marks.last(name) < batch_id:
                    sink(batch, batch_id)
                    marks.set(name, batch_id)
        finally:
            batch.unpersist()

    writer = df.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=trigger)
    return writer.start()


def drain(query: StreamingQuery, silent_ms: int, poll_s: float = 0.2) -> None:
    """Let a query with processing-time timers take all input of its ``once`` run, then flush by timer, and stop it.

    Such a query never ends by itself, since a timer may always fire later. It is done when a batch without input has
    begun ``silent_ms`` after the end of the last batch with input, and is not the first after it (that may be one that
    an earlier run left half done): timers up to then have fired.
    """
    begun, empty = time_ns() / 1e6, 0
    seen = -1
    while query.isActive:
        for batch in query.recentProgress:
            if batch.batchId <= seen:
                continue
            seen, start = batch.batchId, datetime.fromisoformat(str(batch.timestamp)).timestamp() * 1000
            if batch.numInputRows:
                begun, empty = start + batch.batchDuration, 0
            else:
                empty += 1
        if empty > 1 and start >= begun + silent_ms:
            break
        sleep(poll_s)
    if query.exception():
        raise query.exception()
    query.stop()


def late_rows(query: StreamingQuery) -> int:
    """Rows a query dropped because they came after the watermark, in the progress entries Spark still holds."""
    return sum(
        op.get("numRowsDroppedByWatermark", 0) for p in query.recentProgress for op in p["stateOperators"]
    )


class LateRows(StreamingQueryListener):
    """Late rows of every query for as long as the session runs: ``spark.streams.addListener(LateRows())``.

    Spark holds the newest progress entries only; this keeps the sum, by query id.
    """

    def __init__(self) -> None:
        self.dropped: Counter[str] = Counter()

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        self.dropped[str(progress.id)] += sum(op.numRowsDroppedByWatermark for op in progress.stateOperators)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def expire(df: DataFrame, ttl_ms: int, as_of: int, time: str = "event_time") -> DataFrame:
    """Rows not older than their time to live at ``as_of``."""
    return df.where(F.col(time) > as_of - ttl_ms)
