"""Streams give the batch answer over files that land in order, restart cleanly and drop only what is late."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlelake.operators import ticks as T
from candlelake.operators.candles import rollup, trades_to_candles
from candlelake.operators.indicators import indicator_table
from candlelake.sources import topics
from candlelake.sources.tables import read_latest, upsert_latest, upsert_series
from candlelake.streaming import stateful, streams, windows

M = 60_000


class Feed:
    """A folder that files land in, one per batch, and a stream over it."""

    def __init__(self, spark, path, ddl):
        self.spark, self.path, self.ddl = spark, str(path), ddl
        (path / "in").mkdir()
        self.schema = spark.createDataFrame([], ddl).schema

    def land(self, rows):
        self.spark.createDataFrame(rows, self.ddl).coalesce(1).write.mode("append").parquet(self.path + "/in")

    def stream(self):
        return topics.read_stream(self.spark, self.path + "/in", self.schema, files_per_trigger=1)

    def run(self, build, time=None, silent_ms=0):
        stream = build(self.stream())
        query = streams.start_sink(stream, self.path + "/out", self.path + "/cp", time, once=True)
        streams.drain(query, silent_ms) if silent_ms else query.awaitTermination()
        self.query = query
        return self.spark.read.schema(stream.schema).parquet(self.path + "/out")


@pytest.fixture
def feed(spark, tmp_path):
    streams.use_rocksdb(spark)
    return lambda ddl: Feed(spark, tmp_path, ddl)


TRADES = "event_time bigint, symbol string, agg_trade_id bigint, price double, quantity double, trade_time bigint, is_buyer_maker boolean"


def trade_rows(seed, n=200):
    rng = random.Random(seed)
    times = sorted(rng.randrange(0, 20 * M) for _ in range(n))
    return [(t, rng.choice("AB"), i, round(rng.uniform(1, 9), 2), 1.0, t, True) for i, t in enumerate(times)]


def batches(rows, n):
    size = -(-len(rows) // n)
    return [rows[i : i + size] for i in range(0, len(rows), size)]


def test_candles_equal_the_batch_form(spark, feed):
    f, rows = feed(TRADES), trade_rows(1)
    for part in batches(rows, 4):
        f.land(part)
    f.land([(10**9, "Z", 10**6, 1.0, 1.0, 10**9, True)])  # moves the watermark past everything
    out = f.run(lambda s: streams.stream_candles(s, "1m"))
    columns = ["symbol", "open_time", "open", "high", "low", "close", "volume", "trade_count"]
    want = trades_to_candles(spark.createDataFrame(rows, TRADES), "1m").select(*columns)
    assert sorted(map(tuple, out.select(*columns).where("symbol != 'Z'").collect())) == sorted(map(tuple, want.collect()))


def test_late_rows(feed):
    f = feed(TRADES)

    def row(t, i):
        return (t, "A", i, float(i), 1.0, t, True)

    f.land([row(0, 1), row(70_000, 2)])
    f.land([row(30_000, 3)])  # minute 0 is still open: the watermark stands at 10 s
    f.land([row(300_000, 4)])
    f.land([row(310_000, 7)])  # the batch after the watermark moved emits minute 0
    f.land([row(40_000, 5)])
    f.land([row(900_000, 6)])
    out = f.run(lambda s: streams.stream_candles(s, "1m"))
    assert {r["open_time"]: r["trade_count"] for r in out.collect()} == {0: 2, M: 1, 5 * M: 2}
    assert streams.late_rows(f.query) == 1


def test_trades_land_by_day_and_resume(spark, feed):
    f, rows = feed(TRADES), trade_rows(2)
    first, second = batches(rows, 2)
    f.land(first)
    f.run(streams.trade_stream, time="trade_time")
    f.land(second)
    out = f.run(streams.trade_stream, time="trade_time")
    assert sorted(r["agg_trade_id"] for r in out.collect()) == list(range(len(rows)))


def test_trade_ids_can_be_unique(feed):
    f, rows = feed(TRADES), trade_rows(3, 40)
    f.land(rows)
    f.land(rows[-5:])
    assert f.run(lambda s: streams.trade_stream(s, dedup=True)).count() == 40


def test_ticker_and_kline_dedup(spark, tmp_path):
    (tmp_path / "t").mkdir(), (tmp_path / "k").mkdir()
    ticker = Feed(spark, tmp_path / "t", "event_time bigint, symbol string, close double")
    ticker.land([(1000, "A", 1.0), (1000, "A", 1.0), (1000, "B", 1.0), (None, "B", 1.0)])
    ticker.land([(1000, "A", 2.0), (2000, "A", 1.0)])
    out = ticker.run(streams.ticker_stream)
    assert sorted((r["symbol"], r["event_time"]) for r in out.collect()) == [("A", 1000), ("A", 2000), ("B", 1000)]
    kline = Feed(spark, tmp_path / "k", "symbol string, kline_start bigint, interval string, is_closed boolean")
    kline.land([("A", M, "1m", True), ("A", M, "1m", True), ("A", M, "1s", True), ("A", 2 * M, "1m", False)])
    kline.land([("A", M, "1m", True), ("A", 2 * M, "1m", True), ("A", None, "1m", True)])
    out = kline.run(streams.kline_stream)
    assert sorted(r["kline_start"] for r in out.collect()) == [M, 2 * M]


STEPS = (
    "symbol string, open_time bigint, open double, high double, low double, close double, volume double, "
    "quote_volume double, trade_count bigint, event_time bigint"
)


def test_rollup_equals_the_batch_form(spark, feed):
    rng, f, rows = random.Random(5), feed(STEPS), []
    for t in sorted(rng.sample(range(1, 900), 200)):
        for s in "AB":
            o, c = rng.uniform(1, 9), rng.uniform(1, 9)
            rows.append((s, t * 1000, o, max(o, c), min(o, c), c, 1.0, c, 1, 2 * t))
            if rng.random() < 0.3:  # an older copy that arrives with it or after it
                rows.append((s, t * 1000, 0.5, 99.0, 0.1, 50.0, 9.0, 9.0, 9, 2 * t - 1))
    for part in batches(rows, 5):
        f.land(part)
    out = f.run(lambda df: windows.stream_rollup(df, idle_ms=1500, quiet_ms=1500), silent_ms=1500)
    columns = [c for c in out.columns if c != "quote_volume"]
    want = rollup(spark.createDataFrame(rows, STEPS), arrival=["event_time"]).select(*columns)
    assert sorted(map(tuple, out.select(*columns).collect())) == sorted(map(tuple, want.collect()))


def test_silent_symbols_are_flushed_by_timer_and_late_rows_counted(spark, feed):
    f = feed(STEPS)
    build = lambda df: windows.stream_rollup(df, idle_ms=600, quiet_ms=600)

    def step(s, t, c, e=1):
        return (s, t, c, c, c, c, 1.0, c, 1, e)

    f.land([step("QUIET", 1000, 5.0), step("BUSY", 1000, 1.0)])
    out = f.run(build, silent_ms=600)  # nobody speaks any more: both minutes come out, the last ones of the stream too
    assert sorted((r["symbol"], r["kline_start"], r["close"]) for r in out.collect()) == [("BUSY", 0, 1.0), ("QUIET", 0, 5.0)]
    f.land([step("QUIET", 2000, 9.0), step("QUIET", M + 5000, 7.0), step("BUSY", 4 * M, 2.0)])  # minute 0 is out: the first row is late
    out = f.run(build, silent_ms=600)
    quiet = sorted((r["kline_start"], r["open"], r["high"], r["low"], r["close"]) for r in out.where("symbol = 'QUIET'").collect())
    assert quiet == [(0, 5.0, 5.0, 5.0, 5.0), (M, 5.0, 7.0, 5.0, 7.0)]
    assert out.count() == 4
    state = spark.read.format("statestore").option("path", f.path + "/cp").option("stateVarName", "clock").load()
    assert {r.key[0]: (r.value.late, r.value.timer) for r in state.collect()} == {"QUIET": (1, None), "BUSY": (0, None)}
    pieces = spark.read.format("statestore").option("path", f.path + "/cp").option("stateVarName", "pieces").load()
    assert pieces.count() == 0


def test_a_window_over_several_batches_is_emitted_once(feed):
    f = feed(STEPS)
    for t in range(0, 50_000, 10_000):
        f.land([("A", t, 1.0 + t, 1.0 + t, 1.0 + t, 1.0 + t, 1.0, 1.0, 1, 1)])
    f.land([("A", 3 * M, 2.0, 2.0, 2.0, 2.0, 1.0, 1.0, 1, 1)])
    out = f.run(lambda df: windows.stream_rollup(df, idle_ms=2500, quiet_ms=2500), silent_ms=2500)
    assert sorted((r["kline_start"], r["volume"], r["close"]) for r in out.collect()) == [(0, 5.0, 40_001.0), (3 * M, 1.0, 2.0)]


def test_trade_candles_of_a_silent_stream(spark, feed):
    f, rows = feed(TRADES), trade_rows(11)
    for part in batches(rows, 3):
        f.land(part)
    out = f.run(lambda df: windows.stream_candles(df, "1m", idle_ms=1500, quiet_ms=1500), silent_ms=1500)
    columns = ["symbol", "open_time", "open", "high", "low", "close", "volume", "trade_count"]
    want = trades_to_candles(spark.createDataFrame(rows, TRADES), "1m").select(*columns)
    assert sorted(map(tuple, out.select(*columns).collect())) == sorted(map(tuple, want.collect()))


def test_state_of_a_silent_symbol_expires(spark, feed):
    f = feed("symbol string, event_time bigint, price double")
    build = lambda df: stateful.stream_history(df, window_ms=100, ttl_ms=8000, trim_every=3)

    def held(name):
        return spark.read.format("statestore").option("path", f.path + "/cp").option("stateVarName", name).load()

    f.land([("GONE", 10, 1.0), ("GONE", 20, 3.0)])
    f.run(build, silent_ms=1)
    assert {r.key[0] for r in held("writes").collect()} == {"GONE"}
    f.land([("HERE", 30, 2.0)])
    f.run(build, silent_ms=8500)
    assert held("writes").count() == 0 and held("ticks").count() == 0
    f.land([("GONE", 40, 2.0), ("HERE", 200, 1.0), ("HERE", 210, 5.0), ("HERE", 215, 4.0)])
    out = f.run(build, silent_ms=1)
    got = {(r.symbol, r.event_time): (r.held, r.top) for r in out.collect()}
    assert got[("GONE", 20)] == (2, 3.0) and got[("GONE", 40)] == (1, 2.0)  # its history had gone
    assert got[("HERE", 210)] == (2, 5.0) and got[("HERE", 215)] == (3, 5.0)


def test_fan_out_to_append_sinks_writes_no_batch_twice(spark, feed, tmp_path):
    f = feed("symbol string, open_time bigint, close double")
    f.land([("A", 0, 1.0), ("B", 0, 2.0)])
    f.land([("A", M, 3.0)])
    root = str(tmp_path / "sinks")
    failing = [True]

    def append(name):
        return lambda batch, batch_id: batch.write.mode("append").parquet(f"{root}/{name}")

    def second(batch, batch_id):
        if failing[0]:
            raise RuntimeError("sink is down")
        append("second")(batch, batch_id)

    def run():
        streams.fan_out(f.stream(), {"first": append("first"), "second": second}, root + "/cp", once=True).awaitTermination()

    with pytest.raises(Exception, match="sink is down"):
        run()
    assert spark.read.parquet(root + "/first").count() == 2
    failing[0] = False
    run()
    for name in ("first", "second"):
        assert sorted(r["close"] for r in spark.read.parquet(f"{root}/{name}").collect()) == [1.0, 2.0, 3.0]
    marks = streams.Marks(spark, root + "/cp-sinks")
    assert marks.last("first") == marks.last("second") == 1 and marks._all("first") == [1]


def test_indicators_equal_the_batch_form_across_a_restart(spark, feed):
    rng = random.Random(6)
    ddl = "symbol string, open_time bigint, close double"
    rows = [(s, i * M, round(rng.uniform(1, 9), 2)) for i in range(70) for s in "AB"]
    f = feed(ddl)
    first, second, third = batches(rows, 3)
    f.land(first)
    f.run(stateful.stream_indicators)
    f.land(second)
    f.land(third)
    out = f.run(stateful.stream_indicators)
    want = {(r["symbol"], r["timestamp"]): r for r in indicator_table(spark.createDataFrame(rows, ddl)).collect()}
    assert out.count() == len(want) == 140
    for r in out.collect():
        for c in ("close", "sma20", "sma50", "ema12", "ema26"):
            expected = want[(r["symbol"], r["timestamp"])][c]
            assert (r[c] is None) == (expected is None)
            assert expected is None or abs(r[c] - expected) < 1e-7


def test_replayed_and_late_candles_leave_indicators_alone(spark, feed):
    ddl = "symbol string, open_time bigint, close double"
    rows = [("A", i * M, c) for i, c in enumerate([1.0, 2.0, 3.0, 4.0])]
    f = feed(ddl)
    f.land(rows[:2] + rows[:1])
    f.land([rows[0], rows[1]])
    f.land([rows[1], rows[2]])
    f.land([rows[0], rows[3]])
    out = f.run(stateful.stream_indicators)
    want = {r["timestamp"]: r["ema12"] for r in indicator_table(spark.createDataFrame(rows, ddl)).collect()}
    got = [(r["timestamp"], r["ema12"]) for r in out.collect()]
    assert sorted(t for t, _ in got) == sorted(want)
    assert all(abs(ema - want[t]) < 1e-7 for t, ema in got)


def test_top_price_of_crowded_windows():
    import time

    rng = np.random.default_rng(5)
    values = rng.random(300).round(2)
    first = np.sort(rng.integers(0, 300, 200))
    last = np.minimum(first + rng.integers(1, 90, 200), 300)
    assert stateful._top(values, first, last).tolist() == [values[a:b].max() for a, b in zip(first, last)]
    # Windows of half of all ticks: a look at each tick of each window would be 10^11 steps.
    n = 400_000
    values, last = rng.random(n), np.arange(1, n + 1)
    begun = time.process_time()
    top = stateful._top(values, np.maximum(last - n // 2, 0), last)
    assert time.process_time() - begun < 5
    assert top[n // 2] == values[1 : n // 2 + 1].max() and top[-1] == values[n // 2 :].max()


def test_history_holds_all_ticks_of_its_window(spark, feed):
    rng = random.Random(9)
    rows = [(s, t, float(rng.randrange(50))) for t in sorted(rng.choices(range(4_000), k=300)) for s in "AB"]
    f = feed("symbol string, event_time bigint, price double")
    for part in batches(rows, 3):
        f.land([r for r in part if r[1] != part[-1][1]])  # no time is in two batches
    taken = [r for part in batches(rows, 3) for r in part if r[1] != part[-1][1]]
    out = f.run(lambda df: stateful.stream_history(df, 900, ttl_ms=None, trim_every=40))
    want = []
    for s, t, p in taken:
        held = [q for r, u, q in taken if r == s and t - 900 <= u <= t]
        want.append((s, t, p, len(held), max(held)))
    assert sorted(map(tuple, out.collect())) == sorted(want)


def test_late_rows_are_summed_over_all_progress():
    from types import SimpleNamespace as Entry

    listener = streams.LateRows()
    for dropped in [2] + [1] * 200:
        listener.onQueryProgress(Entry(progress=Entry(id="q", stateOperators=[Entry(numRowsDroppedByWatermark=dropped)])))
    assert listener.dropped == {"q": 202}


@pytest.mark.parametrize("density", [0.02, 0.3, 1.0])
def test_throttle_across_batches(spark, feed, density):
    rng = random.Random(int(density * 100))
    ddl = "symbol string, event_time bigint, price double"
    rows = [(s, t, float(rng.random() < density * 0.5)) for t in sorted(rng.sample(range(0, 200_000), 120)) for s in "AB"]
    f = feed(ddl)
    for part in batches(rows, 7):
        f.land(part)
    out = f.run(lambda s: stateful.stream_throttle(s, 9_000))
    sent, want = {}, []
    for s, t, p in rows:
        if s not in sent or sent[s][0] != p or t - sent[s][1] >= 9_000:
            want.append((s, t, p, "heartbeat" if s in sent and sent[s][0] == p else "change"))
            sent[s] = (p, t)
    assert sorted(map(tuple, out.collect())) == sorted(want)


def test_throttle_equals_the_batch_form(spark, feed):
    rng = random.Random(7)
    ddl = "symbol string, event_time bigint, price double"
    rows = [("A", t, float(rng.random() < 0.05)) for t in sorted(rng.sample(range(0, 100_000), 150))]
    f = feed(ddl)
    for part in batches(rows, 3):
        f.land(part)
    out = f.run(stateful.stream_throttle)
    want = T.throttle(spark.createDataFrame(rows, ddl)).where("reason != 'skipped'").select(*out.columns)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, want.collect()))


def test_throttled_ticks_of_one_time_follow_their_tie(feed):
    f = feed("symbol string, event_time bigint, price double, id bigint")
    f.land([("A", 1, 1.0, 4), ("A", 1, 2.0, 2), ("A", 1, 2.0, 1), ("A", 1, 1.0, 3)])  # in order of id: 2, 2, 1, 1
    f.land([("A", 2, 2.0, 6), ("A", 2, 1.0, 5), ("A", 9_002, 2.0, 7)])
    out = f.run(lambda df: stateful.stream_throttle(df, 9_000, tie=["id"]))
    assert sorted(map(tuple, out.collect())) == [
        ("A", 1, 1.0, "change"), ("A", 1, 2.0, "change"), ("A", 2, 2.0, "change"), ("A", 9_002, 2.0, "heartbeat")
    ]


def test_live_candle_is_sent_on_change(feed):
    f = feed("symbol string, event_time bigint, open_time bigint, open double, high double, low double, close double, volume double")
    same = (0, 1.0, 1.0, 1.0, 1.0, 1.0)
    f.land([("A", 1, *same), ("A", 2, *same), ("A", 3, 0, 1.0, 2.0, 1.0, 2.0, 1.0)])
    f.land([("A", 4, 0, 1.0, 2.0, 1.0, 2.0, 1.0), ("A", 5, *same), ("B", 6, *same)])
    out = f.run(stateful.stream_live_candle)
    assert sorted((r["symbol"], r["event_time"]) for r in out.collect()) == [("A", 1), ("A", 3), ("A", 5), ("B", 6)]


def test_live_candles_of_one_time_follow_their_tie(feed):
    f = feed("symbol string, event_time bigint, open_time bigint, open double, high double, low double, close double, volume double, id bigint")
    one, two = (0, 1.0, 1.0, 1.0, 1.0, 1.0), (0, 2.0, 2.0, 2.0, 2.0, 1.0)
    f.land([("A", 1, *one, 4), ("A", 1, *two, 2), ("A", 1, *two, 1), ("A", 1, *one, 3)])  # in order of id: 2, 2, 1, 1
    f.land([("A", 2, *two, 6), ("A", 2, *one, 5)])
    out = f.run(lambda df: stateful.stream_live_candle(df, tie=["id"]))
    assert out.columns == ["symbol", "event_time", "open_time", "open", "high", "low", "close", "volume"]
    assert sorted((r["event_time"], r["close"]) for r in out.collect()) == [(1, 1.0), (1, 2.0), (2, 2.0)]


def test_fan_out_feeds_every_sink_and_fails_as_one(spark, feed, tmp_path):
    f = feed("symbol string, open_time bigint, close double")
    f.land([("A", 0, 1.0), ("B", 0, 2.0)])
    f.land([("A", M, 3.0)])
    root = str(tmp_path / "sinks")
    failing = [True]

    def series(batch, batch_id):
        upsert_series(batch, root + "/series", ["close"])

    def newest(batch, batch_id):
        if failing[0]:
            raise RuntimeError("sink is down")
        upsert_latest(batch, root + "/latest", ["open_time"])

    def run():
        query = streams.fan_out(f.stream(), {"series": series, "latest": newest}, root + "/cp", once=True)
        query.awaitTermination()

    with pytest.raises(Exception, match="sink is down"):
        run()
    failing[0] = False
    run()  # the failed batch is repeated; the sink that had taken it already ends up the same
    assert spark.read.parquet(root + "/series").count() == 3
    assert sorted((r["symbol"], r["close"]) for r in read_latest(spark, root + "/latest").collect()) == [("A", 3.0), ("B", 2.0)]


def test_expiry(spark):
    df = spark.createDataFrame([(100,), (101,)], "event_time bigint")
    assert [r[0] for r in streams.expire(df, 300, as_of=400).collect()] == [101]
