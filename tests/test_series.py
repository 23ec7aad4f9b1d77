"""Series operators against plain loops, with chunks so small that every series crosses many of them."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from candlelake.operators import gaps, indicators, recurrence, series
from candlelake.operators import ticks as T
from candlelake.operators.candles import rollup
from candlelake.schemas import DAY_MS

M = 60_000


def make_series(seed, sizes=(70, 1, 25), step=M, sparse=True, first=0):
    """(symbol, time, price, volume) rows; gaps of very different lengths."""
    rng = random.Random(seed)
    rows = []
    for s, n in enumerate(sizes):
        t = first + rng.randrange(5) * step
        for _ in range(n):
            rows.append((f"S{s}", t, round(rng.uniform(1, 100), 2), float(rng.randrange(10))))
            t += step * (rng.choice([1, 1, 1, 2, 7, 40]) if sparse else 1)
    rng.shuffle(rows)
    return rows


def by_symbol(rows):
    out = {}
    for r in sorted(rows):
        out.setdefault(r[0], []).append(r)
    return out


def closes(spark, rows):
    return spark.createDataFrame(rows, "symbol string, open_time bigint, close double, volume double").repartition(3)


def got(df, column, key="open_time"):
    return {(r["symbol"], r[key]): r[column] for r in df.collect()}


def close_to(a, b, places=6):
    assert a.keys() == b.keys()
    for k, want in b.items():
        assert (a[k] is None) == (want is None) and (want is None or math.isclose(a[k], want, abs_tol=10**-places)), (k, a[k], want)


@pytest.mark.parametrize("width", [M, 3 * M, 50 * M, 10_000 * M])
@pytest.mark.parametrize("lookback", [1, 2, 5, 19])
def test_lookback_equals_a_whole_window(spark, width, lookback):
    rows = make_series(lookback)
    df = closes(spark, rows)

    def build(r, w):
        return r.withColumn("s", F.sum("close").over(w.rowsBetween(-lookback, 0)))

    whole = Window.partitionBy("symbol").orderBy("open_time").rowsBetween(-lookback, 0)
    want = got(df.withColumn("s", F.sum("close").over(whole)), "s")
    out = series.over_chunks(df, ["symbol"], ["open_time"], width, build, lookback=lookback)
    assert out.columns == [*df.columns, "s"]
    close_to(got(out, "s"), want)


@pytest.mark.parametrize("ahead", [False, True])
def test_previous_and_next(spark, ahead):
    rows = make_series(3)
    out = got(series.with_previous(closes(spark, rows), ["symbol"], ["open_time"], 4 * M, ahead, p="close"), "p")
    want = {}
    for s, rs in by_symbol(rows).items():
        for i, r in enumerate(rs):
            j = i + 1 if ahead else i - 1
            want[(s, r[1])] = rs[j][2] if 0 <= j < len(rs) else None
    assert out == want


def test_index_and_running_max(spark):
    rows = make_series(4)
    df = closes(spark, rows)
    want = {(s, r[1]): i for s, rs in by_symbol(rows).items() for i, r in enumerate(rs)}
    assert got(series.with_index(df, ["symbol"], ["open_time"], 3 * M), "idx") == want
    tops = {
        (s, r[1]): max((x[2] for x in rs[:i]), default=None) for s, rs in by_symbol(rows).items() for i, r in enumerate(rs)
    }
    assert got(series.running_max(df, ["symbol"], ["open_time"], "close", 3 * M, "top"), "top") == tops


@pytest.mark.parametrize("width", [None, M, 20 * M])
@pytest.mark.parametrize("n", [1, 7, 500])
def test_last_n(spark, n, width):
    rows = make_series(5)
    out = got(series.last_n(closes(spark, rows), n, ["symbol"], ["open_time"], width), "close")
    assert out == {(s, r[1]): r[2] for s, rs in by_symbol(rows).items() for r in rs[-n:]}


def test_latest_prefers_the_highest_order(spark):
    df = spark.createDataFrame([("A", 1, "x"), ("A", 3, "y"), ("A", 2, "z"), ("B", 1, None)], "symbol string, t int, v string")
    assert sorted(tuple(r) for r in series.latest(df, ["symbol"], ["t"]).collect()) == [("A", 3, "y"), ("B", 1, None)]


# --- indicators ------------------------------------------------------------------------------------


def loop_ema(xs, n, seed):
    k, out = 2 / (n + 1), []
    for i, x in enumerate(xs):
        if seed == "sma":
            out.append(None if i < n - 1 else sum(xs[:n]) / n if i == n - 1 else x * k + out[-1] * (1 - k))
        else:
            out.append(x if i == 0 else x * k + out[-1] * (1 - k))
    return out


@pytest.fixture
def tiny_chunks(monkeypatch):
    def use(rows):
        monkeypatch.setattr(recurrence, "CANDLE_CHUNK_ROWS", rows)
        monkeypatch.setattr(indicators, "CANDLE_CHUNK_ROWS", rows)

    return use


@pytest.mark.parametrize("chunk", [1, 5, 1024])
@pytest.mark.parametrize("seed", ["first", "sma"])
@pytest.mark.parametrize("n", [1, 2, 12, 26])
def test_ema(spark, tiny_chunks, n, seed, chunk):
    tiny_chunks(chunk)
    rows = make_series(n, sizes=(70, 1, n, n + 1))
    want = {
        (s, r[1]): y
        for s, rs in by_symbol(rows).items()
        for r, y in zip(rs, loop_ema([r[2] for r in rs], n, seed))
        if y is not None
    }
    close_to(got(indicators.ema(closes(spark, rows), "1m", n, seed=seed), f"ema{n}"), want)


@pytest.mark.parametrize("n", [20, 50])
def test_sma(spark, n):
    rows = make_series(6, sizes=(60, n - 1, n, n + 1))
    want = {
        (s, r[1]): sum(x[2] for x in rs[i - n + 1 : i + 1]) / n if i >= n - 1 else None
        for s, rs in by_symbol(rows).items()
        for i, r in enumerate(rs)
    }
    close_to(got(indicators.sma(closes(spark, rows), "1m", n, width_ms=6 * M), f"sma{n}"), want)
    chart = indicators.sma(closes(spark, rows), "1m", n, scale=4, drop_warmup=True, width_ms=6 * M)
    close_to(got(chart, f"sma{n}"), {k: v for k, v in want.items() if v is not None}, 4)


def loop_rsi(xs, n):
    out = [None] * len(xs)
    gain = loss = 0.0
    for i in range(1, len(xs)):
        d = xs[i] - xs[i - 1]
        g, lo = max(d, 0), max(-d, 0)
        if i <= n:
            gain, loss = gain + g / n, loss + lo / n
        else:
            gain, loss = (gain * (n - 1) + g) / n, (loss * (n - 1) + lo) / n
        if i >= n:
            out[i] = 100.0 if loss == 0 else 100 - 100 / (1 + gain / loss)
    return out


@pytest.mark.parametrize("chunk", [4, 1024])
@pytest.mark.parametrize("shape", ["mixed", "constant", "rising"])
def test_rsi(spark, tiny_chunks, shape, chunk):
    tiny_chunks(chunk)
    rows = make_series(8, sizes=(60, 14, 15, 16))
    if shape != "mixed":
        price = {"constant": lambda r: 5.0, "rising": lambda r: float(r[1])}[shape]
        rows = [(r[0], r[1], price(r), r[3]) for r in rows]
    want = {
        (s, r[1]): y for s, rs in by_symbol(rows).items() for r, y in zip(rs, loop_rsi([r[2] for r in rs], 14)) if y is not None
    }
    out = got(indicators.rsi(closes(spark, rows), "1m"), "rsi")
    close_to(out, want, 2)
    if shape != "mixed":
        assert set(out.values()) == {100.0}


@pytest.mark.parametrize("constant", [False, True])
def test_mfi(spark, constant):
    n = 14
    rows = make_series(9, sizes=(50, 14, 15))
    df = closes(spark, rows)
    if constant:
        df = df.withColumn("close", F.lit(3.0))
    df = df.withColumns({"high": F.col("close") + 1, "low": F.col("close") - 1})
    out = got(indicators.mfi(df, "1m", width_ms=5 * M), "mfi")
    want = {}
    for s, rs in by_symbol(rows).items():
        tp = [3.0 if constant else r[2] for r in rs]
        for i in range(n, len(rs)):
            pos = sum(tp[j] * rs[j][3] for j in range(i - n + 1, i + 1) if tp[j] >= tp[j - 1])
            neg = sum(tp[j] * rs[j][3] for j in range(i - n + 1, i + 1) if tp[j] < tp[j - 1])
            want[(s, rs[i][1])] = 100.0 if neg == 0 else 100 - 100 / (1 + pos / neg)
    close_to(out, want, 2)


def test_flags_and_normalization(spark):
    rows = [("S", i * M, v, 0.0) for i, v in enumerate([50.0, 80.0, 90.0, 20.0, 50.0])]
    df = indicators.threshold_flags(closes(spark, rows), "close", 80, 20, interval="1m")
    flags = {r["open_time"] // M: (r["zone"], r["crossed"]) for r in df.collect()}
    assert flags == {
        0: ("neutral", False), 1: ("overbought", True), 2: ("overbought", False), 3: ("oversold", True), 4: ("neutral", True)
    }
    out = indicators.normalize_series(closes(spark, [*rows, ("ONE", 0, 7.0, 0.0)]), "1m").collect()
    at = {(r["symbol"], r["open_time"] // M): (r["x"], r["y"]) for r in out}
    assert at[("S", 0)] == (0.0, round(30 / 70, 6)) and at[("S", 4)] == (1.0, round(30 / 70, 6)) and at[("S", 2)][1] == 1.0
    assert at[("ONE", 0)] == (0.0, 0.0)


def test_registered_indicator(spark):
    indicators.register_indicator("double", lambda df, interval, by=2: df.withColumn("double", F.col("close") * by))
    assert got(indicators.indicator("double", closes(spark, [("S", 0, 2.0, 1.0)]), "1m", by=3), "double") == {("S", 0): 6.0}
    assert got(indicators.indicator("sma", closes(spark, [("S", 0, 2.0, 1.0)]), "1m", 1), "sma1") == {("S", 0): 2.0}
    with pytest.raises(KeyError):
        indicators.indicator("none", None, "1m")


# --- gaps ------------------------------------------------------------------------------------------


def test_gap_fill_and_rollup_agree_with_a_loop(spark):
    rng = random.Random(1)
    rows = []
    for s in ("A", "B"):
        for t in sorted(rng.sample(range(0, 600), 90)):
            o, c = rng.uniform(1, 9), rng.uniform(1, 9)
            rows.append((s, t * 1000, o, max(o, c) + 1, min(o, c) - 1, c, float(rng.randrange(3)), 1.0, 1))
    ddl = (
        "symbol string, open_time bigint, open double, high double, low double, close double, volume double, "
        "quote_volume double, trade_count bigint"
    )
    df = spark.createDataFrame(rows, ddl)
    filled, bars = {}, {}
    for s in ("A", "B"):
        real = {r[1]: r for r in rows if r[0] == s}
        before = None
        for w in sorted({t // M * M for t in real}):
            inside = [t for t in sorted(real) if w <= t < w + M]
            last = before if before is not None else real[inside[0]][5]
            minute = []
            for t in range(w, w + M, 1000):
                if t in real:
                    last = real[t][5]
                    minute.append(real[t][2:7])
                else:
                    minute.append((last, last, last, last, 0.0))
                filled[(s, t)] = minute[-1]
            before = last
            bars[(s, w)] = (
                minute[0][0], max(x[1] for x in minute), min(x[2] for x in minute), minute[-1][3], sum(x[4] for x in minute)
            )
    out = gaps.gap_fill(df)
    assert {(r["symbol"], r["open_time"]): (r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in out.collect()} == filled
    rolled = rollup(df)
    assert {(r["symbol"], r["kline_start"]): (r["open"], r["high"], r["low"], r["close"], r["volume"]) for r in rolled.collect()} == bars
    dense = rollup(out)
    assert got(dense, "high", "kline_start") == got(rolled, "high", "kline_start")
    cover = got(gaps.coverage(df), "real")
    assert cover == got(rolled, "real_steps", "kline_start")


def ticks(spark, times, source=None):
    df = spark.createDataFrame([("S", t, 1.0) for t in times], "symbol string, event_time bigint, price double")
    return df if source is None else df.withColumn("source", F.lit(source))


def test_gap_threshold_is_strict(spark):
    at = DAY_MS
    # Stamped at minute ends: the gap from the first to the second is exactly five minutes.
    exact = gaps.find_gaps(ticks(spark, [0, 5 * M]), at)
    assert exact.count() == 0
    row = gaps.find_gaps(ticks(spark, [0, 6 * M]), at).first()
    assert (row["gap_start"], row["gap_end"], row["elapsed_ms"]) == (2 * M, 7 * M, 6 * M)
    assert gaps.find_gaps(ticks(spark, [0, 5 * M]), at, min_gap_ms=5 * M - 1).count() == 1


def test_gap_lookback_and_backfilled_rows(spark):
    old = ticks(spark, [0, 10 * M])
    assert gaps.find_gaps(old, 8 * DAY_MS).count() == 0
    mixed = ticks(spark, [0, 20 * M], "live").unionByName(ticks(spark, [10 * M], "backfill"))
    assert gaps.find_gaps(mixed, DAY_MS).count() == 1
    assert gaps.find_gaps(mixed, DAY_MS, include_backfill=True).count() == 2


def test_repair_takes_both_ends(spark):
    found = spark.createDataFrame([("S", 10 * M, DAY_MS + 5 * M)], "symbol string, gap_start bigint, gap_end bigint")
    times = [9 * M, 10 * M, 700 * M, DAY_MS + 5 * M, DAY_MS + 6 * M]
    source = spark.createDataFrame([("S", t) for t in times] + [("X", 11 * M)], "symbol string, kline_start bigint")
    out = gaps.repair_gaps(found, source)
    assert sorted(r["kline_start"] for r in out.collect()) == times[1:4]
    row = gaps.gap_summary(found, out).first()
    assert (row["gaps"], row["filled_gaps"], row["repaired_rows"]) == (1, 1, 3)


# --- ticks -----------------------------------------------------------------------------------------


def loop_throttle(rows, heartbeat):
    out, state = {}, {}
    for s, t, i, p in sorted(rows):
        price, sent = state.get(s, (None, None))
        reason = "change" if price is None or p != price else "heartbeat" if t - sent >= heartbeat else "skipped"
        if reason != "skipped":
            state[s] = (p, t)
        out[(s, t, i)] = reason
    return out


@pytest.mark.parametrize("width", [2_000, 7_000, 60_000, 10_000_000])
@pytest.mark.parametrize("prices", [1, 2])
def test_throttle(spark, width, prices):
    rng = random.Random(width + prices)
    rows = [
        (s, t, i, float(rng.randrange(prices)) if rng.random() < 0.1 else 1.0)
        for s in ("A", "B")
        for i, t in enumerate(sorted(rng.choices(range(0, 120_000, 100), k=250)))
    ]
    df = spark.createDataFrame(rows, "symbol string, event_time bigint, id int, price double").repartition(3)
    out = T.throttle(df, 5_000, ["event_time", "id"], width)
    assert {(r["symbol"], r["event_time"], r["id"]): r["reason"] for r in out.collect()} == loop_throttle(rows, 5_000)


def test_heartbeat_counts_from_the_last_sent_tick(spark):
    times = [0, 4_900, 5_000, 9_900, 10_000, 10_001]
    rows = [("S", t, i, 2.0 if t == 10_001 else 1.0) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "symbol string, event_time bigint, id int, price double")
    out = T.throttle(df, order=["event_time", "id"], width_ms=1_000)
    reasons = [r["reason"] for r in sorted(out.collect(), key=lambda r: r["id"])]
    assert reasons == ["change", "skipped", "heartbeat", "skipped", "heartbeat", "change"]
    summary = {r["reason"]: r["ticks"] for r in T.throttle_summary(out).collect()}
    assert summary == {"change": 2, "heartbeat": 2, "skipped": 2}


@pytest.mark.parametrize("tolerance", [None, 40])
@pytest.mark.parametrize("width", [7, 50, 100_000])
def test_asof_quote(spark, width, tolerance):
    rng = random.Random(width)
    trades = [(s, rng.randrange(1000), i) for s in "AB" for i in range(60)]
    quotes = [(s, t, float(i)) for s in "AC" for i, t in enumerate(sorted(rng.sample(range(200, 800), 20)))]
    quotes.append(("A", trades[0][1], 99.0))  # a quote of the same time counts
    left = spark.createDataFrame(trades, "symbol string, event_time bigint, id int")
    right = spark.createDataFrame(quotes, "symbol string, event_time bigint, bid double")
    out = T.asof_quote(left, right, ["bid"], tolerance, width_ms=width)
    assert out.columns == ["symbol", "event_time", "id", "quote_time", "bid"]
    for r in out.collect():
        best = max((q for q in quotes if q[0] == r["symbol"] and q[1] <= r["event_time"]), key=lambda q: q[1], default=None)
        if best and tolerance is not None and best[1] < r["event_time"] - tolerance:
            best = None
        if best and [q[1] for q in quotes if q[0] == "A"].count(best[1]) > 1:
            assert r["quote_time"] == best[1]
        else:
            assert (r["quote_time"], r["bid"]) == ((best[1], best[2]) if best else (None, None))
    assert out.count() == len(trades)


def test_tick_sides(spark):
    df = spark.createDataFrame([("S", 1, 5.0, 1.0), ("S", 2, 4.0, 1.0), ("S", 3, 6.0, 1.0)], "symbol string, event_time bigint, price double, volume double")
    newest = {r["event_time"]: r["side"] for r in T.tick_side(df, width_ms=1).collect()}
    rule = {r["event_time"]: r["side"] for r in T.tick_side(df, "tick_rule", width_ms=1).collect()}
    assert newest == {1: "buy", 2: "sell", 3: "buy"}
    assert rule == {1: "buy", 2: "sell", 3: "buy"}
    down = df.withColumn("price", F.lit(10.0) - F.col("event_time"))
    assert {r["event_time"]: r["side"] for r in T.tick_side(down, width_ms=1).collect()} == {1: "buy", 2: "buy", 3: "buy"}
    assert {r["event_time"]: r["side"] for r in T.tick_side(down, "tick_rule", width_ms=1).collect()} == {1: "buy", 2: "sell", 3: "sell"}


def test_recent_ticks_collapse_equal_pairs(spark):
    df = spark.createDataFrame([("S", 1, 5.0, 1.0), ("S", 9, 5.0, 1.0), ("S", 5, 5.0, 2.0)], "symbol string, event_time bigint, price double, volume double")
    out = T.recent_ticks(df, 10)
    assert sorted((r["event_time"], r["volume"]) for r in out.collect()) == [(5, 2.0), (9, 1.0)]
    assert [r["event_time"] for r in T.recent_ticks(df, 1).collect()] == [9]


def test_tick_members(spark):
    df = spark.createDataFrame([("1.5:2",), ("3",), ("4:x",)], "member string")
    assert [tuple(r) for r in T.parse_tick_member(df).collect()] == [(1.5, 2.0), (3.0, 0.0), (4.0, 0.0)]


def _plain_rsi(closes, n=14):
    changes = [b - a for a, b in zip(closes, closes[1:], strict=False)]
    up = sum(max(c, 0) for c in changes[:n]) / n
    down = sum(max(-c, 0) for c in changes[:n]) / n
    out = [(up, down)]
    for c in changes[n:]:
        up, down = (up * (n - 1) + max(c, 0)) / n, (down * (n - 1) + max(-c, 0)) / n
        out.append((up, down))
    return [100.0 if d == 0 else round(100 - 100 / (1 + u / d), 2) for u, d in out]


def test_rsi_of_a_series_that_falls_quiet(candles):
    from candlelake.operators.indicators import rsi

    moving = [50 + (i * 37 % 11) - (i * 17 % 7) for i in range(60)]
    closes = moving + [moving[-1]] * 20_000
    df = candles([(i * 60_000, c, c, c, c, 1) for i, c in enumerate(closes)])
    out = [r["rsi"] for r in rsi(df, "1m").orderBy("open_time").select("rsi").collect()]
    expected = _plain_rsi(closes[:2000])
    assert len(out) == len(closes) - 14
    assert max(abs(a - b) for a, b in zip(out, expected, strict=False)) <= 0.011
    assert set(out[60:]) == {out[60]}  # the ratio of the averages does not change any more


def test_ema_of_a_series_with_copies(candles):
    from candlelake.operators.indicators import ema

    rows = [(i // 5 * 60_000, 1 + i % 7, 9, 0, 1 + i // 5 % 7, 1) for i in range(6000)]
    out = [r["ema12"] for r in ema(candles(rows), "1m", 12).orderBy("open_time").select("ema12").collect()]
    y, expected = None, []
    for r in rows:
        y = r[4] if y is None else y * 11 / 13 + r[4] * 2 / 13
        expected.append(round(y, 8))
    assert len(out) == len(rows)
    assert max(abs(a - b) for a, b in zip(sorted(out), sorted(expected), strict=True)) < 1e-7


def test_indicator_table_reads_its_candles_once(spark, tmp_path):
    from candlelake.operators.indicators import indicator_table, sma

    rows = [(f"S{i % 5}", i // 5 * 60_000, float(i * 37 % 101)) for i in range(20_000)]
    spark.createDataFrame(rows, "symbol string, open_time bigint, close double").write.parquet(str(tmp_path / "c"))
    candles_ = spark.read.parquet(str(tmp_path / "c"))
    out = indicator_table(candles_)
    got = {(r.symbol, r.timestamp): (r.sma20, r.sma50) for r in out.collect()}
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    shuffles = [line for line in plan.splitlines() if "Exchange" in line and "Reused" not in line and "Broadcast" not in line]
    assert plan.count("FileScan") == 1 and len(shuffles) <= 4
    want = {(r.symbol, r.open_time): (r.sma20, r.sma50) for r in sma(candles_, "1m", 20, 50).collect()}
    assert got.keys() == want.keys()
    for k, v in got.items():
        assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-7) for a, b in zip(v, want[k], strict=True))


def test_means_over_sparse_and_dense_chunks(spark, tiny_chunks):
    """A tail that spans many chunks of a row or two, and chunks with several parts."""
    tiny_chunks(3)
    rng = random.Random(4)
    times = sorted(rng.sample(range(0, 4000), 300)) + [4000] * 40 + list(range(4001, 4100))
    rows = [("A", t * 60_000, i, round(rng.uniform(1, 9), 2)) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "symbol string, open_time bigint, copy int, close double")
    out = recurrence.smooth(df, ["symbol"], ["open_time", "copy"], "close", [recurrence.Smooth("y", 0.9)], 60_000, (20, 50))
    got = {r.idx: (r.mean20, r.mean50, r.y) for r in out.collect()}
    closes_, y = [r[3] for r in rows], None
    for i, x in enumerate(closes_):
        y = x if y is None else 0.9 * y + 0.1 * x
        for n, value in ((20, got[i][0]), (50, got[i][1])):
            assert (value is None) == (i < n - 1) and (value is None or abs(value - sum(closes_[i - n + 1 : i + 1]) / n) < 1e-9)
        assert abs(got[i][2] - y) < 1e-9
