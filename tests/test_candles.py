"""Candle building and merging on hand-made rows."""

import pytest
from pyspark.sql import functions as F

from candlelake.operators import candles as C
from candlelake.operators import merge
from candlelake.plans import queries as P

M = 60_000


def values(df, *columns):
    columns = columns or ("open_time", "open", "high", "low", "close", "volume")
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


THREE = [(0, 10, 15, 8, 12, 100), (M, 12, 20, 9, 18, 200), (2 * M, 18, 22, 16, 19, 150)]


@pytest.mark.parametrize("order", [(0, 1, 2), (2, 0, 1)])
def test_ohlcv_rule(candles, order):
    out = C.resample(candles([THREE[i] for i in order]), "5m")
    assert values(out) == [(0, 10, 22, 8, 19, 450)]


def test_duplicate_times_are_reduced_first(candles):
    rows = [(0, 10, 15, 8, 12, 100), (0, 10, 16, 7, 13, 150), (M, 13, 20, 9, 18, 200)]
    assert values(C.resample(candles(rows), "5m")) == [(0, 10, 20, 7, 18, 350)]


def test_closed_copy_wins_in_resample(candles):
    rows = [(0, 10, 30, 1, 12, 100, False), (0, 10, 15, 7, 12, 100, True), (M, 12, 20, 9, 18, 100, True)]
    assert values(C.resample(candles(rows), "5m"), "low", "high") == [(7, 20)]


def test_quarter_hour_and_hour(candles):
    rows = [(i * M, 100 + i, 110 + i, 90 + i, 105 + i, 10 + i) for i in range(15)]
    assert values(C.resample(candles(rows), "15m")) == [(0, 100, 124, 90, 119, 255)]
    rows = [(i * M, 1, 1, 1, 1, 1) for i in range(60)]
    assert values(C.resample(candles(rows), "1h"), "volume") == [(60,)]


def test_two_buckets(candles):
    rows = [(i * M, 100 + 10 * i, 200, 50, 105 + 10 * i, 1) for i in range(6)]
    assert values(C.resample(candles(rows), "5m"), "open", "close") == [(100, 145), (150, 155)]


def test_buckets_are_aligned(candles):
    rows = [(1_700_000_000_000 + i * M, 1, 1, 1, 1, 1) for i in range(10)]
    assert all(t % 300_000 == 0 for (t,) in values(C.resample(candles(rows), "5m"), "open_time"))


def test_week_starts_on_thursday(candles):
    assert values(C.resample(candles([(1_704_067_200_000, 1, 1, 1, 1, 1)]), "1w"), "open_time") == [(1_703_721_600_000,)]


def test_finer_target_is_refused(candles):
    with pytest.raises(ValueError):
        C.resample(candles(THREE), "1s", base="1m")
    with pytest.raises(ValueError):
        C.resample(candles(THREE), "2m")


def test_empty_input(candles):
    assert C.resample(candles(THREE).where("false"), "5m").count() == 0


def test_trades_to_candles_breaks_ties_by_id(spark):
    rows = [("S", 5, 3.0, 1.0, 2), ("S", 5, 4.0, 1.0, 1), ("S", 9, 8.0, 1.0, 7), ("S", 9, 2.0, 1.0, 6)]
    df = spark.createDataFrame(rows, "symbol string, trade_time bigint, price double, quantity double, agg_trade_id bigint")
    row = C.trades_to_candles(df, "1s").first()
    assert (row["open"], row["high"], row["low"], row["close"], row["volume"], row["quote_volume"], row["trade_count"]) == (4, 8, 2, 8, 4, 17, 4)


def test_more_volume_wins(candles):
    old, new = candles([(0, 1, 1, 1, 1, 10)]), candles([(0, 2, 2, 2, 2, 11)])
    assert values(merge.merge_candles(old, new), "open", "volume") == [(2, 11)]
    assert values(merge.merge_candles(new, old), "open", "volume") == [(2, 11)]


@pytest.mark.parametrize("open_volume, closed_volume", [(10, 10), (50, 8)])
def test_closed_wins_both_ways(candles, open_volume, closed_volume):
    open_, closed = candles([(0, 1, 1, 1, 1, open_volume, False)]), candles([(0, 2, 2, 2, 2, closed_volume, True)])
    for pair in ((open_, closed), (closed, open_)):
        assert values(merge.merge_candles(*pair), "open", "volume") == [(2, closed_volume)]


def test_equal_quality_takes_the_incoming_one(candles):
    old, new = candles([(0, 1, 1, 1, 1, 10)]), candles([(0, 2, 2, 2, 2, 10)])
    assert values(merge.merge_candles(old, new), "open") == [(2,)]


def test_tiers_need_not_share_the_closed_flag(candles):
    with_flag, without = candles([(0, 1, 1, 1, 1, 5, True)]), candles([(0, 2, 2, 2, 2, 9)])
    assert values(merge.merge_candles(with_flag, without), "open") == [(1,)]


def test_replay_changes_nothing(candles):
    batch = candles(THREE)
    once = merge.merge_candles(batch, batch)
    twice = merge.merge_candles(once, batch)
    assert values(once) == values(twice) == [tuple(float(x) if i else x for i, x in enumerate(r)) for r in THREE]


def test_best_by_volume_keeps_the_first_of_equals(candles):
    df = candles([(0, 1, 1, 1, 1, 5)]).withColumn("arrival", F.lit(0)).unionByName(
        candles([(0, 2, 2, 2, 2, 5)]).withColumn("arrival", F.lit(1))
    )
    assert values(merge.best_by_volume(df, "arrival"), "open") == [(1,)]


def test_an_hour_with_both_levels_is_not_counted_twice(candles):
    fine = candles([(0, 1, 1, 1, 1, 5), (M, 1, 1, 1, 1, 6)])
    hourly = candles([(0, 1, 1, 1, 1, 11), (60 * M, 2, 2, 2, 2, 7)])
    out = C.resample(merge.fill_from_hourly(fine, hourly), "4h")
    assert values(out, "volume") == [(18,)]


def kline_1s(spark, rows):
    ddl = (
        "symbol string, open_time bigint, open double, high double, low double, close double, volume double, "
        "quote_volume double, trade_count bigint, event_time bigint"
    )
    return spark.createDataFrame([("S", t, o, h, lo, c, v, v * c, 1, e) for t, o, h, lo, c, v, e in rows], ddl)


def rolled(df):
    out = C.rollup(df, "1s", "1m", arrival=["event_time"])
    return values(out, "kline_start", "open", "high", "low", "close", "volume", "real_steps")


def test_rollup_opens_at_the_previous_close(spark):
    rows = [(1000, 5.0, 6.0, 4.0, 5.5, 1.0, 1), (M + 2000, 9.0, 9.5, 8.5, 9.0, 2.0, 2)]
    # Second 0 is missing in both minutes: the first has no earlier close, the second has 5.5.
    assert rolled(kline_1s(spark, rows)) == [(0, 5.5, 6, 4, 5.5, 1, 1), (M, 5.5, 9.5, 5.5, 9, 2, 1)]


def test_rollup_keeps_a_real_open(spark):
    rows = [(0, 5.0, 6.0, 4.0, 5.5, 1.0, 1), (M, 9.0, 9.5, 8.5, 9.0, 2.0, 2)]
    assert rolled(kline_1s(spark, rows)) == [(0, 5, 6, 4, 5.5, 1, 1), (M, 9, 9.5, 8.5, 9, 2, 1)]


def test_rollup_takes_the_last_copy_of_a_second(spark):
    rows = [(0, 5.0, 6.0, 4.0, 5.5, 1.0, 2), (0, 7.0, 7.0, 7.0, 7.0, 3.0, 1)]
    assert rolled(kline_1s(spark, rows)) == [(0, 5, 6, 4, 5.5, 1, 1)]


def test_current_bar_and_overview(candles):
    df = candles([*THREE, (5 * M, 30, 40, 20, 35, 7)])
    assert values(C.current_bar(df, "5m"), "open_time", "open", "close", "source_time") == [(5 * M, 30, 35, 5 * M)]
    row = C.overview(df).first()
    assert (row["high"], row["low"], row["volume"], row["change"], row["change_pct"], row["is_up"]) == (40, 8, 457, 25, 250, True)


def test_last_per_window_is_stamped_with_the_end(spark):
    df = spark.createDataFrame([("S", 10, 1.0), ("S", 20, 2.0), ("S", 3 * M, 3.0)], "symbol string, event_time bigint, price double")
    assert values(C.last_per_window(df), "event_time", "price") == [(M, 2.0), (4 * M, 3.0)]


def test_diff_and_prepend(candles):
    old = candles(THREE)
    new = candles([(0, 10, 15, 8, 99, 100), THREE[1], (2 * M, 18, 22, 16, 50, 150), (3 * M, 1, 1, 1, 1, 1)])
    assert values(merge.diff_candles(old, new), "open_time", "change") == [(0, "updated"), (3 * M, "added")]
    assert values(merge.diff_candles(old, new, skip_last=False), "open_time") == [(0,), (2 * M,), (3 * M,)]
    older = candles([(-M, 0, 0, 0, 0, 0), (0, 0, 0, 0, 0, 0)])
    assert values(merge.prepend_older(old, older), "open_time") == [(-M,), (0,), (M,), (2 * M,)]


@pytest.mark.parametrize("interval, times", [("1s", [0, M, 2 * M, 5 * M]), ("1m", [0, M, 2 * M, 5 * M])])
def test_apply_update_ignores_older_candles(candles, interval, times):
    series = candles(THREE)
    rows = [(2 * M, 7, 7, 7, 7, 7), (5 * M, 8, 8, 8, 8, 8), (4 * M, 9, 9, 9, 9, 9), (5 * M, 6, 6, 6, 6, 6)]
    update = None
    for i, r in enumerate(rows):
        one = candles([r]).withColumn("seq", F.lit(i).cast("bigint"))
        update = one if update is None else update.unionByName(one)
    out = dict(values(merge.apply_update(series, update, interval, width_ms=2), "open_time", "close"))
    assert sorted(out) == times
    # At 1s a drawn candle stays; otherwise the last update of a time replaces it.
    assert (out[2 * M], out[5 * M]) == ((19, 8) if interval == "1s" else (7, 6))


def test_apply_update_caps_the_series(candles):
    series = candles([(i * 1000, 1, 1, 1, 1, 1) for i in range(130)])
    update = candles([(130_000, 2, 2, 2, 2, 2)]).withColumn("seq", F.lit(1).cast("bigint"))
    out = values(merge.apply_update(series, update, "1s", cap=120), "open_time")
    assert len(out) == 120 and out[-1] == (130_000,)


# --- queries over tiers ----------------------------------------------------------------------------


def test_tiered_read_uses_one_branch_where_it_can(candles):
    warm, cold = candles([(10, 1, 1, 1, 1, 1)]), candles([(5, 2, 2, 2, 2, 2), (10, 3, 3, 3, 3, 3)])
    assert values(P.tiered_read(warm, cold, 0, 20, 8), "open_time", "open") == [(5, 2), (10, 1)]
    assert values(P.tiered_read(warm, cold, 8, 20, 8), "open_time", "open") == [(10, 1)]
    assert values(P.tiered_read(warm, cold, 0, 6, 8), "open_time", "open") == [(5, 2)]


def test_historical_checks_and_falls_back(candles):
    hour = 60 * M
    none = candles(THREE).where("false")
    hourly = candles([(i * hour, 1, 2, 0, 1, 1) for i in range(8)])
    out = P.historical(none, none, hourly, "4h", 0, 8 * hour, 0)
    assert values(out, "open_time", "volume") == [(0, 4), (4 * hour, 4)]
    assert P.historical(none, none, hourly, "15m", 0, 8 * hour, 0).count() == 0
    assert P.historical(none, none, hourly, "1h", 0, 400 * 24 * hour, 0).count() == 8
    with pytest.raises(ValueError):
        P.historical(none, none, hourly, "1h", hour, hour, 0)
    with pytest.raises(ValueError):
        P.historical(none, none, hourly, "1s", 0, hour, 0)


def klines(candles, spark, ticker, interval="5m", as_of=6 * M, end=None, limit=10):
    rows = candles([*THREE, (5 * M, 30, 40, 20, 35, 7)])
    quotes = spark.createDataFrame(ticker, "symbol string, price double, event_time bigint")
    return P.klines(rows, rows, rows, rows, quotes, interval, limit, as_of, end)


def test_klines_apply_a_fresh_ticker(candles, spark):
    out = klines(candles, spark, [("BTCUSDT", 50.0, 5 * M + 30_000)])
    assert values(out)[-1] == (5 * M, 30, 50, 20, 50, 7)


def test_klines_ignore_a_stale_ticker(candles, spark):
    out = klines(candles, spark, [("BTCUSDT", 50.0, 5 * M)])
    assert values(out)[-1] == (5 * M, 30, 40, 20, 35, 7)
    out = klines(candles, spark, [("BTCUSDT", 50.0, 5 * M + 30_000)], as_of=10 * M)  # the window is over
    assert values(out)[-1] == (5 * M, 30, 40, 20, 35, 7)


def test_klines_open_a_new_window(candles, spark):
    out = klines(candles, spark, [("BTCUSDT", 50.0, 10 * M + 1)], as_of=11 * M)
    assert values(out)[-1] == (10 * M, 50, 50, 50, 50, 0)


def test_klines_before_an_end(candles, spark):
    out = klines(candles, spark, [("BTCUSDT", 50.0, 10 * M + 1)], end=5 * M, as_of=11 * M)
    assert values(out) == [(0, 10, 22, 8, 19, 450)]
    out = klines(candles, spark, [], interval="1m", limit=2)
    assert values(out, "open_time") == [(2 * M,), (5 * M,)]


def test_live_klines_reach_into_the_cold_tier(candles, spark):
    day = 24 * 60 * M
    old = candles([(i * day, 1, 2, 0, 1, 1) for i in range(200)])
    quotes = spark.createDataFrame([("BTCUSDT", 1.0, 0)], "symbol string, price double, event_time bigint")
    out = P.klines(old, old.where(f"open_time >= {110 * day}"), old, old.where("false"), quotes, "1w", 25, 199 * day + M)
    assert out.where("open_time >= 0").count() == 25
