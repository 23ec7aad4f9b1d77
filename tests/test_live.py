"""Latest state, live candles, order books and symbol lists."""

import pytest
from pyspark.sql import functions as F

from candlelake.operators import book, live, symbols

M = 60_000
OHLCV = ["open_time", "open", "high", "low", "close", "volume"]


def ticker(spark, *rows):
    return spark.createDataFrame(rows, "symbol string, price double, event_time bigint")


def one(df, *columns):
    rows = df.collect()
    assert len(rows) == 1, rows
    return tuple(rows[0][c] for c in columns or OHLCV)


def test_latest_ticker(spark):
    df = spark.createDataFrame(
        [("A", 1, 1.0), ("A", 3, 3.0), ("A", 2, 2.0), ("B", 1, 9.0), ("", 5, 0.0), (None, 5, 0.0)], "symbol string, event_time bigint, close double"
    )
    assert sorted(tuple(r) for r in live.latest_ticker(df).collect()) == [("A", 3, 3.0), ("B", 1, 9.0)]
    assert [r["symbol"] for r in live.latest_ticker(df, ["B"]).collect()] == ["B"]
    wanted = spark.createDataFrame([("A",)], "symbol string")
    assert [r["close"] for r in live.latest_ticker(df, wanted).collect()] == [3.0]


def test_latest_indicators_shows_present_fields(spark):
    df = spark.createDataFrame(
        [("A", 1, 1.0, None, 2.0, 3.0), ("A", 2, 5.0, None, 6.0, 7.0)],
        "symbol string, timestamp bigint, sma20 double, sma50 double, ema12 double, ema26 double",
    )
    row = live.latest_indicators(df, as_map=True).first()
    assert row["indicators"] == {"sma20": 5.0, "ema12": 6.0, "ema26": 7.0} and row["timestamp"] == 2


@pytest.mark.parametrize("at, fresh", [(4 * M, False), (4 * M + 500, True)])
def test_ticker_freshness(spark, candles, at, fresh):
    bars, sub = candles([(0, 10, 12, 9, 11, 5)]), candles([(4 * M, 1, 1, 1, 1, 1)])
    out = live.enrich_live(bars, sub, ticker(spark, ("BTCUSDT", 20.0, at)), "5m", as_of=5 * M - 1)
    assert one(out) == ((0, 10, 20, 9, 20, 5) if fresh else (0, 10, 12, 9, 11, 5))


def test_low_price_moves_the_low(spark, candles):
    bars, none = candles([(0, 10, 12, 9, 11, 5)]), candles([(0, 1, 1, 1, 1, 1)]).where("false")
    assert one(live.enrich_live(bars, none, ticker(spark, ("BTCUSDT", 2.0, 1)), "5m", 2)) == (0, 10, 12, 2, 2, 5)


def test_ticker_for_an_unknown_symbol_opens_its_series(spark, candles):
    bars = candles([(0, 10, 12, 9, 11, 5)])
    out = live.enrich_live(bars, bars, ticker(spark, ("NEW", 3.0, M), ("BTCUSDT", 0.0, 9 * M)), "5m", 2 * M)
    assert sorted((r["symbol"], r["open_time"], r["close"]) for r in out.collect()) == [("BTCUSDT", 0, 11.0), ("NEW", 0, 3.0)]


class TestLiveCandle:
    as_of = 7 * M

    def show(self, spark, candles, interval="5m", quotes=(), minutes=(), last=()):
        none = candles([(0, 1, 1, 1, 1, 1)]).where("false")
        sub = candles(list(minutes)) if minutes else none
        stored = candles(list(last)) if last else none
        quotes = ticker(spark, *quotes) if quotes else ticker(spark, ("X", 1.0, 1)).where("false")
        return live.live_candle(sub, sub, quotes, stored, interval, self.as_of)

    minutes = ((5 * M, 1, 5, 1, 2, 10), (6 * M, 2, 6, 2, 3, 20))

    def test_bar_only(self, spark, candles):
        assert one(self.show(spark, candles, minutes=self.minutes)) == (5 * M, 1, 6, 1, 3, 30)

    def test_moved_by_a_newer_ticker(self, spark, candles):
        out = self.show(spark, candles, minutes=self.minutes, quotes=[("BTCUSDT", 9.0, 6 * M + 1)])
        assert one(out) == (5 * M, 1, 9, 1, 9, 30)

    def test_not_by_a_stale_one_nor_at_1m(self, spark, candles):
        out = self.show(spark, candles, minutes=self.minutes, quotes=[("BTCUSDT", 9.0, 6 * M)])
        assert one(out) == (5 * M, 1, 6, 1, 3, 30)
        out = self.show(spark, candles, "1m", minutes=self.minutes, quotes=[("BTCUSDT", 9.0, 6 * M + 1)])
        assert one(out) == (6 * M, 2, 6, 2, 3, 20)

    def test_flat_candle_in_a_new_window(self, spark, candles):
        out = self.show(spark, candles, minutes=self.minutes, quotes=[("BTCUSDT", 9.0, 11 * M)])
        assert one(out) == (10 * M, 9, 9, 9, 9, 0)
        assert one(self.show(spark, candles, quotes=[("BTCUSDT", 9.0, 11 * M)])) == (10 * M, 9, 9, 9, 9, 0)

    def test_older_ticker_window_is_ignored(self, spark, candles):
        out = self.show(spark, candles, minutes=self.minutes, quotes=[("BTCUSDT", 9.0, 1)])
        assert one(out) == (5 * M, 1, 6, 1, 3, 30)

    def test_last_resort(self, spark, candles):
        assert one(self.show(spark, candles, last=[(M, 1, 2, 0, 1, 5), (6 * M, 4, 5, 3, 4, 6)])) == (5 * M, 4, 5, 3, 4, 6)

    def test_one_second(self, spark, candles):
        assert one(self.show(spark, candles, "1s", minutes=self.minutes)) == (6 * M, 2, 6, 2, 3, 20)


def test_incremental(spark):
    new = spark.createDataFrame([("A", t) for t in (0, M, 2 * M)] + [("B", 5), ("B", 10)], "symbol string, kline_start bigint")
    stored = spark.createDataFrame([("A", 0)], "symbol string, last_time bigint")
    out = live.incremental(new, stored, start=6)
    assert sorted(tuple(r) for r in out.collect()) == [("A", M), ("A", 2 * M), ("B", 10)]


def books(spark, *rows):
    side = "array<struct<price:double,qty:double>>"
    return spark.createDataFrame(rows, f"symbol string, event_time bigint, bids {side}, asks {side}")


def test_book_metrics(spark):
    df = books(spark, ("A", 1, [(10.0, 1.0), (9.0, 2.0)], [(10.3, 4.0)]), ("B", 1, [], [(5.0, 1.0)]), ("C", 1, [], []))
    got = {r["symbol"]: (r["bid_depth"], r["ask_depth"], r["best_bid"], r["best_ask"], r["spread"]) for r in book.book_metrics(df).collect()}
    assert got == {"A": (2, 1, 10.0, 10.3, 0.3), "B": (0, 1, 0.0, 5.0, 0.0), "C": (0, 0, 0.0, 0.0, 0.0)}


def test_book_ladder(spark):
    df = books(spark, ("A", 1, [(10.0, 1.00006), (9.0, 3.0)], [(12.5, 4.0)]), ("B", 1, [(1.0, 1.0)], []))
    rows = sorted(tuple(r) for r in book.book_ladder(df, "symbol").collect())
    assert rows == [
        ("A", "ask", 0, 12.5, 4.0, 4.0, 100.0, 20.0),
        ("A", "bid", 0, 10.0, 1.0001, 1.0001, 25.0019, 20.0),
        ("A", "bid", 1, 9.0, 3.0, 4.0001, 100.0, 20.0),
        ("B", "bid", 0, 1.0, 1.0, 1.0, 100.0, 0.0),
    ]


def test_book_or_ticker(spark):
    full = book.book_metrics(books(spark, ("A", 1, [(10.0, 1.0)], [(11.0, 4.0)])))
    quotes = spark.createDataFrame(
        [("A", 1.0, 2.0, 9), ("B", 1.0, 2.5, 9), ("C", 0.0, 2.0, 9)], "symbol string, bid double, ask double, event_time bigint"
    )
    rows = {r["symbol"]: r for r in book.book_or_ticker(full, quotes).collect()}
    assert sorted(rows) == ["A", "B"]
    assert rows["A"]["best_bid"] == 10.0 and rows["A"]["event_time"] == 1
    assert rows["B"]["spread"] == 1.5 and [tuple(x) for x in rows["B"]["bids"]] == [(1.0, 0.0)]


def test_watchlist(spark):
    items = spark.createDataFrame([(s, 1.0, 0.1, "gray") for s in "ABCD"], "symbol string, price double, change double, color string")
    quotes = spark.createDataFrame([("A", 2.0, 0.5), ("B", 3.0, -0.5), ("C", 0.0, None)], "symbol string, price double, change24h double")
    rows = {r["symbol"]: (r["price"], r["change"], r["color"]) for r in symbols.join_watchlist(items, quotes).collect()}
    assert rows == {"A": (2.0, 0.5, "green"), "B": (3.0, -0.5, "red"), "C": (0.0, 0.1, "gray"), "D": (1.0, 0.1, "gray")}


def test_meta(spark):
    old = spark.createDataFrame([("BTC", "Old", 1), ("ETH", "Ether", 2)], "coin string, name string, rank int")
    new = spark.createDataFrame([("BTC", "Bitcoin", None), ("SOL", "Solana", 3)], "coin string, name string, rank int")
    merged = symbols.merge_meta(old, new)
    assert sorted((r["coin"], r["name"], r["rank"]) for r in merged.collect()) == [("BTC", "Bitcoin", None), ("ETH", "Ether", 2), ("SOL", "Solana", 3)]
    df = spark.createDataFrame([("BTCUSDT",), ("XUSDT",)], "symbol string")
    assert {r["symbol"]: r["name"] for r in symbols.attach_meta(df, merged).collect()} == {"BTCUSDT": "Bitcoin", "XUSDT": None}


def test_partition_skew_counts_rows_and_keys(spark):
    df = spark.createDataFrame([("A",)] * 5 + [("B",)], "symbol string")
    rows = symbols.partition_skew(df, partitions=1).collect()
    assert [(r["partition"], r["rows"], r["keys"]) for r in rows] == [(0, 6, 2)]
    assert symbols.partition_skew(df).agg(F.sum("rows")).first()[0] == 6


def test_ladder_of_a_deep_book(spark):
    from candlelake.operators.book import book_ladder

    sides = [[(100.0 - i, float(i % 7 + 1)) for i in range(n)] for n in (0, 1, 32, 33, 500)]
    ddl = "id bigint, bids array<struct<price:double,qty:double>>, asks array<struct<price:double,qty:double>>"
    df = spark.createDataFrame([(i, side, sides[-1 - i]) for i, side in enumerate(sides)], ddl)
    got = {(r.id, r.side, r.level): (r.price, r.total, r.bar_pct) for r in book_ladder(df, "id").collect()}
    expected = {}
    for i, bids in enumerate(sides):
        for name, side in (("bid", bids), ("ask", sides[-1 - i])):
            total = 0.0
            for n, (price, qty) in enumerate(side):
                total += qty
                expected[i, name, n] = (price, total, round(total / sum(q for _, q in side) * 100, 4))
    assert got == expected


def test_ladder_adds_levels_in_their_order(spark):
    # Added to 1e16 one at a time, ones are lost; added to each other first, they are not.
    side = [(1.0, 1e16)] + [(1.0, 1.0)] * 99
    rows = book.book_ladder(books(spark, ("A", 1, side, [])), "symbol").collect()
    assert [r["total"] for r in sorted(rows, key=lambda r: r["level"])] == [1e16] * 100


def test_ladder_takes_each_total_once(spark):
    """A side is walked once, and neither again for the filter on its size nor for the side's total."""
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").selectExpr(
        "l_orderkey AS id", *[f"array(struct(l_extendedprice AS price, l_quantity AS qty)) AS {c}" for c in ("bids", "asks")]
    )
    plan = book.book_ladder(df, "id")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    walks = [line for line in plan if "aggregate(" in line]
    assert len(walks) == 1 and "Project" in walks[0] and "transform(bids" not in walks[0]


def test_ladder_of_a_book_with_nulls(spark):
    df = books(spark, ("A", 1, [(1.0, 1.0), (2.0, None), (3.0, 1.0)], None), ("B", 1, [None, (2.0, 1.0)], [(4.0, 0.0)]))
    rows = sorted((tuple(r) for r in book.book_ladder(df, "symbol").collect()), key=lambda r: r[:3])
    assert rows == [
        ("A", "bid", 0, 1.0, 1.0, 1.0, None, 0.0),
        ("A", "bid", 1, 2.0, None, None, None, 0.0),
        ("A", "bid", 2, 3.0, 1.0, None, None, 0.0),
        ("B", "ask", 0, 4.0, 0.0, 0.0, 0.0, 0.0),
        ("B", "bid", 0, None, None, None, None, 0.0),
        ("B", "bid", 1, 2.0, 1.0, None, None, 0.0),
    ]


def test_live_ticker_on_candles_stored_by_day(spark, tmp_path):
    from candlelake.sources.tables import with_day

    hour = 3_600_000
    rows = [(s, h * hour, 1.0, 2.0, 0.5, 1.5, 1.0) for s in "AB" for h in range(240 if s == "A" else 30)]
    plain = spark.createDataFrame(rows, "symbol string, open_time bigint, open double, high double, low double, close double, volume double")
    with_day(plain, "open_time").write.partitionBy("day").parquet(str(tmp_path / "c"))
    stored = spark.read.parquet(str(tmp_path / "c"))
    quotes = spark.createDataFrame([("A", 9.0, 239 * hour + 5), ("B", 8.0, 40 * hour), ("C", 7.0, hour)], "symbol string, price double, event_time bigint")
    columns = plain.columns
    by_day = live.enrich_live(stored, stored, quotes, "1h", 239 * hour + 9).select(*columns)
    assert sorted(map(tuple, by_day.collect())) == sorted(map(tuple, live.enrich_live(plain, plain, quotes, "1h", 239 * hour + 9).select(*columns).collect()))


def test_newest_books_are_chosen_before_their_levels_are_built(spark):
    from suite.series_queries import book_or_ticker

    plan = book_or_ticker(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    chosen = next(i for i, line in enumerate(plan) if "Aggregate [" in line and "l_orderkey" in line)
    assert not [line for line in plan[chosen:] if "lambda" in line]
