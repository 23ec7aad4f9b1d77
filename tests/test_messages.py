import json

import pytest
from pyspark.sql import functions as F

from candlelake.operators import book
from candlelake.sources import messages as M
from candlelake.sources import topics


def raw(spark, *items, ddl="raw string"):
    return spark.createDataFrame([(i if isinstance(i, str) else json.dumps(i),) for i in items], ddl)


TICKER = {
    "E": 1000, "s": "BTCUSDT", "c": "50000.5", "b": "50000", "a": "50001", "o": "49000", "h": "51000", "l": "48000",
    "v": "123.4", "q": "6170000", "p": "1000.5", "P": "2.04", "n": 999,
}


def test_ticker(spark):
    row = M.parse_ticker(raw(spark, TICKER)).first().asDict()
    assert row == {
        "event_time": 1000, "symbol": "BTCUSDT", "close": 50000.5, "bid": 50000.0, "ask": 50001.0, "h24_open": 49000.0,
        "h24_high": 51000.0, "h24_low": 48000.0, "h24_volume": 123.4, "h24_quote_volume": 6170000.0,
        "h24_price_change": 1000.5, "h24_price_change_pct": 2.04, "h24_trade_count": 999,
    }


def test_ticker_defaults_and_required_fields(spark):
    few = raw(spark, {"E": 5, "s": "ABC"})
    row = M.parse_ticker(few).first().asDict()
    assert set(row.values()) == {5, "ABC", 0}
    assert M.parse_ticker(few, strict=True).first()["close"] is None
    assert M.parse_ticker(raw(spark, {"s": "ABC"}, {"E": 5}, "no json", "[1]")).count() == 0


def test_batch(spark):
    message = [TICKER, {**TICKER, "s": "ETHBTC"}, {**TICKER, "s": "ETHUSDT", "c": 7}]
    out = M.explode_batch(raw(spark, message, {"not": "a list"}, "broken"))
    assert sorted((r["symbol"], r["close"]) for r in out.collect()) == [("BTCUSDT", 50000.5), ("ETHUSDT", 7.0)]
    assert M.explode_batch(raw(spark, message), quote=None).count() == 3


def test_trade(spark):
    out = M.parse_trade(raw(spark, {"e": "aggTrade", "E": 1, "s": "X", "a": 7, "p": "1.5", "q": "2", "T": 3, "m": True}))
    assert tuple(out.first()) == (1, "X", 7, 1.5, 2.0, 3, True)
    assert M.parse_trade(raw(spark, {"E": 1, "s": "X", "a": 7, "p": "abc", "q": "2", "T": 3, "m": True})).count() == 0


def test_kline(spark):
    k = {"t": 0, "T": 59999, "i": "1m", "o": "1", "h": "2", "l": "0.5", "c": "1.5", "v": "10", "q": "15", "n": 3, "x": False}
    out = M.parse_kline(raw(spark, {"E": 9, "s": "X", "k": k}, {"E": 9, "s": "X"}))
    assert [tuple(r) for r in out.collect()] == [(9, "X", 0, 59999, "1m", 1.0, 2.0, 0.5, 1.5, 10.0, 15.0, 3, False)]


@pytest.mark.parametrize(
    "message",
    [
        {"E": 9, "s": "btcusdt", "lastUpdateId": 4, "bids": [["10", "1"], ["9", "2"]], "asks": [["11", "3"]]},
        {"E": 9, "s": "btcusdt", "u": 4, "b": [["10", "1"], ["9", "2"]], "a": [["11", "3"]]},
        {"E": 9, "s": "btcusdt", "lastUpdateId": 4, "u": 5, "bids": [], "b": [[10, 1], [9, 2]], "a": [[11, 3]]},
    ],
)
def test_depth_spellings(spark, message):
    out = M.parse_depth(raw(spark, message))
    row = out.first()
    assert (row["event_time"], row["symbol"], row["last_update_id"]) == (9, "BTCUSDT", 4)
    assert [tuple(x) for x in row["bids"]] == [(10.0, 1.0), (9.0, 2.0)]
    assert M.depth_record(out).first()["asks"] == "[[11.0,3.0]]"
    again = M.depth_record(out).select(book.parse_levels("bids").alias("bids")).first()
    assert [tuple(x) for x in again["bids"]] == [(10.0, 1.0), (9.0, 2.0)]


def test_depth_defaults(spark):
    row = M.parse_depth(raw(spark, {}), as_of=77).first()
    assert tuple(row) == (77, "", 0, [], [])
    assert M.parse_depth(raw(spark, {})).first()["event_time"] > 1_700_000_000_000


def test_envelope(spark):
    trade = {"e": "aggTrade", "s": "BTCUSDT"}
    items = [
        {"stream": "btcusdt@aggTrade", "data": trade},
        trade,
        {"stream": "ethusdt@depth20", "data": {"lastUpdateId": 1, "bids": [], "asks": []}},
        {"data": {"e": "depthUpdate", "s": "ethusdt"}},
        {"stream": "ethbtc@kline_1s", "data": {"e": "kline", "s": "ETHBTC"}},
        {"data": {"e": "other", "s": "BTCUSDT"}},
        {"data": {"lastUpdateId": 1}},
    ]
    out = M.unwrap_envelope(raw(spark, *items, "broken", "[1, 2]", "3"))
    assert sorted((r["event_type"], r["symbol"]) for r in out.collect()) == [
        ("aggTrade", "BTCUSDT"), ("aggTrade", "BTCUSDT"), ("depth", "ETHUSDT"), ("depth", "ETHUSDT")
    ]
    assert all(json.loads(r["payload"]).get("e") == "aggTrade" for r in out.where("event_type = 'aggTrade'").collect())
    assert M.unwrap_envelope(raw(spark, *items), quote=None).count() == 6


def test_positional_rows(spark):
    good = [60_000, "1", "2", "0.5", "1.5", "10", 119_999, "15", 3, "0", "0", "0"]
    bad = [120_000, "x", "2", "0.5", "1.5", "10", 179_999, "15", 3]
    df = spark.createDataFrame([("S", json.dumps([good, bad, [1]]))], "symbol string, raw string")
    out = M.parse_kline_rows(df)
    assert [tuple(r) for r in out.collect()] == [
        (60_000, "S", 60_000, 119_999, "1m", 1.0, 2.0, 0.5, 1.5, 10.0, 15.0, 3, True)
    ]
    tick = M.klines_to_ticks(out).first()
    assert (tick["event_time"], tick["price"], tick["bid"], tick["price_change_pct"], tick["source"]) == (60_000, 1.5, 1.5, 50.0, "backfill")
    zero = M.klines_to_ticks(out.withColumn("open", F.lit(0.0))).first()
    assert zero["price_change_pct"] == 0.0


def test_universe(spark):
    def item(s, quote="USDT", status="TRADING", **more):
        return {"symbol": s, "quoteAsset": quote, "status": status, **more}

    info = {"symbols": [
        item("B", isSpotTradingAllowed=True), item("A", isSpotTradingAllowed=True), item("C", "BTC", isSpotTradingAllowed=True),
        item("D", status="BREAK", isSpotTradingAllowed=True), item("E"), item("F", isSpotTradingAllowed=False),
    ]}
    assert [r[0] for r in M.symbol_universe(raw(spark, info)).collect()] == ["A", "B"]


def test_sources(spark):
    with pytest.raises(ValueError):
        M.register_source("half", {"ticker": M.parse_ticker})
    upper = {k: M.source("spot")[k] for k in M.RECORDS}
    upper["ticker"] = lambda df: M.parse_ticker(df).withColumn("symbol", F.concat("symbol", F.lit("-X")))
    M.register_source("other", upper)
    assert M.source("other")["ticker"](raw(spark, TICKER)).first()["symbol"] == "BTCUSDT-X"
    with pytest.raises(KeyError):
        M.source("none")


def test_frames(spark):
    body = spark.createDataFrame([("t", 258, bytearray(b"abc"))], "topic string, id int, body binary")
    framed = topics.frame(body, "body", "id")
    assert bytes(framed.first()["value"]) == b"\x00\x00\x00\x01\x02abc"
    row = topics.unframe(framed.drop("body")).first()
    assert (row["magic"], row["schema_id"], bytes(row["body"]), row["framed"]) == (0, 258, b"abc", True)
    bad = spark.createDataFrame([("t", bytearray(x)) for x in (b"", b"\x00\x00", b"\x01\x00\x00\x00\x01z")], "topic string, value binary")
    audit = topics.frame_audit(framed.select("topic", "value").unionByName(bad))
    assert sorted(tuple(r) for r in audit.collect() if r["schema_id"]) == [("t", 258, 1, 3, 0)]
    assert [(r["messages"], r["rejected"]) for r in audit.collect() if r["schema_id"] is None] == [(3, 3)]


def test_parsing_happens_once_per_message(spark):
    plan = M.parse_kline(raw(spark, {"E": 1}))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json") <= 2
