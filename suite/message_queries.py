"""Exchange messages built from the events table, parsed back into records."""

from __future__ import annotations

from pyspark.sql import functions as F

from candlelake.functions.time import epoch_ms
from candlelake.operators.book import book_metrics
from candlelake.sources import messages as M
from candlelake.sources import topics
from suite.base import MINUTE, query, table

RAW = """e AS (SELECT event_id AS id, upper(event_type) || CASE event_id % 4 WHEN 3 THEN 'BTC' ELSE 'USDT' END AS symbol,
  CAST(epoch_us(ts) // 1000 AS BIGINT) AS t, value AS price, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS qty FROM events)"""


def rows(spark, sf):
    quote = F.when(F.pmod("event_id", F.lit(4)) == 3, F.lit("BTC")).otherwise(F.lit("USDT"))
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        F.concat(F.upper("event_type"), quote).alias("symbol"),
        epoch_ms("ts").alias("t"),
        F.col("value").alias("price"),
        F.get_json_object("props", "$.k").cast("double").alias("qty"),
    )


def _text(c):
    return F.col(c).cast("string")


def ticker_message():
    """A ticker whose numbers are text; keys that differ only in case cannot share a struct, so it is put together as text."""
    # Every third message lacks the best prices, as reduced ticker streams do.
    prices = F.when(F.pmod("id", F.lit(3)) != 0, F.format_string(',"b":"%s","a":"%s"', _text("price"), _text("price")))
    return F.concat(
        F.format_string('{"e":"24hrTicker","E":%d,"s":"%s","c":"%s"', F.col("t"), F.col("symbol"), _text("price")),
        F.coalesce(prices, F.lit("")),
        F.format_string(',"p":"%s","P":"%s","n":%d}', _text("qty"), _text("price"), F.col("id")),
    )


TICKER_SQL = """SELECT t AS event_time, symbol, price AS close, CASE WHEN id % 3 <> 0 THEN price ELSE 0 END AS bid,
  CASE WHEN id % 3 <> 0 THEN price ELSE 0 END AS ask, CAST(0 AS DOUBLE) AS h24_open, CAST(0 AS DOUBLE) AS h24_high, CAST(0 AS DOUBLE) AS h24_low,
  CAST(0 AS DOUBLE) AS h24_volume, CAST(0 AS DOUBLE) AS h24_quote_volume, qty AS h24_price_change, price AS h24_price_change_pct, id AS h24_trade_count FROM e"""


@query("parse_ticker", f"WITH {RAW} {TICKER_SQL}")
def parse_ticker(spark, sf):
    return M.parse_ticker(rows(spark, sf).select(ticker_message().alias("raw")))


@query("explode_batch", f"WITH {RAW} {TICKER_SQL} WHERE symbol LIKE '%USDT'")
def explode_batch(spark, sf):
    # Each message holds a ticker, one of another quote asset, and one that lacks its symbol.
    other = F.format_string('{"E":%d,"s":"OTHERBTC","c":"1"}', F.col("t"))
    batch = F.concat(F.lit("["), ticker_message(), F.lit(","), other, F.lit(',{"E":1}]'))
    return M.explode_batch(rows(spark, sf).select(batch.alias("raw")))


def trade_message():
    return F.to_json(
        F.struct(
            F.lit("aggTrade").alias("e"),
            F.col("t").alias("E"),
            F.col("symbol").alias("s"),
            F.col("id").alias("a"),
            _text("price").alias("p"),
            _text("qty").alias("q"),
            (F.col("t") - 5).alias("T"),
            (F.pmod("id", F.lit(2)) == 0).alias("m"),
        )
    )


@query(
    "parse_trade",
    f"""WITH {RAW} SELECT t AS event_time, symbol, id AS agg_trade_id, price, qty AS quantity, t - 5 AS trade_time,
    id % 2 = 0 AS is_buyer_maker FROM e""",
)
def parse_trade(spark, sf):
    # The keys "E" and "e", "T" and "t" need case kept apart.
    return M.source("spot")["trade"](rows(spark, sf).select(trade_message().alias("raw")))


def kline_message():
    k = F.format_string(
        '{"t":%d,"T":%d,"s":"%s","i":"1m","o":"%s","c":"%s","h":"%s","l":"%s","v":"%s","n":%d,"x":%s,"q":"%s"}',
        F.col("t"), F.col("t") + 59_999, F.col("symbol"), _text("price"), _text("price"), _text("price"), _text("price"),
        _text("qty"), F.col("id"), (F.pmod("id", F.lit(2)) == 0).cast("string"), _text("qty"),
    )
    return F.format_string('{"e":"kline","E":%d,"s":"%s","k":%s}', F.col("t"), F.col("symbol"), k)


@query(
    "parse_kline",
    f"""WITH {RAW} SELECT t AS event_time, symbol, t AS kline_start, t + 59999 AS kline_close, '1m' AS interval, price AS open,
    price AS high, price AS low, price AS close, qty AS volume, qty AS quote_volume, id AS trade_count, id % 2 = 0 AS is_closed FROM e""",
)
def parse_kline(spark, sf):
    return M.parse_kline(rows(spark, sf).select(kline_message().alias("raw")))


def depth_message():
    levels = F.format_string('[["%s","1.5"],["%s","%s"]]', _text("price"), _text("qty"), _text("qty"))
    partial = F.format_string('{"lastUpdateId":%d,"bids":%s,"asks":[]}', F.col("id"), levels)
    update = F.format_string(
        '{"e":"depthUpdate","E":%d,"s":"%s","u":%d,"b":%s,"a":%s}', F.col("t"), F.lower("symbol"), F.col("id"), levels, levels
    )
    return F.when(F.pmod("id", F.lit(2)) == 0, partial).otherwise(update)


@query(
    "parse_depth",
    f"""WITH {RAW} SELECT CASE WHEN id % 2 = 0 THEN 1706659200000 ELSE t END AS event_time, CASE WHEN id % 2 = 0 THEN '' ELSE symbol END AS symbol,
    id AS last_update_id, CAST(2 AS INT) AS bid_depth, CAST(CASE WHEN id % 2 = 0 THEN 0 ELSE 2 END AS INT) AS ask_depth, price AS best_bid,
    CASE WHEN id % 2 = 0 THEN 0 ELSE price END AS best_ask, qty AS second_price FROM e""",
)
def parse_depth(spark, sf):
    out = M.parse_depth(rows(spark, sf).select(depth_message().alias("raw")), as_of=1_706_659_200_000)
    return book_metrics(out).select(
        "event_time", "symbol", "last_update_id", "bid_depth", "ask_depth", "best_bid", "best_ask",
        F.col("bids")[1]["price"].alias("second_price"),
    )


@query(
    "parse_envelope",
    f"""WITH {RAW} SELECT id, CASE id % 5 WHEN 0 THEN 'aggTrade' WHEN 1 THEN 'kline' ELSE 'depth' END AS event_type, symbol,
    id % 5 <> 0 AS wrapped FROM e WHERE id % 5 <> 3 AND symbol LIKE '%USDT'""",
)
def parse_envelope(spark, sf):
    kind = F.pmod("id", F.lit(5))

    def wrap(stream, body):
        return F.format_string('{"stream":"%s@%s","data":%s}', F.lower("symbol"), F.lit(stream), body)

    raw = (
        F.when(kind == 0, trade_message())
        .when(kind == 1, wrap("kline_1m", kline_message()))
        .when(kind == 2, wrap("depth20", depth_message()))
        .when(kind == 3, F.lit("not json"))
        .otherwise(wrap("depth20", depth_message()))
    )
    out = M.unwrap_envelope(rows(spark, sf).select("id", raw.alias("raw")))
    return out.select("id", "event_type", "symbol", (F.col("payload") != F.col("raw")).alias("wrapped"))


@query(
    "parse_kline_rows",
    f"""WITH {RAW}, r AS (SELECT *, unnest(range(2)) AS i FROM e)
    SELECT symbol, t + i * 60000 AS event_time, t + i * 60000 AS kline_start, t + i * 60000 + 59999 AS kline_close, '1m' AS interval, price AS open,
    price + 1 AS high, price - 1 AS low, price AS close, qty AS volume, qty AS quote_volume, id AS trade_count, TRUE AS is_closed
    FROM r WHERE i = 0 OR id % 3 <> 0""",
)
def parse_kline_rows(spark, sf):
    def row(i, volume):
        return F.format_string(
            '[%d,"%s","%s","%s","%s","%s",%d,"%s",%d,"0","0","0"]',
            F.col("t") + i * MINUTE, _text("price"), (F.col("price") + 1).cast("string"), (F.col("price") - 1).cast("string"),
            _text("price"), volume, F.col("t") + i * MINUTE + 59_999, _text("qty"), F.col("id"),
        )

    # In every third message the second row is malformed.
    bad = F.when(F.pmod("id", F.lit(3)) == 0, F.lit("?")).otherwise(_text("qty"))
    raw = F.format_string("[%s,%s]", row(0, _text("qty")), row(1, bad))
    return M.parse_kline_rows(rows(spark, sf).select("symbol", raw.alias("raw")))


@query(
    "symbol_universe",
    """SELECT 'P' || p_partkey || q AS symbol FROM (SELECT *, CASE p_partkey % 3 WHEN 0 THEN 'BTC' ELSE 'USDT' END AS q FROM part)
    WHERE q = 'USDT' AND p_size % 2 = 0 AND p_partkey % 5 <> 0""",
)
def symbol_universe(spark, sf):
    quote = F.when(F.pmod("p_partkey", F.lit(3)) == 0, F.lit("BTC")).otherwise(F.lit("USDT"))
    item = F.struct(
        F.concat(F.lit("P"), "p_partkey", quote).alias("symbol"),
        quote.alias("quoteAsset"),
        F.when(F.pmod("p_size", F.lit(2)) == 0, F.lit("TRADING")).otherwise(F.lit("BREAK")).alias("status"),
        F.when(F.pmod("p_partkey", F.lit(5)) != 0, F.lit(True)).alias("isSpotTradingAllowed"),
    )
    raw = F.to_json(F.struct(F.array(item).alias("symbols")))
    return M.symbol_universe(table(spark, sf, "part").select(raw.alias("raw")))


@query(
    "frame_audit",
    """SELECT 'events' AS topic, CASE WHEN event_id % 50 > 1 THEN 100 + length(event_type) ELSE -1 END AS schema_id, count(*) AS messages,
    CAST(sum(CASE WHEN event_id % 50 = 0 THEN 0 ELSE strlen(props) END) AS BIGINT) AS body_bytes, count(*) FILTER (WHERE event_id % 50 <= 1) AS rejected
    FROM events GROUP BY ALL""",
)
def frame_audit(spark, sf):
    framed = topics.frame(
        table(spark, sf, "events").select(
            "event_id", (F.length("event_type") + 100).alias("id"), F.col("props").cast("binary").alias("body")
        ),
        "body",
        "id",
    )
    # Some frames are cut inside the header, some start with another magic byte.
    which = F.pmod("event_id", F.lit(50))
    value = (
        F.when(which == 0, F.substring("value", 1, 3))
        .when(which == 1, F.concat(F.unhex(F.lit("07")), F.expr("substring(value, 2)")))
        .otherwise(F.col("value"))
    )
    out = topics.frame_audit(framed.select(F.lit("events").alias("topic"), value.alias("value")))
    return out.na.fill(-1, ["schema_id"])
