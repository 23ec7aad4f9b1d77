"""Indicators, gaps, ticks, live state, order books and symbols."""

from __future__ import annotations

from pyspark.sql import functions as F

from candlelake.functions.time import epoch_ms
from candlelake.operators import book, filters, gaps, indicators, live, recurrence, series, symbols, ticks as T
from candlelake.plans.maintenance import backfill_gaps, repair_points
from candlelake.schemas import interval_millis
from candlelake.sources import tables
from candlelake.streaming.streams import expire
from candlelake.workspace import work_dir
from suite.base import (
    AS_OF, C1H, CUT, DAY, END, HOUR, MINUTE, SPLIT, TICKS, candles, klines, ohlcv, query, sql, table, ticks,
)
from suite.candle_queries import OHLCV, OHLCV_COLUMNS, SMALL

NUMBERED = """r AS (SELECT symbol, open_time, close, row_number() OVER (PARTITION BY symbol ORDER BY open_time) AS n,
  close - lag(close) OVER (PARTITION BY symbol ORDER BY open_time) AS d FROM c1h)"""


# --- indicators ------------------------------------------------------------------------------------


def _sma_sql(n: int) -> str:
    w = f"OVER (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count(close) {w} = {n} THEN round(avg(close) {w}, 8) END AS sma{n}"


@query("sma", sql(C1H, f"SELECT symbol, open_time, close, {_sma_sql(20)}, {_sma_sql(50)} FROM c1h"))
def sma(spark, sf):
    rows = candles(spark, sf).select("symbol", "open_time", "close")
    return indicators.sma(rows, "1h", 20, 50, width_ms=SMALL)


@query(
    "chart_sma",
    sql(C1H, f"SELECT symbol, open_time, round(sma20 + 0.00001, 4) AS sma20 FROM (SELECT symbol, open_time, {_sma_sql(20)} FROM c1h) WHERE sma20 IS NOT NULL"),
)
def chart_sma(spark, sf):
    # Means of 20 prices often end in a 5 at the fifth place; the shift keeps both engines off such ties.
    rows = candles(spark, sf).select("symbol", "open_time", (F.col("close") + 0.00001).alias("close"))
    return indicators.sma(rows, "1h", 20, scale=4, drop_warmup=True, width_ms=SMALL).drop("close")


def _ema_sql(n: int, name: str) -> str:
    k = f"(2.0::DOUBLE / {n + 1})"
    return f"""{name} AS (SELECT symbol, open_time, n, close AS y FROM r WHERE n = 1
  UNION ALL SELECT r.symbol, r.open_time, r.n, r.close * {k} + e.y * (1 - {k}) FROM {name} e JOIN r ON r.symbol = e.symbol AND r.n = e.n + 1)"""


@query(
    "ema_first",
    sql(
        C1H, NUMBERED, _ema_sql(12, "a"), _ema_sql(26, "b"),
        "SELECT a.symbol, a.open_time, round(a.y, 6) AS ema12, round(b.y, 6) AS ema26 FROM a JOIN b USING (symbol, open_time)",
    ),
)
def ema_first(spark, sf):
    rows = candles(spark, sf).select("symbol", "open_time", "close")
    out = indicators.ema(rows, "15m", 12, scale=6)
    return indicators.ema(out, "15m", 26, scale=6).drop("close")


@query(
    "ema_sma_seed",
    sql(
        C1H,
        NUMBERED,
        """s AS (SELECT symbol, avg(close) AS y FROM r WHERE n <= 20 GROUP BY symbol),
        e AS (SELECT r.symbol, r.open_time, r.n, s.y FROM r JOIN s USING (symbol) WHERE n = 20
        UNION ALL SELECT r.symbol, r.open_time, r.n, r.close * (2.0::DOUBLE / 21) + e.y * (1 - (2.0::DOUBLE / 21))
        FROM e JOIN r ON r.symbol = e.symbol AND r.n = e.n + 1)""",
        "SELECT symbol, open_time, round(y, 6) AS ema20 FROM e",
    ),
)
def ema_sma_seed(spark, sf):
    rows = candles(spark, sf).select("symbol", "open_time", "close")
    return indicators.ema(rows, "15m", 20, seed="sma", scale=6).drop("close")


RSI = """s AS (SELECT symbol, sum(greatest(d, 0)) / 14 AS g, sum(greatest(-d, 0)) / 14 AS l FROM r WHERE n BETWEEN 2 AND 15 GROUP BY symbol),
e AS (SELECT r.symbol, r.open_time, r.n, s.g, s.l FROM r JOIN s USING (symbol) WHERE n = 15
  UNION ALL SELECT r.symbol, r.open_time, r.n, (e.g * 13 + greatest(r.d, 0)) / 14, (e.l * 13 + greatest(-r.d, 0)) / 14
  FROM e JOIN r ON r.symbol = e.symbol AND r.n = e.n + 1),
rsi AS (SELECT symbol, open_time, round(CASE WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END, 2) AS rsi FROM e)"""


@query("rsi", sql(C1H, NUMBERED, RSI, "SELECT * FROM rsi"))
def rsi(spark, sf):
    rows = candles(spark, sf).select("symbol", "open_time", "close")
    return indicators.rsi(rows, "15m").drop("close")


QUIET = "q AS (SELECT symbol, open_time, floor(close / 250) * 250 AS close FROM c1h)"
NUMBERED_QUIET = NUMBERED.replace("c1h", "q")


@query("rsi_quiet", sql(C1H, QUIET, NUMBERED_QUIET, RSI, "SELECT * FROM rsi"))
def rsi_quiet(spark, sf):
    """Closes in steps of 250: most rows do not move."""
    rows = candles(spark, sf).select("symbol", "open_time", (F.floor(F.col("close") / 250) * 250.0).alias("close"))
    return indicators.rsi(rows, "15m").drop("close")


COPIES = "q AS (SELECT symbol, open_time, close FROM c1h, range(5) AS copies(n))"


@query("ema_copies", sql(C1H, COPIES, NUMBERED_QUIET, _ema_sql(12, "a"), "SELECT symbol, open_time, n - 1 AS idx, round(y, 6) AS ema12 FROM a"))
def ema_copies(spark, sf):
    """Every candle five times: chunks in time hold more rows than candles."""
    rows = candles(spark, sf).select("symbol", "open_time", "close", F.explode(F.array(*[F.lit(i) for i in range(5)])).alias("copy"))
    k = 2 / 13
    out = recurrence.smooth(rows, ["symbol"], ["open_time", "copy"], "close", [recurrence.Smooth("ema12", 1 - k)], HOUR)
    return out.select("symbol", "open_time", "idx", F.round("ema12", 6).alias("ema12"))


@query(
    "user_indicator",
    sql(
        C1H,
        """SELECT symbol, open_time, round(high - low, 6) AS spread,
        round(max(high) OVER w - min(low) OVER w, 6) AS channel FROM c1h
        WINDOW w AS (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)""",
    ),
)
def user_indicator(spark, sf):
    """An indicator of the user's own, registered by name: the height of a candle and of the last ten."""

    def channel(df, interval, n=10):
        def build(rows, w):
            frame = w.rowsBetween(-(n - 1), 0)
            return rows.withColumns({"spread": F.round(F.col("high") - F.col("low"), 6), "channel": F.round(F.max("high").over(frame) - F.min("low").over(frame), 6)})

        return series.over_chunks(df, ["symbol"], ["open_time"], interval_millis(interval) * series.CANDLE_CHUNK_ROWS, build, lookback=n - 1)

    indicators.register_indicator("channel", channel)
    rows = candles(spark, sf).select("symbol", "open_time", "high", "low")
    return indicators.indicator("channel", rows, "1h").drop("high", "low")


MFI = """p AS (SELECT symbol, open_time, (high + low + close) / 3 AS tp, (high + low + close) / 3 * volume AS mf FROM c1h),
q AS (SELECT *, lag(tp) OVER (PARTITION BY symbol ORDER BY open_time) AS b FROM p),
z AS (SELECT symbol, open_time,
  sum(CASE WHEN tp >= b THEN mf ELSE 0 END) OVER w AS pos, sum(CASE WHEN tp >= b THEN 0 ELSE mf END) OVER w AS neg,
  count(b) OVER w AS flows FROM q
  WINDOW w AS (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN 13 PRECEDING AND CURRENT ROW)),
mfi AS (SELECT symbol, open_time, round(CASE WHEN neg = 0 THEN 100 ELSE 100 - 100 / (1 + pos / neg) END, 2) AS mfi FROM z WHERE flows = 14)"""


@query("mfi", sql(C1H, MFI, "SELECT * FROM mfi"))
def mfi(spark, sf):
    out = indicators.mfi(candles(spark, sf).select(*OHLCV_COLUMNS), "1h", width_ms=SMALL)
    return out.select("symbol", "open_time", "mfi")


@query(
    "osc_flags",
    sql(
        C1H,
        MFI,
        "f AS (SELECT *, CASE WHEN mfi >= 80 THEN 'overbought' WHEN mfi <= 20 THEN 'oversold' ELSE 'neutral' END AS zone FROM mfi)",
        "SELECT *, coalesce(lag(zone) OVER (PARTITION BY symbol ORDER BY open_time) <> zone, FALSE) AS crossed FROM f",
    ),
)
def osc_flags(spark, sf):
    return indicators.threshold_flags(mfi(spark, sf), "mfi", *indicators.MFI_LEVELS, interval="15m")


@query(
    "latest_indicators",
    sql(
        C1H,
        NUMBERED,
        _ema_sql(12, "a"),
        _ema_sql(26, "b"),
        f"m AS (SELECT symbol, open_time, {_sma_sql(20)}, {_sma_sql(50)} FROM c1h)",
        """SELECT symbol, open_time AS timestamp, round(m.sma20, 6) AS sma20, round(m.sma50, 6) AS sma50, round(a.y, 6) AS ema12, round(b.y, 6) AS ema26
        FROM m JOIN a USING (symbol, open_time) JOIN b USING (symbol, open_time)
        WHERE open_time = (SELECT max(open_time) FROM c1h WHERE c1h.symbol = m.symbol)""",
    ),
)
def latest_indicators(spark, sf):
    return live.latest_indicators(indicators.indicator_table(candles(spark, sf), "1h", scale=6)).drop("close")


# --- gaps ------------------------------------------------------------------------------------------

GAPS = f"""p AS (SELECT DISTINCT symbol, t - t % {MINUTE} + {MINUTE} AS t FROM ticks WHERE t >= {END - 31 * DAY} AND t < {END}),
g AS (SELECT symbol, b + {MINUTE} AS gap_start, t AS gap_end, t - b AS elapsed_ms
      FROM (SELECT *, lag(t) OVER (PARTITION BY symbol ORDER BY t) AS b FROM p) WHERE t - b > 300000)"""
# The second source of a symbol: minute candles of the symbol before it in the alphabet.
SECOND = f"""src AS (SELECT CASE symbol WHEN 'click' THEN 'error' WHEN 'error' THEN 'purchase' WHEN 'purchase' THEN 'signup'
  WHEN 'signup' THEN 'view' ELSE 'click' END AS symbol, open_time AS kline_start, open, close, volume, trade_count FROM m)"""


def second_source(spark, sf):
    names = ["click", "error", "purchase", "signup", "view"]
    following = F.create_map(*[F.lit(x) for pair in zip(names, names[1:] + names[:1]) for x in pair])
    return klines(spark, sf, "1m").withColumn("symbol", F.element_at(following, F.col("symbol")))


def found_gaps(spark, sf):
    return gaps.find_gaps(ticks(spark, sf), END, lookback_ms=31 * DAY)


@query("gaps", sql(TICKS, GAPS, "SELECT * FROM g"))
def gaps_query(spark, sf):
    return found_gaps(spark, sf)


@query(
    "repair_gaps",
    sql(
        TICKS, GAPS, ohlcv("m", "ticks", MINUTE), SECOND,
        "SELECT src.*, gap_start, gap_end FROM src JOIN g ON g.symbol = src.symbol AND kline_start BETWEEN gap_start AND gap_end",
    ),
)
def repair_gaps(spark, sf):
    rows = second_source(spark, sf).select("symbol", "kline_start", "open", "close", "volume", "trade_count")
    return gaps.repair_gaps(found_gaps(spark, sf), rows)


@query(
    "gap_summary",
    sql(
        TICKS, GAPS, ohlcv("m", "ticks", MINUTE), SECOND,
        """SELECT g.symbol, count(*) AS gaps, CAST(sum(gap_end - gap_start) AS BIGINT) AS missing_ms,
        count(*) FILTER (WHERE n > 0) AS filled_gaps, CAST(coalesce(sum(n), 0) AS BIGINT) AS repaired_rows FROM g LEFT JOIN (
          SELECT g.symbol, gap_start, count(*) AS n FROM src JOIN g ON g.symbol = src.symbol AND kline_start BETWEEN gap_start AND gap_end
          GROUP BY g.symbol, gap_start) x USING (symbol, gap_start) GROUP BY g.symbol""",
    ),
)
def gap_summary(spark, sf):
    return gaps.gap_summary(found_gaps(spark, sf), repair_gaps(spark, sf))


@query(
    "backfill_gaps",
    sql(
        TICKS, GAPS, ohlcv("m", "ticks", MINUTE), SECOND,
        """SELECT src.symbol, kline_start AS event_time, close AS price, close AS bid, close AS ask, volume, trade_count,
        CASE WHEN open <> 0 THEN round((close - open) / open * 100, 6) ELSE 0.0 END AS price_change_pct, 'backfill' AS source
        FROM src JOIN g ON g.symbol = src.symbol AND kline_start BETWEEN gap_start AND gap_end""",
    ),
)
def backfill_gaps_query(spark, sf):
    out = backfill_gaps(ticks(spark, sf), second_source(spark, sf), END, lookback_ms=31 * DAY)
    return out.drop("quote_volume").withColumn("price_change_pct", F.round("price_change_pct", 6))


@query(
    "backfill_landed",
    sql(
        TICKS, GAPS, ohlcv("m", "ticks", MINUTE), SECOND,
        """landed AS (SELECT DISTINCT src.symbol, kline_start AS t, close AS price FROM src JOIN g ON g.symbol = src.symbol AND kline_start BETWEEN gap_start AND gap_end),
        points AS (SELECT symbol, t, 'backfill' AS source, price FROM landed UNION ALL SELECT symbol, t, 'live', max(price) FROM ticks GROUP BY symbol, t)""",
        GAPS.replace("ticks", "points").replace("p AS", "p2 AS").replace("FROM p)", "FROM p2)").replace("FROM p ", "FROM p2 ").replace("g AS", "g2 AS"),
        """SELECT symbol, t AS time, source, price FROM points
        UNION ALL SELECT symbol, gap_start, 'gap', CAST(gap_end AS DOUBLE) FROM g
        UNION ALL SELECT symbol, gap_start, 'gap left', CAST(gap_end AS DOUBLE) FROM g2""",
    ),
)
def backfill_landed(spark, sf):
    """Gaps in stored tick points are filled from klines stored by day; then looked for again, with and without repairs."""
    path, source = work_dir(spark), work_dir(spark)
    rows = ticks(spark, sf).groupBy("symbol", "event_time").agg(F.max("price").alias("price"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("bid", "double"), ("ask", "double"), ("volume", "double"), ("quote_volume", "double"), ("price_change_pct", "double"), ("trade_count", "bigint"))]
    tables.write_points(tables.backfill_points(rows.select("*", *none)), path)
    tables.with_day(second_source(spark, sf), "kline_start").write.partitionBy("day").parquet(source)
    for _ in range(2):  # the second run changes nothing
        repair_points(spark, path, spark.read.parquet(source), END, lookback_ms=31 * DAY)
    points = spark.read.parquet(path)
    found = [
        gaps.find_gaps(tables.read_ticks(points), END, lookback_ms=31 * DAY, include_backfill=repairs).select("symbol", F.col("gap_start").alias("time"), F.lit(name).alias("source"), F.col("gap_end").cast("double").alias("price"))
        for name, repairs in (("gap", False), ("gap left", True))
    ]
    return points.select("symbol", "time", "source", "price").unionByName(found[0]).unionByName(found[1])


# --- ticks -----------------------------------------------------------------------------------------


@query(
    "tick_side",
    sql(
        TICKS,
        """SELECT symbol, t AS event_time, price, qty AS volume, id,
        CASE WHEN coalesce(price >= lead(price) OVER (PARTITION BY symbol ORDER BY t, id), TRUE) THEN 'buy' ELSE 'sell' END AS side
        FROM ticks""",
    ),
)
def tick_side(spark, sf):
    return T.tick_side(ticks(spark, sf), order=["event_time", "id"])


@query(
    "tick_rule",
    sql(
        TICKS,
        """SELECT symbol, t AS event_time, price, qty AS volume, id,
        CASE WHEN coalesce(price >= lag(price) OVER (PARTITION BY symbol ORDER BY t, id), TRUE) THEN 'buy' ELSE 'sell' END AS side
        FROM ticks""",
    ),
)
def tick_rule(spark, sf):
    return T.tick_side(ticks(spark, sf), mode="tick_rule", order=["event_time", "id"])


@query(
    "recent_ticks",
    sql(
        TICKS,
        """h AS (SELECT symbol, price, qty AS volume, max(t) AS event_time FROM ticks GROUP BY symbol, price, qty),
        n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY event_time DESC, price DESC, volume DESC) AS n FROM h)""",
        """SELECT symbol, event_time, price, volume,
        CASE WHEN coalesce(price >= lag(price) OVER (PARTITION BY symbol ORDER BY n), TRUE) THEN 'buy' ELSE 'sell' END AS side
        FROM n WHERE n <= 50""",
    ),
)
def recent_ticks(spark, sf):
    return T.recent_ticks(ticks(spark, sf), 50)


@query(
    "tick_members",
    sql(
        TICKS,
        "SELECT id, price, CASE WHEN id % 5 = 0 THEN 0.0 ELSE qty END AS volume FROM ticks",
    ),
)
def tick_members(spark, sf):
    member = F.when(F.pmod("id", F.lit(5)) == 0, F.col("price").cast("string")).otherwise(
        F.concat_ws(":", F.col("price").cast("string"), F.col("volume").cast("string"))
    )
    return T.parse_tick_member(ticks(spark, sf).select("id", member.alias("member")))


def throttle_sql(step):
    return f"""x AS (SELECT symbol, t AS event_time, id, floor(price / {step}) * {step} AS price,
  row_number() OVER (PARTITION BY symbol ORDER BY t, id) AS n FROM ticks),
w AS (SELECT symbol, event_time, id, price, n, event_time AS sent, 'change' AS reason FROM x WHERE n = 1
  UNION ALL SELECT x.symbol, x.event_time, x.id, x.price, x.n,
    CASE WHEN x.price <> w.price OR x.event_time - w.sent >= {HOUR} THEN x.event_time ELSE w.sent END,
    CASE WHEN x.price <> w.price THEN 'change' WHEN x.event_time - w.sent >= {HOUR} THEN 'heartbeat' ELSE 'skipped' END
  FROM w JOIN x ON x.symbol = w.symbol AND x.n = w.n + 1)"""


THROTTLE = throttle_sql(40)


def throttled(spark, sf, step=40):
    rows = ticks(spark, sf).select("symbol", "event_time", "id", (F.floor(F.col("price") / step) * float(step)).alias("price"))
    return T.throttle(rows, HOUR, ["event_time", "id"], DAY)


@query("throttle", sql(TICKS, THROTTLE, "SELECT symbol, event_time, id, price, reason FROM w"))
def throttle(spark, sf):
    return throttled(spark, sf)


# Prices so coarse that they stand for days: most ticks sent are heartbeats, in runs over many chunks.
@query("throttle_pegged", sql(TICKS, throttle_sql(400), "SELECT symbol, event_time, id, price, reason FROM w"))
def throttle_pegged(spark, sf):
    return throttled(spark, sf, 400)


@query("throttle_summary", sql(TICKS, THROTTLE, "SELECT symbol, reason, count(*) AS ticks FROM w GROUP BY symbol, reason"))
def throttle_summary(spark, sf):
    return T.throttle_summary(throttled(spark, sf))


@query(
    "asof_quote",
    """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS symbol, CAST(epoch_us(ts) // 1000 AS BIGINT) AS event_time, event_type, event_id, value FROM events)
    SELECT t.symbol, t.event_time, t.event_id, t.value AS price,
      CASE WHEN q.event_time >= t.event_time - 172800000 THEN q.event_time ELSE -1 END AS quote_time,
      CASE WHEN q.event_time >= t.event_time - 172800000 THEN q.value END AS quote
    FROM (SELECT * FROM e WHERE event_type <> 'view') t ASOF LEFT JOIN (SELECT * FROM e WHERE event_type = 'view') q
    ON t.symbol = q.symbol AND t.event_time >= q.event_time""",
)
def asof_quote(spark, sf):
    rows = table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("symbol"), epoch_ms("ts").alias("event_time"), "event_type", "event_id", "value"
    )
    trades = rows.where(F.col("event_type") != "view").select("symbol", "event_time", "event_id", F.col("value").alias("price"))
    views = rows.where(F.col("event_type") == "view").select("symbol", "event_time", "event_id", F.col("value").alias("quote"))
    out = T.asof_quote(trades, views, ["quote"], tolerance_ms=2 * DAY, width_ms=DAY, tie=["event_id"])
    return out.na.fill(-1, ["quote_time"])


@query("expire", sql(TICKS, f"SELECT symbol, t AS event_time, price, qty AS volume, id FROM ticks WHERE t > {CUT - DAY}"))
def expire_query(spark, sf):
    return expire(ticks(spark, sf), DAY, CUT)


# --- latest state and live candles -----------------------------------------------------------------

USERS = """u AS (SELECT 'NATION_' || (user_id % 20) AS symbol, CAST(epoch_us(ts) // 1000 AS BIGINT) AS t, event_id AS id, value AS price,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS qty FROM events),
tk AS (SELECT symbol, last(price ORDER BY t, id) AS price, last(qty - 50 ORDER BY t, id) AS change24h,
  last(price - 1 ORDER BY t, id) AS bid, last(price + 1 ORDER BY t, id) AS ask, last(qty ORDER BY t, id) AS volume, max(t) AS event_time FROM u GROUP BY symbol)"""


def nation_tickers(spark, sf):
    """Tickers of 20 of the 25 nations, from events."""
    price, qty = F.col("value"), F.get_json_object("props", "$.k").cast("double")
    return table(spark, sf, "events").select(
        F.concat(F.lit("NATION_"), F.pmod("user_id", F.lit(20))).alias("symbol"),
        epoch_ms("ts").alias("event_time"),
        price.alias("close"),
        (price - 1).alias("bid"),
        (price + 1).alias("ask"),
        qty.alias("h24_volume"),
        (qty - 50).alias("h24_price_change_pct"),
        F.col("event_id").alias("id"),
    )


def latest_nation_tickers(spark, sf):
    return live.ticker_view(live.latest_ticker(nation_tickers(spark, sf), order=["event_time", "id"]))


@query("latest_ticker", sql(USERS, "SELECT * FROM tk"))
def latest_ticker(spark, sf):
    return latest_nation_tickers(spark, sf)


@query(
    "watchlist",
    sql(
        USERS,
        """SELECT n_name AS symbol, coalesce(tk.price, CAST(n_nationkey AS DOUBLE)) AS price, coalesce(tk.change24h, 0.5) AS change,
        CASE WHEN tk.price > 0 THEN CASE WHEN tk.change24h >= 0 THEN 'green' ELSE 'red' END ELSE 'gray' END AS color
        FROM nation LEFT JOIN tk ON tk.symbol = n_name""",
    ),
)
def watchlist(spark, sf):
    items = table(spark, sf, "nation").select(
        F.col("n_name").alias("symbol"),
        F.col("n_nationkey").cast("double").alias("price"),
        F.lit(0.5).alias("change"),
        F.lit("gray").alias("color"),
    )
    return symbols.join_watchlist(items, latest_nation_tickers(spark, sf))


LIVE = f"""tick AS (SELECT symbol, last(price ORDER BY t, id) AS p, max(t) AS t FROM ticks WHERE t < {AS_OF} GROUP BY symbol),
last AS (SELECT symbol, max(open_time) AS t FROM q GROUP BY symbol),
sub AS (SELECT symbol, max(t - t % {MINUTE}) AS t FROM ticks WHERE t < {CUT} GROUP BY symbol),
live AS (SELECT tick.symbol, p, tick.t, tick.t - tick.t % {{size}} AS w, last.t AS last, sub.t AS sub
  FROM tick LEFT JOIN last USING (symbol) LEFT JOIN sub USING (symbol))"""


def _ticker(spark, sf):
    rows = ticks(spark, sf).where(F.col("event_time") < AS_OF)
    return live.latest_ticker(rows, order=["event_time", "id"]).select("symbol", "price", "event_time")


def _before_cut(spark, sf, interval):
    from candlelake.operators.candles import trades_to_candles
    from suite.base import as_trades

    rows = as_trades(ticks(spark, sf).where(F.col("event_time") < CUT))
    return trades_to_candles(rows, interval).select(*OHLCV_COLUMNS)


@query(
    "enrich_live",
    sql(
        TICKS,
        ohlcv("q", "ticks", 4 * HOUR, f"t < {CUT}"),
        LIVE.format(size=4 * HOUR),
        f"""SELECT q.symbol, q.open_time, q.open, CASE WHEN l.symbol IS NULL THEN q.high ELSE greatest(q.high, l.p) END AS high,
        CASE WHEN l.symbol IS NULL THEN q.low ELSE least(q.low, l.p) END AS low, coalesce(l.p, q.close) AS close, q.volume
        FROM q LEFT JOIN live l ON l.symbol = q.symbol AND l.w = q.open_time AND l.w = l.last AND {AS_OF} < l.w + {4 * HOUR} AND l.t > greatest(l.last, l.sub)
        UNION ALL SELECT symbol, w, p, p, p, p, 0.0 FROM live WHERE last IS NULL OR w > last""",
    ),
)
def enrich_live(spark, sf):
    return live.enrich_live(_before_cut(spark, sf, "4h"), _before_cut(spark, sf, "1m"), _ticker(spark, sf), "4h", AS_OF)


@query(
    "live_candle",
    sql(
        TICKS,
        ohlcv("q", "ticks", HOUR, f"t < {CUT + 20 * MINUTE}"),
        f"""tick AS (SELECT symbol, last(price ORDER BY t, id) AS p, max(t) AS t FROM ticks WHERE t < {AS_OF} GROUP BY symbol),
        bar AS (SELECT q.* FROM q JOIN (SELECT symbol, max(open_time) AS t FROM q GROUP BY symbol) x ON x.symbol = q.symbol AND x.t = q.open_time),
        src AS (SELECT symbol, max(t - t % {MINUTE}) AS s FROM ticks WHERE t < {CUT + 20 * MINUTE} GROUP BY symbol),
        z AS (SELECT bar.*, p, tick.t, tick.t - tick.t % {HOUR} AS w, s FROM bar JOIN tick USING (symbol) JOIN src USING (symbol)),
        k AS (SELECT *, CASE WHEN w = open_time AND t > s AND {AS_OF} < open_time + {HOUR} THEN 'moved' WHEN w > open_time THEN 'flat' ELSE 'plain' END AS kind FROM z)""",
        """SELECT symbol, CASE kind WHEN 'flat' THEN w ELSE open_time END AS open_time, CASE kind WHEN 'flat' THEN p ELSE open END AS open,
        CASE kind WHEN 'flat' THEN p WHEN 'moved' THEN greatest(high, p) ELSE high END AS high,
        CASE kind WHEN 'flat' THEN p WHEN 'moved' THEN least(low, p) ELSE low END AS low,
        CASE kind WHEN 'plain' THEN close ELSE p END AS close, CASE kind WHEN 'flat' THEN 0.0 ELSE volume END AS volume FROM k""",
    ),
)
def live_candle(spark, sf):
    from candlelake.operators.candles import trades_to_candles
    from suite.base import as_trades

    rows = as_trades(ticks(spark, sf).where(F.col("event_time") < CUT + 20 * MINUTE))
    sub = {i: trades_to_candles(rows, i).select(*OHLCV_COLUMNS) for i in ("1s", "1m", "1h")}
    return live.live_candle(sub["1s"], sub["1m"], _ticker(spark, sf), sub["1h"], "1h", AS_OF)


@query(
    "incremental",
    sql(
        C1H,
        f"stored AS (SELECT symbol, max(open_time) AS t FROM c1h WHERE open_time < {SPLIT} + length(symbol) * {DAY} AND symbol <> 'view' GROUP BY symbol)",
        f"""SELECT c.symbol, c.open_time AS kline_start, c.close FROM c1h c LEFT JOIN stored s USING (symbol)
        WHERE c.open_time >= coalesce(s.t + {MINUTE}, 1500000000000)""",
    ),
)
def incremental(spark, sf):
    from candlelake.operators.candles import last_time

    rows = klines(spark, sf)
    stored = rows.where((F.col("kline_start") < SPLIT + F.length("symbol") * DAY) & (F.col("symbol") != "view"))
    return live.incremental(rows.select("symbol", "kline_start", "close"), last_time(stored))


# --- order books -----------------------------------------------------------------------------------

LINES = """l AS (SELECT l_suppkey, l_orderkey, l_linenumber, l_extendedprice AS p, l_quantity AS q,
  CAST(epoch_us(l_shipdate) // 1000 AS BIGINT) AS event_time,
  row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC, l_extendedprice DESC, l_quantity DESC, l_partkey DESC) AS newest
  FROM lineitem)"""


def book_lines(spark, sf):
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").cast("string").alias("symbol"),
        "l_orderkey",
        "l_linenumber",
        "l_extendedprice",
        "l_quantity",
        "l_partkey",
        epoch_ms("l_shipdate").alias("event_time"),
    )


def with_levels(lines):
    """A book per line item: as many bids as the line's number, asks up to seven in all."""
    n = F.col("l_linenumber")
    price = F.col("l_extendedprice")

    def side(levels, sign):
        return F.transform(
            levels,
            lambda i: F.struct((price + sign * i * 0.5).alias("price"), (F.col("l_quantity") + i).cast("double").alias("qty")),
        )

    none = F.array().cast("array<int>")
    return lines.select(
        "*",
        side(F.sequence(F.lit(1), n), -1).alias("bids"),
        side(F.when(n < 7, F.sequence(F.lit(1), 7 - n)).otherwise(none), 1).alias("asks"),
    )


def books(spark, sf):
    return with_levels(book_lines(spark, sf))


@query(
    "book_metrics",
    sql(
        LINES,
        """SELECT CAST(l_suppkey AS VARCHAR) AS symbol, l_orderkey, l_linenumber, CAST(l_linenumber AS INT) AS bid_depth, CAST(7 - l_linenumber AS INT) AS ask_depth,
        p - 0.5 AS best_bid, CASE WHEN l_linenumber < 7 THEN p + 0.5 ELSE 0 END AS best_ask,
        CASE WHEN l_linenumber < 7 THEN round((p + 0.5) - (p - 0.5), 8) ELSE 0 END AS spread FROM l""",
    ),
)
def book_metrics(spark, sf):
    return book.book_metrics(books(spark, sf)).select(
        "symbol", "l_orderkey", "l_linenumber", "bid_depth", "ask_depth", "best_bid", "best_ask", "spread"
    )


@query(
    "book_ladder",
    sql(
        LINES,
        """s AS (SELECT *, 'bid' AS side, unnest(range(1, l_linenumber + 1)) AS i, l_linenumber AS depth FROM l
        UNION ALL SELECT *, 'ask' AS side, unnest(range(1, 8 - l_linenumber)) AS i, 7 - l_linenumber AS depth FROM l)""",
        """SELECT l_orderkey, l_linenumber, CAST(l_suppkey AS VARCHAR) AS symbol, side, CAST(i - 1 AS INT) AS level,
        CASE side WHEN 'bid' THEN p - i * 0.5 ELSE p + i * 0.5 END AS price, q + i AS amount, i * q + i * (i + 1) / 2 AS total,
        round((i * q + i * (i + 1) / 2) / (depth * q + depth * (depth + 1) / 2) * 100, 4) AS bar_pct,
        CASE WHEN l_linenumber < 7 THEN round(((p + 0.5) - (p - 0.5)) / (p + 0.5) * 100, 3) ELSE 0 END AS spread_pct FROM s""",
    ),
)
def book_ladder(spark, sf):
    return book.book_ladder(books(spark, sf), "l_orderkey", "l_linenumber", "symbol")


@query(
    "book_or_ticker",
    sql(
        USERS,
        LINES,
        """b AS (SELECT 'NATION_' || l_suppkey AS symbol, p - 0.5 AS best_bid, CASE WHEN l_linenumber < 7 THEN p + 0.5 ELSE 0 END AS best_ask,
        CASE WHEN l_linenumber < 7 THEN round((p + 0.5) - (p - 0.5), 8) ELSE 0 END AS spread, event_time,
        CAST(l_linenumber AS INT) AS bids FROM l WHERE newest = 1)""",
        """SELECT symbol, best_bid, best_ask, spread, event_time, bids FROM b
        UNION ALL SELECT symbol, bid, ask, round(ask - bid, 8), event_time, 1 FROM tk WHERE bid > 0 AND ask > 0 AND symbol NOT IN (SELECT symbol FROM b)""",
    ),
)
def book_or_ticker(spark, sf):
    from candlelake.operators.series import latest

    # Levels are built for the newest lines only: the aggregate sorts all its rows, which levels would widen.
    newest = latest(
        book_lines(spark, sf), ["symbol"], ["event_time", "l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_partkey"]
    )
    book_rows = book.book_metrics(with_levels(newest)).withColumn("symbol", F.concat(F.lit("NATION_"), "symbol"))
    out = book.book_or_ticker(book_rows, latest_nation_tickers(spark, sf))
    return out.select("symbol", "best_bid", "best_ask", "spread", "event_time", F.size("bids").alias("bids"))


# --- symbols ---------------------------------------------------------------------------------------

PAIRS = """pairs AS (SELECT p_partkey, upper(replace(p_name, ' ', '')) || CASE p_size % 5 WHEN 0 THEN 'USDT' WHEN 1 THEN 'BTC'
  WHEN 2 THEN 'EUR' WHEN 3 THEN 'ETH' ELSE 'USDC' END AS symbol FROM part)"""
NAMED = """named AS (SELECT DISTINCT symbol, CASE WHEN symbol LIKE '%USDT' THEN left(symbol, length(symbol) - 4) || ' / USDT'
  WHEN symbol LIKE '%BTC' THEN left(symbol, length(symbol) - 3) || ' / BTC' ELSE symbol END AS name, 'crypto' AS type FROM pairs)"""


def pairs(spark, sf):
    quote = F.get(F.array(*[F.lit(q) for q in ("USDT", "BTC", "EUR", "ETH", "USDC")]), F.pmod("p_size", F.lit(5)))
    base = F.upper(F.replace("p_name", F.lit(" "), F.lit("")))
    return table(spark, sf, "part").select("p_partkey", F.concat(base, quote).alias("symbol"))


@query("symbol_names", sql(PAIRS, NAMED, "SELECT * FROM named"))
def symbol_names(spark, sf):
    return symbols.active_symbols(pairs(spark, sf))


@query("symbol_search", sql(PAIRS, NAMED, "SELECT * FROM named WHERE lower(symbol) LIKE '%ring%' OR lower(name) LIKE '%ring%'"))
def symbol_search(spark, sf):
    return filters.search_symbols(symbols.active_symbols(pairs(spark, sf)), "Ring")


@query(
    "attach_meta",
    """SELECT c_custkey, coin || quote AS symbol, CASE WHEN quote = 'EUR' THEN coin || quote ELSE coin END AS coin, n_name AS name, n_regionkey AS region FROM
    (SELECT c_custkey, 'NATION_' || c_nationkey AS coin, CASE c_custkey % 3 WHEN 0 THEN 'USDT' WHEN 1 THEN 'BNB' ELSE 'EUR' END AS quote FROM customer)
    LEFT JOIN nation ON n_name = CASE WHEN quote = 'EUR' THEN coin || quote ELSE coin END""",
)
def attach_meta(spark, sf):
    quote = F.get(F.array(F.lit("USDT"), F.lit("BNB"), F.lit("EUR")), F.pmod("c_custkey", F.lit(3)).cast("int"))
    rows = table(spark, sf, "customer").select(
        "c_custkey", F.concat(F.lit("NATION_"), F.col("c_nationkey"), quote).alias("symbol")
    )
    meta = table(spark, sf, "nation").select(
        F.col("n_name").alias("coin"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")
    )
    return symbols.attach_meta(rows, meta)


@query(
    "merge_meta",
    """SELECT coalesce(f.n_name, o.n_name) AS coin, CASE WHEN f.n_name IS NULL THEN 'old' ELSE 'new' END AS name,
    coalesce(f.n_regionkey, o.n_regionkey) AS region FROM (SELECT * FROM nation WHERE n_nationkey < 15) o
    FULL JOIN (SELECT * FROM nation WHERE n_nationkey >= 10) f ON f.n_name = o.n_name""",
)
def merge_meta(spark, sf):
    nation = table(spark, sf, "nation").select(
        "n_nationkey", F.col("n_name").alias("coin"), F.col("n_regionkey").alias("region")
    )
    old = nation.where(F.col("n_nationkey") < 15).select("coin", F.lit("old").alias("name"), "region")
    new = nation.where(F.col("n_nationkey") >= 10).select("coin", F.lit("new").alias("name"), "region")
    return symbols.merge_meta(old, new)


@query(
    "partition_skew",
    """SELECT CAST(list_reduce(list_transform(string_split(md5(c_name), ''), lambda x: CAST(instr('0123456789abcdef', x) - 1 AS BIGINT)), lambda a, x: (a * 16 + x) % 12) AS INT) AS partition,
    count(*) AS rows, count(DISTINCT c_name) AS keys FROM customer GROUP BY 1""",
)
def partition_skew(spark, sf):
    return symbols.partition_skew(table(spark, sf, "customer").select(F.col("c_name").alias("symbol")))


@query("sorted_symbols", "SELECT DISTINCT c_name AS symbol, c_name AS name, 'crypto' AS type FROM customer")
def sorted_symbols(spark, sf):
    return symbols.active_symbols(table(spark, sf, "customer").select(F.col("c_name").alias("symbol")))


@query("page", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 10 OFFSET 30")
def page(spark, sf):
    return symbols.page(table(spark, sf, "customer").select("c_custkey", "c_name"), 3, "c_custkey")
