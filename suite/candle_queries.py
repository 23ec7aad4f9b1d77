"""Candles, merges, windows and limits."""

from __future__ import annotations

from pyspark.sql import functions as F

from candlelake.functions import numeric, text, time
from candlelake.operators import candles as C
from candlelake.operators import filters, gaps, indicators, merge
from candlelake.operators.series import last_n
from candlelake.plans import queries as P
from candlelake.sources.tables import with_day
from candlelake.workspace import work_dir
from suite.base import (
    AS_OF, C1H, CUT, DAY, END, HOUR, MINUTE, SPLIT, TICKS, again, candles, klines, ohlcv, query, sql, table, ticks, trades,
)

OHLCV = "symbol, open_time, open, high, low, close, volume"
OHLCV_COLUMNS = OHLCV.split(", ")
#: Chunk widths small enough that the test series cross many chunk borders.
SMALL = 5 * DAY


# --- candles from trades ---------------------------------------------------------------------------

for _name, _size in {"1m": MINUTE, "1h": HOUR, "1d": DAY, "1w": 7 * DAY}.items():

    @query(f"ohlcv_{_name}", sql(TICKS, ohlcv("c", "ticks", _size), "SELECT * FROM c"))
    def _ohlcv(spark, sf, interval=_name):
        return candles(spark, sf, interval)


@query("resample_1h_4h", sql(C1H, again("r", "c1h", 4 * HOUR), "SELECT * FROM r"))
def resample_1h_4h(spark, sf):
    return C.resample(candles(spark, sf).select(*OHLCV_COLUMNS), "4h", base="1h")


@query("hourly_rollup", sql(TICKS, ohlcv("m", "ticks", MINUTE), again("r", "m", HOUR), "SELECT * FROM r"))
def hourly_rollup(spark, sf):
    return C.rollup_hourly(candles(spark, sf, "1m").select(*OHLCV_COLUMNS))


@query(
    "orders_daily_by_nation",
    sql(
        f"""t AS (SELECT n_name AS symbol, CAST(epoch_us(o_orderdate) // 1000 AS BIGINT) AS t, o_totalprice AS price,
        CAST(1 AS DOUBLE) AS qty, o_orderkey AS id
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)""",
        ohlcv("c", "t", DAY),
        f"SELECT {OHLCV}, trade_count FROM c",
    ),
)
def orders_daily_by_nation(spark, sf):
    orders, customer, nation = (table(spark, sf, t) for t in ("orders", "customer", "nation"))
    rows = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            F.col("n_name").alias("symbol"),
            time.epoch_ms("o_orderdate").alias("trade_time"),
            F.col("o_totalprice").alias("price"),
            F.lit(1.0).alias("quantity"),
            F.col("o_orderkey").alias("agg_trade_id"),
        )
    )
    return C.trades_to_candles(rows, "1d").select(*OHLCV_COLUMNS, "trade_count")


GRID = f"""h AS (SELECT DISTINCT symbol, open_time - open_time % {HOUR} AS w FROM m),
grid AS (SELECT symbol, w, w + {MINUTE} * i AS t FROM (SELECT symbol, w, unnest(range(60)) AS i FROM h)),
j AS (SELECT g.symbol, g.w, g.t, m.open, m.high, m.low, m.close, m.volume, m.quote_volume, m.trade_count
      FROM grid g LEFT JOIN m ON m.symbol = g.symbol AND m.open_time = g.t),
s AS (SELECT *, coalesce(
        last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        first_value(close IGNORE NULLS) OVER (PARTITION BY symbol, w ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)
      ) AS fill FROM j),
f AS (SELECT symbol, w, t AS open_time, coalesce(open, fill) AS open, coalesce(high, fill) AS high,
        coalesce(low, fill) AS low, fill AS close, coalesce(volume, 0) AS volume,
        coalesce(quote_volume, 0) AS quote_volume, coalesce(trade_count, 0) AS trade_count, close IS NULL AS filled FROM s)"""


@query(
    "rollup_gapfill",
    sql(
        TICKS,
        ohlcv("m", "ticks", MINUTE),
        GRID,
        f"""SELECT symbol, w AS kline_start, w + {HOUR - 1} AS kline_close, first(open ORDER BY open_time) AS open,
        max(high) AS high, min(low) AS low, last(close ORDER BY open_time) AS close, round(sum(volume), 8) AS volume,
        round(sum(quote_volume), 6) AS quote_volume, CAST(sum(trade_count) AS BIGINT) AS trade_count,
        count(*) FILTER (WHERE volume > 0) AS real_steps
        FROM f GROUP BY symbol, w""",
    ),
)
def rollup_gapfill(spark, sf):
    out = C.rollup(candles(spark, sf, "1m"), "1m", "1h")
    return out.drop("event_time", "interval", "is_closed").withColumn("quote_volume", F.round("quote_volume", 6))


@query("gapfill_dense", sql(TICKS, ohlcv("m", "ticks", MINUTE), GRID, f"SELECT {OHLCV}, filled FROM f"))
def gapfill_dense(spark, sf):
    return gaps.gap_fill(candles(spark, sf, "1m").select(*OHLCV_COLUMNS), "1m", "1h")


@query(
    "coverage",
    sql(
        TICKS,
        ohlcv("m", "ticks", MINUTE),
        f"""SELECT symbol, open_time - open_time % {HOUR} AS open_time, count(*) FILTER (WHERE volume > 0) AS real,
        60 AS expected, round(count(*) FILTER (WHERE volume > 0) / 60, 6) AS ratio
        FROM m GROUP BY symbol, open_time - open_time % {HOUR}""",
    ),
)
def coverage(spark, sf):
    return gaps.coverage(candles(spark, sf, "1m"), "1m", "1h")


@query(
    "current_bar",
    sql(
        TICKS,
        ohlcv("m", "ticks", MINUTE),
        again("r", "m", 4 * HOUR),
        f"""SELECT {', '.join('r.' + c for c in OHLCV_COLUMNS)}, x.source_time FROM r
        JOIN (SELECT symbol, max(open_time) AS source_time FROM m GROUP BY symbol) x
        ON x.symbol = r.symbol AND r.open_time = x.source_time - x.source_time % {4 * HOUR}""",
    ),
)
def current_bar(spark, sf):
    return C.current_bar(candles(spark, sf, "1m"), "4h")


@query(
    "last_per_window",
    sql(
        TICKS,
        f"""SELECT symbol, t - t % {MINUTE} + {MINUTE} AS event_time, last(price ORDER BY t, id) AS price
        FROM ticks GROUP BY symbol, t - t % {MINUTE}""",
    ),
)
def last_per_window(spark, sf):
    return C.last_per_window(ticks(spark, sf), tie=["id"])


@query(
    "last_time",
    sql(C1H, "SELECT symbol, max(open_time) AS last_time FROM c1h GROUP BY symbol"),
)
def last_time(spark, sf):
    return C.last_time(klines(spark, sf))


@query(
    "overview",
    sql(
        C1H,
        """a AS (SELECT symbol, first(open ORDER BY open_time) AS o, last(close ORDER BY open_time) AS c, max(high) AS high,
        min(low) AS low, round(sum(volume), 8) AS volume FROM c1h GROUP BY symbol)""",
        """SELECT symbol, c AS last_close, high, low, volume, round(c - o, 8) AS change,
        CASE WHEN o <> 0 THEN round((c - o) / o * 100, 2) END AS change_pct,
        round((c - low) / CASE WHEN high - low = 0 THEN 1.0 ELSE high - low END * 100, 6) AS position_pct,
        c - o >= 0 AS is_up FROM a""",
    ),
)
def overview(spark, sf):
    return C.overview(candles(spark, sf))


@query(
    "normalized",
    sql(
        C1H,
        """SELECT symbol, open_time, close,
        round((row_number() OVER (PARTITION BY symbol ORDER BY open_time) - 1) / (count(*) OVER (PARTITION BY symbol) - 1), 6) AS x,
        round((close - min(close) OVER (PARTITION BY symbol)) /
              (max(close) OVER (PARTITION BY symbol) - min(close) OVER (PARTITION BY symbol)), 6) AS y
        FROM c1h""",
    ),
)
def normalized(spark, sf):
    return indicators.normalize_series(candles(spark, sf), "15m")


# --- merging ---------------------------------------------------------------------------------------


def tier_pair(spark, sf):
    """Two overlapping tiers: the second one has other volumes and closed flags, by the hour's number."""
    rows = candles(spark, sf).select(*OHLCV_COLUMNS)
    hour = (F.col("open_time") / HOUR).cast("bigint")
    first = rows.where(F.col("open_time") < SPLIT + 3 * DAY).withColumn("is_closed", F.pmod(hour, F.lit(7)) != 0)
    second = rows.where(F.col("open_time") >= SPLIT - 3 * DAY).withColumns(
        {"volume": F.col("volume") + F.pmod(hour, F.lit(7)) - 3, "is_closed": F.pmod(hour, F.lit(7)) >= 2}
    )
    return first, second


TIERS = f"""a AS (SELECT {OHLCV}, (open_time // {HOUR}) % 7 <> 0 AS is_closed FROM c1h WHERE open_time < {SPLIT + 3 * DAY}),
b AS (SELECT symbol, open_time, open, high, low, close, volume + (open_time // {HOUR}) % 7 - 3 AS volume,
      (open_time // {HOUR}) % 7 >= 2 AS is_closed FROM c1h WHERE open_time >= {SPLIT - 3 * DAY})"""


@query(
    "merge_tiers",
    sql(
        C1H,
        TIERS,
        f"""SELECT {OHLCV}, is_closed FROM (SELECT *, row_number() OVER (PARTITION BY symbol, open_time
        ORDER BY is_closed DESC, volume DESC, r DESC) AS n FROM (SELECT *, 0 AS r FROM a UNION ALL SELECT *, 1 AS r FROM b))
        WHERE n = 1""",
    ),
)
def merge_tiers(spark, sf):
    return merge.merge_candles(*tier_pair(spark, sf))


@query(
    "tiered_read",
    sql(
        C1H,
        TIERS,
        f"""SELECT * FROM a WHERE open_time >= {SPLIT - 6 * DAY} AND open_time < {SPLIT}
        UNION ALL SELECT * FROM b WHERE open_time >= {SPLIT} AND open_time < {SPLIT + 6 * DAY}""",
    ),
)
def tiered_read(spark, sf):
    cold, warm = tier_pair(spark, sf)
    return P.tiered_read(warm, cold, SPLIT - 6 * DAY, SPLIT + 6 * DAY, SPLIT)


FINE = f"fine AS (SELECT {OHLCV} FROM m WHERE (open_time // {DAY}) % 3 <> 0)"
HOURLY = f"hourly AS (SELECT {OHLCV} FROM c1h)"
FALLBACK = f"""base AS (SELECT {OHLCV} FROM fine UNION ALL SELECT {OHLCV} FROM hourly h WHERE NOT EXISTS (
  SELECT 1 FROM fine f WHERE f.symbol = h.symbol AND f.open_time - f.open_time % {HOUR} = h.open_time))"""


def fine_and_hourly(spark, sf):
    """Minute candles without every third day, and hourly candles of all days."""
    day = F.pmod((F.col("open_time") / DAY).cast("bigint"), F.lit(3))
    minute = candles(spark, sf, "1m").select(*OHLCV_COLUMNS)
    return minute.where(day != 0), candles(spark, sf).select(*OHLCV_COLUMNS)


@query("hourly_fallback", sql(C1H, ohlcv("m", "ticks", MINUTE), FINE, HOURLY, FALLBACK, f"SELECT {OHLCV} FROM base"))
def hourly_fallback(spark, sf):
    return merge.fill_from_hourly(*fine_and_hourly(spark, sf))


@query(
    "historical",
    sql(
        C1H,
        ohlcv("m", "ticks", MINUTE),
        FINE,
        HOURLY,
        FALLBACK,
        again("r", f"(SELECT * FROM base WHERE open_time >= {SPLIT - 9 * DAY} AND open_time < {SPLIT + 9 * DAY})", 4 * HOUR),
        f"""SELECT {OHLCV} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) AS n FROM r
        WHERE open_time >= {SPLIT - 9 * DAY} AND open_time < {SPLIT + 9 * DAY}) WHERE n <= 60""",
    ),
)
def historical(spark, sf):
    fine, hourly = fine_and_hourly(spark, sf)
    return P.historical(fine, fine, hourly, "4h", SPLIT - 9 * DAY, SPLIT + 9 * DAY, SPLIT, limit=60)


@query(
    "collect_base",
    sql(
        TICKS,
        ohlcv("m", "ticks", MINUTE),
        f"""SELECT {OHLCV} FROM (SELECT *, dense_rank() OVER (PARTITION BY symbol ORDER BY open_time // {4 * HOUR} DESC) AS n
        FROM m WHERE open_time < {CUT}) WHERE n <= 40""",
    ),
)
def collect_base(spark, sf):
    minute = candles(spark, sf, "1m").select(*OHLCV_COLUMNS)
    return P.collect_base(minute, minute, "4h", 40, CUT, SPLIT)


@query(
    "best_by_volume",
    sql(
        TICKS,
        ohlcv("m", "ticks", 1000),
        """d AS (SELECT *, 0 AS arrival FROM m UNION ALL
        SELECT symbol, open_time, open, high, low, close + 1 AS close, volume + open_time % 3 - 1 AS volume, quote_volume, trade_count, 1 AS arrival FROM m)""",
        f"""SELECT {OHLCV}, arrival FROM (SELECT *, row_number() OVER (PARTITION BY symbol, open_time
        ORDER BY volume DESC, arrival) AS n FROM d) WHERE n = 1""",
    ),
)
def best_by_volume(spark, sf):
    rows = candles(spark, sf, "1s").select(*OHLCV_COLUMNS)
    copy = rows.withColumns({"close": F.col("close") + 1, "volume": F.col("volume") + F.pmod("open_time", F.lit(3)) - 1})
    both = rows.withColumn("arrival", F.lit(0)).unionByName(copy.withColumn("arrival", F.lit(1)))
    return merge.best_by_volume(both, "arrival")


@query(
    "prepend_older",
    sql(
        C1H,
        f"""live AS (SELECT {OHLCV} FROM c1h WHERE open_time >= {SPLIT} AND symbol <> 'view')""",
        f"""SELECT * FROM live UNION ALL SELECT {OHLCV} FROM c1h c
        WHERE c.open_time < coalesce((SELECT min(open_time) FROM live l WHERE l.symbol = c.symbol), {END * 2})""",
    ),
)
def prepend_older(spark, sf):
    rows = candles(spark, sf).select(*OHLCV_COLUMNS)
    live = rows.where((F.col("open_time") >= SPLIT) & (F.col("symbol") != "view"))
    return merge.prepend_older(live, rows)


@query(
    "diff_candles",
    sql(
        C1H,
        f"""o AS (SELECT {OHLCV} FROM c1h WHERE open_time < {SPLIT} AND (open_time // {HOUR}) % 11 <> 0),
        n AS (SELECT symbol, open_time, open, high, low, close + CASE WHEN (open_time // {HOUR}) % 5 = 0 THEN 1 ELSE 0 END AS close, volume
              FROM c1h WHERE open_time < {SPLIT + DAY}),
        last AS (SELECT symbol, max(open_time) AS t FROM o GROUP BY symbol)""",
        """SELECT n.*, CASE WHEN o.symbol IS NULL THEN 'added' ELSE 'updated' END AS change
        FROM n LEFT JOIN o ON o.symbol = n.symbol AND o.open_time = n.open_time LEFT JOIN last ON last.symbol = n.symbol
        WHERE (o.symbol IS NULL AND (last.t IS NULL OR n.open_time > last.t))
           OR (o.symbol IS NOT NULL AND n.open_time <> last.t AND (n.close <> o.close OR n.high <> o.high OR n.low <> o.low OR n.volume <> o.volume))""",
    ),
)
def diff_candles(spark, sf):
    rows = candles(spark, sf).select(*OHLCV_COLUMNS)
    hour = (F.col("open_time") / HOUR).cast("bigint")
    old = rows.where((F.col("open_time") < SPLIT) & (F.pmod(hour, F.lit(11)) != 0))
    bump = F.when(F.pmod(hour, F.lit(5)) == 0, 1).otherwise(0)
    new = rows.where(F.col("open_time") < SPLIT + DAY).withColumn("close", F.col("close") + bump)
    return merge.diff_candles(old, new)


@query(
    "apply_update",
    sql(
        C1H,
        f"""s AS (SELECT {OHLCV} FROM c1h WHERE open_time < {SPLIT}),
        u AS (SELECT {OHLCV.replace('close', 'close + 1 AS close')}, open_time + (open_time // {HOUR}) % 4 * {5 * HOUR + 1} AS seq
              FROM c1h WHERE open_time >= {SPLIT - DAY}),
        ok AS (SELECT * FROM (SELECT u.*, greatest(
                 max(open_time) OVER (PARTITION BY symbol ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                 (SELECT max(open_time) FROM s WHERE s.symbol = u.symbol)) AS floor FROM u)
               WHERE floor IS NULL OR open_time >= floor)""",
        f"""SELECT {OHLCV} FROM (SELECT {OHLCV}, row_number() OVER (PARTITION BY symbol, open_time ORDER BY seq DESC) AS n
        FROM (SELECT {OHLCV}, -1 AS seq FROM s UNION ALL SELECT {OHLCV}, seq FROM ok)) WHERE n = 1""",
    ),
)
def apply_update(spark, sf):
    rows = candles(spark, sf).select(*OHLCV_COLUMNS)
    hour = (F.col("open_time") / HOUR).cast("bigint")
    late = F.pmod(hour, F.lit(4)) * (5 * HOUR + 1)
    update = rows.where(F.col("open_time") >= SPLIT - DAY).withColumns(
        {"close": F.col("close") + 1, "seq": F.col("open_time") + late}
    )
    return merge.apply_update(rows.where(F.col("open_time") < SPLIT), update, "1h", width_ms=SMALL)


# --- limits ----------------------------------------------------------------------------------------


@query(
    "last_n",
    sql(C1H, f"""SELECT {OHLCV} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) AS n FROM c1h)
    WHERE n <= 200"""),
)
def last_n_query(spark, sf):
    return last_n(candles(spark, sf).select(*OHLCV_COLUMNS), 200, ["symbol"], ["open_time"], SMALL)


@query(
    "cap_series",
    sql(C1H, f"""SELECT {OHLCV} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) AS n FROM c1h)
    WHERE n <= 120"""),
)
def cap_series(spark, sf):
    return merge.cap_series(candles(spark, sf).select(*OHLCV_COLUMNS), 120, SMALL)


@query(
    "klines",
    sql(
        TICKS,
        ohlcv("m", "ticks", MINUTE),
        ohlcv("q", "ticks", 4 * HOUR, f"t < {CUT}"),
        f"""last AS (SELECT symbol, max(open_time) AS t FROM q GROUP BY symbol),
        sub AS (SELECT symbol, max(open_time) AS t FROM m WHERE open_time < {CUT} GROUP BY symbol),
        tick AS (SELECT symbol, last(price ORDER BY t, id) AS p, max(t) AS t FROM ticks WHERE t < {AS_OF} GROUP BY symbol),
        live AS (SELECT tick.symbol, p, tick.t, tick.t - tick.t % {4 * HOUR} AS w, last.t AS last, sub.t AS sub
                 FROM tick LEFT JOIN last USING (symbol) LEFT JOIN sub USING (symbol)),
        r AS (SELECT q.symbol, q.open_time, q.open,
              CASE WHEN l.symbol IS NULL THEN q.high ELSE greatest(q.high, l.p) END AS high,
              CASE WHEN l.symbol IS NULL THEN q.low ELSE least(q.low, l.p) END AS low,
              coalesce(l.p, q.close) AS close, q.volume
              FROM q LEFT JOIN live l ON l.symbol = q.symbol AND l.w = q.open_time AND l.w = l.last
                AND {AS_OF} < l.w + {4 * HOUR} AND l.t > greatest(l.last, l.sub)
              UNION ALL SELECT symbol, w, p, p, p, p, 0.0 FROM live WHERE last IS NULL OR w > last)""",
        f"""SELECT {OHLCV} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) AS n FROM r) WHERE n <= 50""",
    ),
)
def klines_query(spark, sf):
    minute = candles(spark, sf, "1m").select(*OHLCV_COLUMNS).where(F.col("open_time") < CUT)
    return P.klines(
        hot=minute, warm=minute, cold=minute, hourly=minute, ticker=ticker_before(spark, sf, AS_OF), interval="4h",
        limit=50, as_of=AS_OF,
    )


SYMBOLS = ["click", "error", "purchase", "signup", "view"]


def by_day(df):
    """A copy of candles stored by day."""
    path = work_dir(df.sparkSession)
    with_day(df, "open_time").write.partitionBy("day").parquet(path)
    return df.sparkSession.read.parquet(path)


@query(
    "klines_before",
    sql(
        C1H,
        ohlcv("m", "ticks", MINUTE),
        f"""fine AS (SELECT symbol, open_time, open, high, low, close + CASE WHEN open_time >= {SPLIT} THEN 1 ELSE 2 END AS close, volume
                 FROM m WHERE open_time < {CUT} AND (open_time // {HOUR}) % 7 <> 0)""",
        again("hours", "fine", HOUR),
        f"""every AS (SELECT * FROM hours UNION ALL
                  SELECT {OHLCV.replace("close", "close + 3 AS close")} FROM c1h WHERE open_time < {CUT} AND (open_time // {HOUR}) % 7 = 0)""",
        again("r", "every", 4 * HOUR),
        f"SELECT {OHLCV} FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) AS n FROM r) WHERE n <= 60",
    ),
)
def klines_before(spark, sf):
    """Three different tiers stored by day; the warm one begins at SPLIT, some hours stand in the hourly table alone."""
    hour = F.pmod((F.col("open_time") / HOUR).cast("bigint"), F.lit(7))
    minute = candles(spark, sf, "1m").select(*OHLCV_COLUMNS).where(hour != 0)
    warm, cold = (by_day(minute.where(F.col("open_time") >= first).withColumn("close", F.col("close") + shift)) for first, shift in ((SPLIT, 1), (0, 2)))
    hourly = by_day(candles(spark, sf).select(*OHLCV_COLUMNS).withColumn("close", F.col("close") + 3))
    return P.klines(
        hot=minute, warm=warm, cold=cold, hourly=hourly, ticker=ticker_before(spark, sf, AS_OF), interval="4h", limit=60,
        as_of=SPLIT + 90 * DAY, end=CUT, symbols=SYMBOLS,
    )


@query(
    "klines_1s",
    sql(
        TICKS,
        ohlcv("s", "ticks", 1000),
        f"""SELECT symbol, open_time, open, high, low, close + 1 AS close, volume + 1 AS volume
        FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) AS n FROM s WHERE open_time < {CUT}) WHERE n <= 90""",
    ),
)
def klines_1s(spark, sf):
    """Seconds, each also as an earlier copy of smaller volume."""
    second = candles(spark, sf, "1s").select(*OHLCV_COLUMNS)
    fuller = second.withColumns({"close": F.col("close") + 1, "volume": F.col("volume") + 1})
    hot = by_day(second.unionByName(fuller))
    none = second.limit(0)
    return P.klines(hot, none, none, none, ticker_before(spark, sf, AS_OF), "1s", 90, AS_OF, end=CUT, symbols=SYMBOLS)


@query(
    "last_time_by_day",
    sql(C1H, "SELECT symbol, max(open_time) AS last_time FROM c1h GROUP BY symbol"),
)
def last_time_by_day(spark, sf):
    """Out of the newest days of a stored table, as many as the symbols need."""
    return C.last_time(by_day(candles(spark, sf)), "open_time", None, SYMBOLS)


def ticker_before(spark, sf, as_of):
    from candlelake.operators.live import latest_ticker

    rows = ticks(spark, sf).where(F.col("event_time") < as_of)
    return latest_ticker(rows, order=["event_time", "id"]).select("symbol", "price", "event_time")


# --- scalar functions and filters ------------------------------------------------------------------


@query(
    "filters",
    sql(
        TICKS,
        """SELECT symbol, t AS event_time, price, qty AS volume, id, epoch_ms(t) IS NOT NULL AS stamped,
        strftime(epoch_ms(t), '%Y-%m-%dT%H:%M:%SZ') AS rfc, CAST(CAST(epoch_ms(t) AS DATE) AS VARCHAR) AS day
        FROM ticks WHERE symbol IS NOT NULL AND symbol LIKE '%k'""",
    ),
)
def filters_query(spark, sf):
    rows = filters.quote_filter(filters.require(ticks(spark, sf), "event_time", "symbol"), "k")
    stamped = filters.with_timestamps(rows, event_timestamp="event_time")
    return stamped.select(
        *rows.columns,
        F.col("event_timestamp").isNotNull().alias("stamped"),
        time.rfc3339("event_time").alias("rfc"),
        time.day_of("event_time").cast("string").alias("day"),
    )


@query(
    "valid_symbols",
    """SELECT p_partkey, upper(trim(s, chr(9) || chr(10) || chr(13) || ' ')) AS symbol,
    regexp_full_match(upper(trim(s, chr(9) || chr(10) || chr(13) || ' ')), '[A-Z0-9]{1,20}') AS valid
    FROM (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN ' ' || replace(p_name, ' ', '') || chr(9)
      WHEN 1 THEN p_name WHEN 2 THEN replace(p_name, ' ', '') || chr(10) ELSE replace(p_name, ' ', '') || p_type || p_brand END AS s FROM part)""",
)
def valid_symbols(spark, sf):
    flat = F.replace("p_name", F.lit(" "), F.lit(""))
    which = F.pmod("p_partkey", F.lit(4))
    raw = (
        F.when(which == 0, F.concat(F.lit(" "), flat, F.lit("\t")))
        .when(which == 1, F.col("p_name"))
        .when(which == 2, F.concat(flat, F.lit("\n")))
        .otherwise(F.concat(flat, "p_type", "p_brand"))
    )
    rows = table(spark, sf, "part").select("p_partkey", raw.alias("symbol"))
    return filters.normalize_symbol(rows, keep_rejects=True)


@query(
    "interval_names",
    """SELECT p_partkey, CAST(CASE p_size % 6 WHEN 0 THEN 60000 WHEN 1 THEN 3600000 WHEN 2 THEN 14400000 WHEN 3 THEN 86400000
    WHEN 4 THEN 604800000 ELSE 0 END AS BIGINT) AS interval_ms FROM part""",
)
def interval_names(spark, sf):
    names = F.array(*[F.lit(x) for x in ("1M", "  1H  ", "4H", "1D", "1W", "2m")])
    rows = table(spark, sf, "part").select("p_partkey", F.get(names, F.pmod("p_size", F.lit(6))).alias("name"))
    return rows.select("p_partkey", time.interval_ms("name").alias("interval_ms"))


@query("range_filter", sql(C1H, f"SELECT {OHLCV} FROM c1h WHERE open_time >= {SPLIT} AND open_time < {CUT}"))
def range_filter(spark, sf):
    return filters.time_range(candles(spark, sf).select(*OHLCV_COLUMNS), SPLIT, CUT)


@query("last_hours", sql(C1H, f"SELECT {OHLCV} FROM c1h WHERE open_time >= {CUT - 24 * HOUR} AND open_time < {CUT}"))
def last_hours(spark, sf):
    return filters.last_hours(candles(spark, sf).select(*OHLCV_COLUMNS), 24, CUT)


@query("select_symbols", sql(C1H, f"SELECT {OHLCV} FROM c1h WHERE symbol IN ('click', 'view')"))
def select_symbols(spark, sf):
    return filters.select_symbols(candles(spark, sf).select(*OHLCV_COLUMNS), ["click", "view"])


@query(
    "closed_only",
    sql(C1H, TIERS, "SELECT * FROM a WHERE is_closed UNION ALL SELECT * FROM b WHERE is_closed"),
)
def closed_only(spark, sf):
    first, second = tier_pair(spark, sf)
    return filters.closed_only(first.unionByName(second))


@query(
    "to_candles",
    sql(C1H, "SELECT symbol, open_time // 1000 AS time, open, high, low, close, volume FROM c1h"),
)
def to_candles(spark, sf):
    return filters.to_candles(candles(spark, sf), seconds=True)


@query("pack_unpack", sql(C1H, "SELECT * FROM c1h"))
def pack_unpack(spark, sf):
    return filters.unpack_candle(filters.pack_candle(candles(spark, sf))).drop("is_closed")


@query(
    "candle_measures",
    sql(
        C1H,
        """SELECT symbol, open_time, CASE WHEN open <> 0 THEN round((close - open) / open * 100, 6) ELSE 0.0 END AS pct,
        CASE WHEN close >= open THEN 'up' ELSE 'down' END AS direction, round((high + low + close) / 3, 6) AS typical,
        round((high + low + close) / 3 * volume, 6) AS flow FROM c1h""",
    ),
)
def candle_measures(spark, sf):
    return candles(spark, sf).select(
        "symbol",
        "open_time",
        F.round(numeric.pct_change("open", "close"), 6).alias("pct"),
        numeric.direction().alias("direction"),
        F.round(numeric.typical_price(), 6).alias("typical"),
        F.round(numeric.money_flow(), 6).alias("flow"),
    )


@query(
    "compact_text",
    """SELECT o_orderkey, CASE WHEN x >= 1e9 THEN printf('%.2f', x / 1e9) || 'B' WHEN x >= 1e6 THEN printf('%.2f', x / 1e6) || 'M'
    WHEN x >= 1e3 THEN printf('%.1f', x / 1e3) || 'K' ELSE printf('%.2f', x) END AS shown
    FROM (SELECT o_orderkey, o_totalprice * [0.001, 1, 10, 10000][CAST(o_orderkey % 4 AS INT) + 1] + 0.000001 AS x FROM orders)""",
)
def compact_text(spark, sf):
    scale = F.get(F.array(*[F.lit(x) for x in (0.001, 1.0, 10.0, 10000.0)]), F.pmod("o_orderkey", F.lit(4)).cast("int"))
    rows = table(spark, sf, "orders").withColumn("x", F.col("o_totalprice") * scale + 0.000001)
    return rows.select("o_orderkey", numeric.compact_number("x").alias("shown"))


@query(
    "numeric_default",
    """SELECT event_id, coalesce(TRY_CAST(CASE event_id % 3 WHEN 0 THEN CAST(value AS VARCHAR) WHEN 1 THEN 'n/a' END AS DOUBLE), 0) AS number
    FROM events""",
)
def numeric_default(spark, sf):
    which = F.pmod("event_id", F.lit(3))
    raw = F.when(which == 0, F.col("value").cast("string")).when(which == 1, F.lit("n/a"))
    return table(spark, sf, "events").select("event_id", numeric.number(raw).alias("number"))
