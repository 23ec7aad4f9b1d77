"""Operators over raw ticks: sides, throttling, recent ticks and as-of quotes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from candlelake.functions.numeric import number
from candlelake.operators.series import (
    CHUNK,
    TICK_CHUNK_MS,
    chunk_scan,
    chunk_window,
    chunked,
    last_n,
    running_max,
    with_previous,
)
from candlelake.schemas import DAY_MS, HEARTBEAT_MS


def parse_tick_member(df: DataFrame, member: str = "member") -> DataFrame:
    """Split ``price:volume``; a missing volume is 0."""
    parts = F.split(member, ":")
    return df.withColumns(
        {"price": number(F.get(parts, F.lit(0)), strict=True), "volume": number(F.get(parts, F.lit(1)))}
    ).drop(member)


def tick_side(
    df: DataFrame,
    mode: str = "newest_first",
    order: Sequence[str] = ("event_time",),
    width_ms: int = TICK_CHUNK_MS,
) -> DataFrame:
    """Add ``side``: buy where the price is at or above its neighbour's, or has no neighbour.

    The neighbour is the next newer tick by default (a list read newest first), the previous one with
    ``mode="tick_rule"``.
    """
    if mode not in ("newest_first", "tick_rule"):
        raise ValueError(f"unknown mode {mode!r}")
    rows = with_previous(df, ["symbol"], order, width_ms, ahead=mode == "newest_first", _other="price")
    buy = F.col("_other").isNull() | (F.col("price") >= F.col("_other"))
    return rows.withColumn("side", F.when(buy, F.lit("buy")).otherwise("sell")).drop("_other")


def tick_history(df: DataFrame) -> DataFrame:
    """One row per (symbol, price, volume), at its newest time."""
    return df.groupBy("symbol", "price", "volume").agg(F.max("event_time").alias("event_time"))


def recent_ticks(df: DataFrame, n: int, mode: str = "newest_first", width_ms: int = DAY_MS) -> DataFrame:
    """The newest ``n`` distinct ticks of each symbol, with their side."""
    order = ["event_time", "price", "volume"]
    newest = last_n(tick_history(df), n, ["symbol"], order, width_ms)
    return tick_side(newest, mode, order, width_ms).select("symbol", "event_time", "price", "volume", "side")


def asof_quote(
    trades: DataFrame,
    quotes: DataFrame,
    values: Sequence[str],
    tolerance_ms: int | None = None,
    time: str = "event_time",
    width_ms: int = TICK_CHUNK_MS,
    tie: Sequence[str] = (),
) -> DataFrame:
    """Each trade with the newest quote of its symbol at or before it.

    Trades and quotes are put in one series and the last quote is carried forward inside each time
    chunk. What an earlier chunk hands on is one quote, filled over chunk summaries, so neither side is
    ever gathered per symbol. ``tie`` orders quotes of the same time.
    """
    quote_row = F.struct(F.col(time).alias("quote_time"), *values)
    quote_kind = chunked(quotes, [time], width_ms)
    trade_kind = chunked(trades, [time], width_ms)
    last = quote_kind.groupBy("symbol", CHUNK).agg(F.max_by(quote_row, F.struct(time, *tie)).alias("_quote"))
    asked = trade_kind.select("symbol", CHUNK).distinct().withColumn("_asked", F.lit(True))
    carry = (
        last.join(asked, ["symbol", CHUNK], "full")
        .withColumn("_carry", F.last("_quote", ignorenulls=True).over(chunk_scan(["symbol"]).rowsBetween(Window.unboundedPreceding, -1)))
        .where(F.col("_asked") & F.col("_carry").isNotNull())
        .select("symbol", CHUNK, F.col("_carry.quote_time").alias(time), F.col("_carry").alias("_quote"))
    )
    ranked = quotes.select(F.struct(*[F.col(c) for c in tie] or [F.lit(0).alias("none")]).alias("t"))
    no_tie = F.lit(None).cast(ranked.schema["t"].dataType)
    order_in = F.struct(*[F.col(c) for c in tie] or [F.lit(0).alias("none")]).cast(ranked.schema["t"].dataType)
    kind = ["symbol", CHUNK, time]
    events = (
        trade_kind.select(*kind, F.struct(*trades.columns).alias("_trade"), no_tie.alias("_tie"))
        .withColumns({"_quote": F.lit(None).cast(last.schema["_quote"].dataType), "_last": F.lit(1)})
        .unionByName(
            quote_kind.select(*kind, quote_row.alias("_quote"), order_in.alias("_tie"), F.lit(0).alias("_last")),
            allowMissingColumns=True,
        )
        .unionByName(
            carry.withColumns({"_tie": no_tie, "_last": F.lit(0)}), allowMissingColumns=True
        )
    )
    filled = events.withColumn(
        "_quote",
        F.last("_quote", ignorenulls=True).over(
            chunk_window(["symbol"], [time, "_last", "_tie"]).rowsBetween(Window.unboundedPreceding, 0)
        ),
    ).where(F.col("_trade").isNotNull())
    if tolerance_ms is not None:
        fresh = F.col("_quote.quote_time") >= F.col(time) - tolerance_ms
        filled = filled.withColumn("_quote", F.when(fresh, F.col("_quote")))
    return filled.select("_trade.*", "_quote.*")


# --- throttle --------------------------------------------------------------------------------------


def throttle(
    df: DataFrame, heartbeat_ms: int = HEARTBEAT_MS, order: Sequence[str] = ("event_time",), width_ms: int = TICK_CHUNK_MS
) -> DataFrame:
    """Add ``reason``: change, heartbeat or skipped.

    A tick is sent when its price differs from the previous one, or when a heartbeat has passed since
    the last tick *sent*. A change is always sent, and a tick within one heartbeat of the last change is
    always skipped; window functions settle both. Only ticks later in a run of one price depend on the
    heartbeats before them, see ``_heartbeats``. Of ticks of one time, the first is the heartbeat.
    """
    time = order[0]
    keyed = with_previous(df, ["symbol"], order, width_ms, _before="price")
    changed = F.col("_before").isNull() | (F.col("_before") != F.col("price"))
    marked = keyed.withColumn("_mark", F.when(changed, F.col(time))).drop("_before")
    runs = running_max(marked, ["symbol"], order, "_mark", width_ms, "_since").withColumn("_run", F.coalesce("_mark", "_since"))
    late = runs.where(F.col("_mark").isNull() & (F.col(time) - F.col("_run") >= heartbeat_ms))
    moment = ["symbol", "_run", time]
    beats = _heartbeats(late.select(*moment), heartbeat_ms, time, width_ms)
    told = runs.join(beats, moment, "left").withColumn("_copy", F.row_number().over(Window.partitionBy(*moment).orderBy(*order)))
    reason = F.when(F.col("_mark").isNotNull(), "change").when(F.col("_beat") & (F.col("_copy") == 1), "heartbeat").otherwise("skipped")
    return told.select(*df.columns, reason.alias("reason"))


def _heartbeats(late: DataFrame, heartbeat_ms: int, time: str, width_ms: int) -> DataFrame:
    """The times, among those of ``late``, at which the runs of one price send: symbol, _run, time, _beat.

    ``late`` has the times of a run from one heartbeat after its start, ``_run``. Every time points to
    its successor, the first time a heartbeat later. A time chunk of a run is an array of these pointers;
    the times sent are those on the path from the last time sent before the chunk, which doubling the
    pointers finds in as many steps as the length of the path has binary digits.
    """
    key = ["symbol", "_run", CHUNK]
    ahead = chunk_window(["symbol", "_run"], [time]).rangeBetween(Window.unboundedPreceding, heartbeat_ms - 1)
    times = chunked(late, [time], width_ms).distinct().withColumn("_next", F.count(F.lit(1)).over(ahead).cast("int"))
    chunks = times.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col(time).alias("t"), F.col("_next").alias("next")))).alias("_ticks"))
    # A path has at most as many times as heartbeats fit into a chunk.
    longest = F.least(F.size("_ticks"), F.lit((width_ms - 1) // heartbeat_ms + 1))
    rounds = F.sequence(F.lit(0), F.ceil(F.log2(longest)).cast("int"))
    begun = chunks.join(_chunk_starts(chunks, rounds, heartbeat_ms), key, "left")
    due = F.coalesce("_sent", "_run") + heartbeat_ms
    begin = F.size(F.filter("_ticks", lambda x: x["t"] < due))

    def further(path: Column, jump: Column) -> Column:
        longer = F.concat(path, F.transform(path, lambda i: F.get(jump, i)))
        return F.filter(longer, lambda i: i < F.size("_ticks"))

    path = F.aggregate(
        rounds,
        F.struct(F.array(begin).alias("path"), F.col("_ticks.next").alias("jump")),
        lambda at, _: F.struct(further(at["path"], at["jump"]).alias("path"), _doubled(at["jump"]).alias("jump")),
        lambda at: F.transform(at["path"], lambda i: F.get("_ticks", i)["t"]),
    )
    return begun.select("symbol", "_run", F.explode(path).alias(time), F.lit(True).alias("_beat"))


def _doubled(jump: Column) -> Column:
    """Pointers of twice the length; those beyond the end of the array are null."""
    return F.transform(jump, lambda i: F.get(jump, i))


def _chunk_starts(chunks: DataFrame, rounds: Column, heartbeat_ms: int) -> DataFrame:
    """For runs over several chunks: the last time sent before each chunk, as ``_sent``.

    Each chunk reports, for every time that could be its first heartbeat, which time it would then send
    last; these candidates lie within one heartbeat of the chunk's first time. Following the reports of
    a run from chunk to chunk gives every start, without a look at the times again.
    """
    run = ["symbol", "_run"]
    long = chunks.groupBy(*run).agg(F.count(F.lit(1)).alias("_chunks")).where("_chunks > 1").select(*run)
    # The last time of a path points to itself.
    own = F.transform("_ticks", lambda x, i: F.when(x["next"] < F.size("_ticks"), x["next"]).otherwise(i))
    last = F.aggregate(rounds, own, lambda at, _: _doubled(at), lambda at: F.transform(at, lambda i: F.get("_ticks", i)["t"]))
    near = F.size(F.filter("_ticks", lambda x: x["t"] < F.get("_ticks", F.lit(0))["t"] + heartbeat_ms))
    reports = (
        chunks.join(long, run, "left_semi")
        .select(*run, CHUNK, F.col("_ticks.t").alias("first"), last.alias("last"), (near + 1).alias("_near"))
        .select(*run, F.struct(CHUNK, F.slice(F.arrays_zip("first", "last"), F.lit(1), F.col("_near")).alias("ways")).alias("_report"))
    )

    def follow(at: Column, report: Column) -> Column:
        way = F.get(F.filter(report["ways"], lambda x: x["first"] >= at["sent"] + heartbeat_ms), F.lit(0))
        here = F.struct(report[CHUNK].alias(CHUNK), at["sent"].alias("_sent"))
        return F.struct(F.coalesce(way["last"], at["sent"]).alias("sent"), F.concat(at["starts"], F.array(here)).alias("starts"))

    none = F.array().cast(f"array<struct<{CHUNK}:bigint,_sent:bigint>>")
    followed = reports.groupBy(*run).agg(F.array_sort(F.collect_list("_report")).alias("_reports"))
    starts = F.aggregate("_reports", F.struct(F.col("_run").alias("sent"), none.alias("starts")), follow, lambda at: at["starts"])
    return followed.select(*run, F.inline(starts))


def throttle_summary(df: DataFrame) -> DataFrame:
    """Ticks per symbol and reason."""
    return df.groupBy("symbol", "reason").agg(F.count(F.lit(1)).alias("ticks"))
