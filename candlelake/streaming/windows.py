"""Windowed candles that a silent stream still emits: open windows in state, closed by event time or by a timer.

A window closes when its symbol's own event time has passed its end by ``delay_ms``, or when a processing-time timer
finds the symbol silent. The timer stands ``idle_ms`` after the newest open window got its first row, and is put off
while rows still come: it never fires within ``quiet_ms`` of the last one. A window is emitted once; rows that come
after that are dropped and counted in state. In a live feed of seconds, a minute is out 65 s after its start at the
latest; in a replay, where windows pass much faster, event time closes all but the last of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from candlelake.schemas import interval_millis

# A window's longest life after its first row, and how late a row may come.
IDLE_MS = 65_000
QUIET_MS = 5_000
ROLLUP_DELAY_MS = 120_000
TRADE_DELAY_MS = 60_000

ROLLUP_FIELDS = (
    "symbol string, kline_start bigint, kline_close bigint, interval string, open double, high double, low double, "
    "close double, volume double, quote_volume double, trade_count bigint, is_closed boolean"
)
CANDLE_FIELDS = (
    "symbol string, open double, high double, low double, close double, volume double, trade_count bigint, open_time bigint"
)


def field_names(ddl: str) -> list[str]:
    return [f.split()[0] for f in ddl.split(", ")]


class OpenWindows(StatefulProcessor):
    """Keeps the pieces of the open windows of one symbol; a subclass says what a piece is.

    ``PIECES`` names the columns of a piece with their types; ``time`` among them is the piece's place in time. The
    pieces of one symbol are one value in state: a window holds few of them, and one read and write serves a batch.
    """

    PIECES: dict[str, str] = {}

    def __init__(self, width: int, delay_ms: int, idle_ms: int, quiet_ms: int) -> None:
        self.width, self.delay_ms, self.idle_ms, self.quiet_ms = width, delay_ms, idle_ms, quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pieces = handle.getValueState("pieces", ", ".join(f"{c} array<{t}>" for c, t in self.PIECES.items()))
        # Newest event time, end of the last emitted window, rows that came too late, the timer that stands, and when
        # (by the wall clock) the newest open window got its first row.
        self.clock = handle.getValueState("clock", "newest bigint, upto bigint, late bigint, timer bigint, opened bigint")
        self.carried = handle.getValueState("carried", "close double")

    def reduce(self, pdf: pd.DataFrame) -> pd.DataFrame:
        """One row per piece, from new rows and pieces that are held already."""
        raise NotImplementedError

    def finish(self, pdf: pd.DataFrame, before: float | None) -> tuple[pd.DataFrame, float | None]:
        """Candles of whole windows, in order, and the close that the next window carries in."""
        raise NotImplementedError

    def _emit(self, symbol: str, pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if pdf.empty:
            return
        before = self.carried.get()[0] if self.carried.exists() else None
        out, after = self.finish(pdf.sort_values("time", kind="stable", ignore_index=True), before)
        if after is not None:
            self.carried.update((after,))
        yield out.assign(symbol=symbol)

    def _held(self) -> pd.DataFrame | None:
        return pd.DataFrame(dict(zip(self.PIECES, self.pieces.get(), strict=True))) if self.pieces.exists() else None

    def handleInputRows(self, key, rows, timerValues):
        new = pd.concat(list(rows), ignore_index=True)
        newest, upto, late, timer, opened = self.clock.get() if self.clock.exists() else (None, None, 0, None, None)
        if upto is not None:
            in_time = new["time"] >= upto
            late, new = late + int((~in_time).sum()), new[in_time]
        if new.empty:
            self.clock.update((newest, upto, late, timer, opened))
            return
        now = timerValues.getCurrentProcessingTimeInMs()
        before, newest = newest, int(new["time"].max()) if newest is None else max(int(new["time"].max()), newest)
        if before is None or before // self.width < newest // self.width or opened is None:
            opened = now
        held = self._held()
        pieces = self.reduce(new if held is None else pd.concat([held, new[list(self.PIECES)]], ignore_index=True))
        end = pieces["time"] - pieces["time"] % self.width + self.width
        closed = end + self.delay_ms <= newest
        if closed.any():
            upto = int(end[closed].max())
        left = pieces[~closed]
        if timer is not None:
            self.handle.deleteTimer(timer)
        timer = None
        if left.empty:
            self.pieces.clear()
        else:
            self.pieces.update(tuple(left[c].tolist() for c in self.PIECES))
            timer = max(opened + self.idle_ms, now + self.quiet_ms)
            self.handle.registerTimer(timer)
        self.clock.update((newest, upto, late, timer, opened if timer else None))
        yield from self._emit(key[0], pieces[closed])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = self._held()
        if held is None:
            return
        newest, upto, late, _, _ = self.clock.get()
        self.pieces.clear()
        end = int((held["time"] - held["time"] % self.width).max()) + self.width
        self.clock.update((newest, end if upto is None else max(upto, end), late, None, None))
        yield from self._emit(key[0], held)

    def close(self) -> None:
        pass


class StepRollup(OpenWindows):
    """Pieces are steps, the last copy of each; a window whose first step is missing opens at the close before it."""

    PIECES = {"time": "bigint", "arrival": "bigint", "open": "double", "high": "double", "low": "double", "close": "double", "volume": "double", "quote_volume": "double", "trade_count": "bigint"}

    def reduce(self, pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.sort_values(["time", "arrival"], kind="stable").drop_duplicates("time", keep="last")

    def finish(self, pdf: pd.DataFrame, before: float | None) -> tuple[pd.DataFrame, float | None]:
        start = pdf["time"] - pdf["time"] % self.width
        bars = pdf.groupby(start.rename("kline_start"), sort=True).agg(
            first=("time", "first"), open=("open", "first"), first_close=("close", "first"), high=("high", "max"), low=("low", "min"),
            close=("close", "last"), volume=("volume", "sum"), quote_volume=("quote_volume", "sum"), trade_count=("trade_count", "sum"),
        ).reset_index()
        seed = bars["close"].shift()
        if before is not None:
            seed.iloc[0] = before
        seed = seed.fillna(bars["first_close"])
        missing = bars["first"] > bars["kline_start"]
        bars["open"] = np.where(missing, seed, bars["open"])
        bars["high"] = np.where(missing, np.maximum(bars["high"], seed), bars["high"])
        bars["low"] = np.where(missing, np.minimum(bars["low"], seed), bars["low"])
        bars[["volume", "quote_volume"]] = bars[["volume", "quote_volume"]].round(8)
        out = bars.assign(symbol="", kline_close=bars["kline_start"] + self.width - 1, interval=self.name, is_closed=True)
        return out[field_names(ROLLUP_FIELDS)], float(bars["close"].iloc[-1])

    name = ""


class TradeCandles(OpenWindows):
    """Pieces are windows so far: first and last trade by (time, tie), extremes and sums."""

    PIECES = {"time": "bigint", "tie": "bigint", "open": "double", "last_time": "bigint", "last_tie": "bigint", "close": "double", "high": "double", "low": "double", "volume": "double", "trade_count": "bigint"}

    def reduce(self, pdf: pd.DataFrame) -> pd.DataFrame:
        ordered = pdf.sort_values(["time", "tie"], kind="stable")
        first = ordered.groupby(ordered["time"] // self.width, sort=True).agg(
            time=("time", "first"), tie=("tie", "first"), open=("open", "first"), high=("high", "max"), low=("low", "min"), volume=("volume", "sum"), trade_count=("trade_count", "sum"),
        )
        ordered = pdf.sort_values(["last_time", "last_tie"], kind="stable")
        last = ordered.groupby(ordered["time"] // self.width, sort=True).agg(last_time=("last_time", "last"), last_tie=("last_tie", "last"), close=("close", "last"))
        return first.join(last).reset_index(drop=True)[list(self.PIECES)]

    def finish(self, pdf: pd.DataFrame, before: float | None) -> tuple[pd.DataFrame, float | None]:
        out = pdf.assign(symbol="", open_time=pdf["time"] - pdf["time"] % self.width, volume=pdf["volume"].round(8))
        return out[field_names(CANDLE_FIELDS)], None


def _windows(df: DataFrame, processor: OpenWindows, fields: str) -> DataFrame:
    return df.groupBy("symbol").transformWithStateInPandas(statefulProcessor=processor, outputStructType=fields, outputMode="Append", timeMode="ProcessingTime")


def stream_rollup(
    df: DataFrame, step: str = "1s", span: str = "1m", arrival: str = "event_time", delay_ms: int = ROLLUP_DELAY_MS, idle_ms: int = IDLE_MS, quiet_ms: int = QUIET_MS
) -> DataFrame:
    """Closed ``span`` candles from a stream of ``step`` candles: the streaming form of ``rollup``.

    Of copies of a step the one with the highest ``arrival`` counts. Late copies inside ``delay_ms`` are included. A
    symbol that falls silent gets its open windows by timer, see above.
    """
    if interval_millis(span) % interval_millis(step):
        raise ValueError(f"{span} is not a multiple of {step}")
    measures = ["open", "high", "low", "close", "volume", "quote_volume", "trade_count"]
    rows = df.selectExpr("symbol", "open_time AS time", f"CAST({arrival} AS BIGINT) AS arrival", *measures)
    processor = StepRollup(interval_millis(span), delay_ms, idle_ms, quiet_ms)
    processor.name = span
    return _windows(rows, processor, ROLLUP_FIELDS)


def stream_candles(
    trades: DataFrame, interval: str, time: str = "trade_time", tie: Sequence[str] = ("agg_trade_id",), delay_ms: int = TRADE_DELAY_MS, idle_ms: int = IDLE_MS, quiet_ms: int = QUIET_MS
) -> DataFrame:
    """Candles of an interval from a stream of trades; a symbol that falls silent gets its open windows by timer.

    ``tie`` names at most one integer column. State holds one piece per open window. Where every symbol keeps trading,
    ``streams.stream_candles`` does the same by watermark alone, without Python.
    """
    order = tie[0] if tie else "0"
    rows = trades.selectExpr(
        "symbol", f"CAST({time} AS BIGINT) AS time", f"CAST({order} AS BIGINT) AS tie", "price AS open", f"CAST({time} AS BIGINT) AS last_time",
        f"CAST({order} AS BIGINT) AS last_tie", "price AS close", "price AS high", "price AS low", "quantity AS volume", "1L AS trade_count",
    )
    return _windows(rows, TradeCandles(interval_millis(interval), delay_ms, idle_ms, quiet_ms), CANDLE_FIELDS)
