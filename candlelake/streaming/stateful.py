"""Streaming operators with their own state per symbol (``transformWithState``).

Aggregation that the built-in operators can do stays with them: Python sees one row per symbol and
window, or the rows of one symbol in one micro-batch, whose size the source limits.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from candlelake.schemas import HEARTBEAT_MS

INDICATOR_FIELDS = (
    "symbol string, timestamp bigint, close double, sma20 double, sma50 double, ema12 double, ema26 double"
)


def _gather(rows: Iterator[pd.DataFrame], *order: str) -> pd.DataFrame:
    """The rows of one symbol in this micro-batch, in event order."""
    parts = list(rows)
    if not parts:
        return pd.DataFrame()
    return pd.concat(parts, ignore_index=True).sort_values(list(order), kind="stable", ignore_index=True)


def _mode(ttl_ms: int | None) -> str:
    """State can only expire by the wall clock. A stream whose state does has no end of its own: see ``streams.drain``."""
    return "None" if ttl_ms is None else "ProcessingTime"


class Indicators(StatefulProcessor):
    """sma20, sma50, ema12 and ema26 of closed candles; keeps the last 50 closes, both averages and the last time.

    A candle at or before the last time was counted already, or came too late to be counted: it changes nothing and
    gives no row.
    """

    PERIODS = (12, 26)
    KEEP = 50

    def __init__(self, scale: int = 8, ttl_ms: int | None = None) -> None:
        self.scale, self.ttl_ms = scale, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.closes = handle.getValueState("closes", "closes array<double>", self.ttl_ms)
        self.averages = handle.getValueState("averages", "ema12 double, ema26 double", self.ttl_ms)
        self.last = handle.getValueState("last", "time bigint", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        pdf = _gather(rows, "open_time").drop_duplicates("open_time")
        if self.last.exists():
            pdf = pdf[pdf["open_time"] > self.last.get()[0]]
        if pdf.empty:
            return
        self.last.update((int(pdf["open_time"].iloc[-1]),))
        before = np.array(self.closes.get()[0] if self.closes.exists() else [], "float64")
        close = pdf["close"].to_numpy("float64")
        closes = np.concatenate((before, close))
        emas = self.averages.get() if self.averages.exists() else (None,) * len(self.PERIODS)
        out = pd.DataFrame({"symbol": key[0], "timestamp": pdf["open_time"].to_numpy("int64"), "close": close})
        for n in (20, 50):
            out[f"sma{n}"] = pd.Series(closes).rolling(n).mean().to_numpy()[len(before) :]
        for n, e in zip(self.PERIODS, emas, strict=True):
            # The average before the batch stands as a first value, from which the recurrence goes on.
            whole = pd.Series(close if e is None else np.concatenate(([e], close)))
            out[f"ema{n}"] = whole.ewm(alpha=2 / (n + 1), adjust=False).mean().to_numpy()[-len(close) :]
        self.closes.update((closes[-self.KEEP :].tolist(),))
        self.averages.update(tuple(float(out[f"ema{n}"].iloc[-1]) for n in self.PERIODS))
        names = [f.split()[0] for f in INDICATOR_FIELDS.split(", ")]
        measures = names[3:]
        out[measures] = out[measures].round(self.scale).astype(object).where(out[measures].notna(), None)
        yield out[names]

    def close(self) -> None:
        pass


def stream_indicators(df: DataFrame, scale: int = 8, ttl_ms: int | None = None) -> DataFrame:
    """Indicators of each closed candle (symbol, open_time, close), in order of time per symbol.

    With ``ttl_ms`` a symbol without candles for that long is forgotten and starts anew.
    """
    return df.select("symbol", "open_time", "close").groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=Indicators(scale, ttl_ms), outputStructType=INDICATOR_FIELDS, outputMode="Append", timeMode=_mode(ttl_ms)
    )


def stream_throttle(
    df: DataFrame, heartbeat_ms: int = HEARTBEAT_MS, ttl_ms: int | None = None, tie: Sequence[str] = ()
) -> DataFrame:
    """The ticks (symbol, event_time, price) that are sent, with the reason: change or heartbeat.

    ``tie`` orders ticks of the same time; without it they are taken in any order. With ``ttl_ms`` a symbol without sent ticks for that long is forgotten; its next tick counts as a change.
    """

    class Throttle(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.sent = handle.getValueState("sent", "price double, time bigint", ttl_ms)

        def handleInputRows(self, key, rows, timerValues):
            pdf = _gather(rows, "event_time", *tie)
            price, time = pdf["price"].to_numpy("float64"), pdf["event_time"].to_numpy("int64")
            known = self.sent.exists()
            last_price, last_time = self.sent.get() if known else (np.nan, 0)
            # The price sent last is always the price before, since every change is sent.
            change = price != np.concatenate(([last_price], price[:-1]))
            change[0] |= not known
            reason = np.where(change, "change", None)
            # Runs of one price; the first may go on from the batch before. Only those of a heartbeat's length are walked.
            begins = np.flatnonzero(np.concatenate(([True], change[1:])))
            ends = np.append(begins[1:], len(price))
            anchors = time[begins]
            if not change[0]:
                anchors[0] = last_time
            for begin, end, anchor in zip(begins, ends, anchors):
                at = begin
                if time[end - 1] - anchor < heartbeat_ms:
                    continue
                while (at := at + np.searchsorted(time[at:end], anchor + heartbeat_ms)) < end:
                    reason[at], anchor = "heartbeat", time[at]
            pdf["reason"] = reason
            out = pdf.loc[pdf["reason"].notna(), ["symbol", "event_time", "price", "reason"]]
            if len(out):
                self.sent.update((float(price[out.index[-1]]), int(time[out.index[-1]])))
            yield out

        def close(self) -> None:
            pass

    return df.select("symbol", "event_time", "price", *tie).groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=Throttle(),
        outputStructType="symbol string, event_time bigint, price double, reason string",
        outputMode="Append",
        timeMode=_mode(ttl_ms),
    )


class LiveCandle(StatefulProcessor):
    """Passes a candle on when it differs from the one sent before."""

    FIELDS = ["open_time", "open", "high", "low", "close", "volume"]

    def __init__(self, ttl_ms: int | None = None, tie: Sequence[str] = ()) -> None:
        self.ttl_ms, self.tie = ttl_ms, tie

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sent = handle.getValueState(
            "sent", "open_time bigint, open double, high double, low double, close double, volume double", self.ttl_ms
        )

    def handleInputRows(self, key, rows, timerValues):
        pdf = _gather(rows, "event_time", *self.tie)
        values = pdf[self.FIELDS].to_numpy("float64")
        before = list(self.sent.get()) if self.sent.exists() else [np.nan] * len(self.FIELDS)
        keep = (values != np.vstack((before, values[:-1]))).any(axis=1)
        self.sent.update((int(values[-1][0]), *values[-1][1:].tolist()))
        yield pdf.loc[keep, ["symbol", "event_time", *self.FIELDS]]

    def close(self) -> None:
        pass


def stream_live_candle(df: DataFrame, ttl_ms: int | None = None, tie: Sequence[str] = ()) -> DataFrame:
    """Changes of the live candle (symbol, event_time and the candle), one row per change.

    ``tie`` orders candles of the same time; without it they are taken in any order. With ``ttl_ms`` a candle that was not updated for that long is forgotten, and sent again when it comes back.
    """
    return df.select("symbol", "event_time", *LiveCandle.FIELDS, *tie).groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=LiveCandle(ttl_ms, tie),
        outputStructType=(
            "symbol string, event_time bigint, open_time bigint, open double, high double, low double, "
            "close double, volume double"
        ),
        outputMode="Append",
        timeMode=_mode(ttl_ms),
    )


# How long ticks count as recent, how long a silent symbol's history stays, how many writes go between
# two trims; and the life of a book, of second candles and of minute candles.
HISTORY_MS = 300_000
HISTORY_TTL_MS = 600_000
TRIM_EVERY = 60
BOOK_TTL_MS = 300_000
CANDLE_TTL_MS = {"1s": 86_400_000, "1m": 7 * 86_400_000}


def _top(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The largest of ``values[first:last]`` for each pair (none empty), from the maxima of runs of 1, 2, 4, ... values."""
    length = last - first
    longest, size, out = length.max(), 1, np.empty(len(first))
    while True:
        # Two runs, from the front and from the back, cover what is less than twice as long.
        own = np.flatnonzero((length >= size) & (length < 2 * size))
        out[own] = np.maximum(values[first[own]], values[last[own] - size])
        if 2 * size > longest:
            return out
        values = np.maximum(values[:-size], values[size:])
        size *= 2


class TickHistory(StatefulProcessor):
    """The recent ticks of a symbol, as a list that grows by each batch and is trimmed now and then.

    An element holds the ticks of a write: the store reads a list again for each element added to it.
    """

    def __init__(self, window_ms: int, ttl_ms: int | None, trim_every: int) -> None:
        self.window_ms, self.ttl_ms, self.trim_every = window_ms, ttl_ms, trim_every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ticks = handle.getListState("ticks", "event_time array<bigint>, price array<double>", self.ttl_ms)
        self.writes = handle.getValueState("writes", "writes bigint", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues):
        new = _gather(rows, "event_time")
        held = list(self.ticks.get()) if self.ticks.exists() else []
        time = np.concatenate([*(np.array(t, "int64") for t, _ in held), new["event_time"].to_numpy("int64")])
        price = np.concatenate([*(np.array(p, "float64") for _, p in held), new["price"].to_numpy("float64")])
        order = np.argsort(time, kind="stable")
        time, price = time[order], price[order]
        own = new["event_time"].to_numpy("int64")
        first, last = np.searchsorted(time, own - self.window_ms), np.searchsorted(time, own, "right")
        top = _top(price, first, last)
        writes = (self.writes.get()[0] if self.writes.exists() else 0) + len(own)
        if writes >= self.trim_every:
            keep = np.searchsorted(time, time[-1] - self.window_ms)
            self.ticks.put([(time[keep:].tolist(), price[keep:].tolist())])
            writes = 0
        else:
            self.ticks.appendValue((own.tolist(), new["price"].astype("float64").tolist()))
        self.writes.update((writes,))
        yield new.assign(held=(last - first).astype("int64"), top=top)[["symbol", "event_time", "price", "held", "top"]]

    def close(self) -> None:
        pass


def stream_history(df: DataFrame, window_ms: int = HISTORY_MS, ttl_ms: int | None = HISTORY_TTL_MS, trim_every: int = TRIM_EVERY) -> DataFrame:
    """Each tick (symbol, event_time, price) with the number of ticks in the ``window_ms`` up to it, and their top price.

    The ticks are held per symbol; those out of the window go at the first write after ``trim_every`` others. A symbol
    that is silent for ``ttl_ms`` by the wall clock leaves state altogether.
    """
    return df.select("symbol", "event_time", "price").groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=TickHistory(window_ms, ttl_ms, trim_every),
        outputStructType="symbol string, event_time bigint, price double, held bigint, top double",
        outputMode="Append",
        timeMode=_mode(ttl_ms),
    )
