"""The trend of each symbol at each trade: MACD over the last closed minutes and the trade's own price.

A keyed state holds the closes of the last minutes, the trades of minutes that are still open, and the trend. It starts
from stored candles. An event-time timer closes minutes once the watermark has passed them: their trades are judged in
order of time, whatever the order they came in, then the last price is the minute's close, with trades or without.

Averages are kept as numerator and denominator. Over closed minutes they are sums with fixed weights, as every average
begins at the oldest close that is kept; a trade moves each by one step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

from barloom.operators.align import last_before

MINUTE = 60_000
FAST, SLOW, SIGNAL = 12, 26, 9
#: A histogram within this share of the price counts as 0: prices that don't move leave rounding errors of either sign.
FLAT = 1e-9
#: Rows of a batch that leaves a state, and rows of a symbol that are held before they go to its state.
ROWS, HELD = 10_000, 1_000_000


@lru_cache(maxsize=64)
def weights(n: int, fast: int, slow: int, signal: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What each of n closes, oldest first, adds to the numerators of the fast, the slow and the signal average."""
    j = np.arange(n)
    q = [1 - 2 / (span + 1) for span in (fast, slow, signal)]
    age = j[:, None] - j[None, :]
    line = sum(sign * np.where(age >= 0, p ** np.maximum(age, 0), 0) / ((1 - p ** (j + 1)) / (1 - p))[:, None] for sign, p in ((1, q[0]), (-1, q[1])))
    return q[0] ** (n - 1 - j), q[1] ** (n - 1 - j), q[2] ** (n - 1 - j) @ line


@dataclass
class Averages:
    """Numerators over n closes; their denominators follow from n."""

    n: int
    tops: tuple[float, float, float]
    spans: tuple[int, int, int]

    @classmethod
    def of(cls, closes: list[float], spans: tuple[int, int, int]) -> Averages:
        x = np.asarray(closes, float)
        return cls(len(x), tuple(float(w @ x) for w in weights(len(x), *spans)), spans)

    def bottom(self, k: int, n: int) -> float:
        q = 1 - 2 / (self.spans[k] + 1)
        return (1 - q**n) / (1 - q)

    def histogram(self) -> float:
        """Line minus signal at the last close; 0 without closes."""
        if not self.n:
            return 0.0
        line = self.tops[0] / self.bottom(0, self.n) - self.tops[1] / self.bottom(1, self.n)
        return line - self.tops[2] / self.bottom(2, self.n)

    def histogram_with(self, price: float) -> float:
        """The histogram if price were one more close, in a fixed number of steps."""
        q = [1 - 2 / (span + 1) for span in self.spans]
        line = (self.tops[0] * q[0] + price) / self.bottom(0, self.n + 1) - (self.tops[1] * q[1] + price) / self.bottom(1, self.n + 1)
        return line - (self.tops[2] * q[2] + line) / self.bottom(2, self.n + 1)


def sign(histogram: float, price: float) -> int:
    return 0 if abs(histogram) <= FLAT * abs(price) else 1 if histogram > 0 else -1


def turned(trend: str | None, closed: int, before: int, now: int) -> str | None:
    """The trend after a trade, by the signs of the histogram at the last closed minute, the last trade and this one:
    a crossover against the closed minute, else one within the minute against the known trend."""
    if closed * now < 0:
        return "UP" if now > 0 else "DOWN"
    if trend is not None and before * now < 0 and trend != (to := "UP" if now > 0 else "DOWN"):
        return to
    return trend


class TrendProcessor(StatefulProcessor):
    """State of a symbol: bars (closes, last price, histogram of the last trade, trend, end of the open minute in ms) and
    trades by minute and piece. A batch of any size is held as arrays of `held` rows, each a new piece of its minutes, so
    that none is read to be added to. One timer a symbol, at the end of its open minute."""

    def __init__(self, length: int, spans: tuple[int, int, int], held: int = HELD):
        self.length, self.spans, self.held = length, spans, held

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.bars = handle.getValueState("bars", "closes array<double>, price double, before int, trend string, edge long")
        self.pieces = handle.getValueState("pieces", "n long")
        self.trades = handle.getMapState("trades", "minute long, piece long", "ts array<long>, event_id array<long>, price array<double>")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues: TimerValues) -> None:
        first = initialState.sort_values("edge")
        closes = first["close"].tolist()[-self.length :]
        edge = int(first["edge"].iloc[-1]) + MINUTE
        now = sign(Averages.of(closes, self.spans).histogram(), closes[-1])
        self.bars.update((closes, closes[-1], now, "UP" if now > 0 else "DOWN" if now < 0 else None, edge))
        self.handle.registerTimer(edge)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        parts, size = [], 0
        for part in rows:
            ms, price = part["ts"].to_numpy("datetime64[ms]").astype(np.int64), part["price"].to_numpy(np.float64)
            there = (price == price) & (price != 0)
            parts.append((ms[there], part["event_id"].to_numpy(np.int64)[there], price[there]))
            size += len(parts[-1][0])
            if size >= self.held:
                self._keep(parts)
                parts, size = [], 0
        if size:
            self._keep(parts)
        return iter(())

    def _keep(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """Adds trades (ms, event_id, price) to the state, a piece a minute."""
        ts, ids, prices = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(ts, kind="stable")
        ts, ids, prices = ts[order], ids[order], prices[order]
        minutes = ts - ts % MINUTE
        price, edge = (self.bars.get()[1], self.bars.get()[4]) if self.bars.exists() else (0.0, None)
        begin = int(minutes[0])
        if not price and (edge is None or begin + MINUTE < edge):  # nothing is judged yet: begin with the first trade
            if edge is not None:
                self.handle.deleteTimer(edge)
            edge = begin + MINUTE
            self.bars.update(([], 0.0, 0, None, edge))
            self.handle.registerTimer(edge)
        piece = self.pieces.get()[0] if self.pieces.exists() else 0
        self.pieces.update((piece + 1,))
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(minutes)) + 1, [len(minutes)]]).tolist()
        for a, b in zip(cuts, cuts[1:]):
            if minutes[a] + MINUTE >= edge:  # else it is before the state's first candle
                self.trades.updateValue((int(minutes[a]), piece), (ts[a:b].tolist(), ids[a:b].tolist(), prices[a:b].tolist()))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        closes, price, before, trend, edge = self.bars.get()
        closes, until, out = list(closes), timerValues.getCurrentWatermarkInMs(), []
        keys = np.fromiter(((m, k) for m, k in self.trades.keys()), np.dtype((np.int64, 2)))
        keys = keys[keys[:, 0] + MINUTE <= until]
        keys = keys[np.lexsort((keys[:, 1], keys[:, 0]))]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(keys[:, 0])) + 1, [len(keys)]]).tolist() if len(keys) else []
        for a, b in zip(cuts, cuts[1:]):
            minute = int(keys[a, 0])
            closes = self._idle(closes, price, (minute + MINUTE - edge) // MINUTE)
            closed = Averages.of(closes, self.spans)
            last = sign(closed.histogram(), closes[-1]) if closes else 0
            pieces = [(minute, k) for k in keys[a:b, 1].tolist()]
            for t, i, price in sorted(row for at in pieces for row in zip(*self.trades.getValue(at))):
                histogram = closed.histogram_with(price)
                now = sign(histogram, price)
                trend, before = turned(trend, last, before, now), now
                out.append((key[0], t, i, price, histogram, trend))
            for at in pieces:
                self.trades.removeKey(at)
            closes, edge = self._idle(closes, price, 1), minute + 2 * MINUTE
            if len(out) >= ROWS:
                yield self._frame(out)
                out = []
        idle = max(0, (until - edge) // MINUTE + 1)
        closes, edge = self._idle(closes, price, idle), edge + idle * MINUTE
        self.bars.update((closes, price, before, trend, edge))
        self.handle.registerTimer(edge)
        if out:
            yield self._frame(out)

    def _idle(self, closes: list[float], price: float, minutes: int) -> list[float]:
        """Minutes that end at the last price; none before there is one."""
        return closes if not price else (closes + [price] * min(minutes, self.length))[-self.length :]

    def _frame(self, rows: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=["symbol", "ts", "event_id", "price", "histogram", "trend"])
        out["ts"] = pd.to_datetime(out["ts"], unit="ms")
        return out

    def close(self) -> None:
        pass


TREND = "symbol string, ts timestamp, event_id long, price double, histogram double, trend string"


def minute_closes(trades: DataFrame, at: str, length: int = 60) -> DataFrame:
    """(symbol, edge, close): the closes of the `length` minutes before the time `at`, each the last price before the
    minute's end, edge in ms; minutes before a symbol's first trade have none, trades
    without a price count for nothing."""
    spans = F.explode(F.sequence(F.lit(length - 1), F.lit(0))).alias("k")
    edges = trades.select("symbol").distinct().select("symbol", spans)
    edges = edges.select("symbol", (F.lit(at).cast("timestamp") - F.make_dt_interval(mins=F.col("k"))).cast("timestamp_ntz").alias("boundary"))
    ticks = trades.filter((F.col("price") != 0) & ~F.isnan("price")).select("symbol", F.col("ts").cast("timestamp_ntz").alias("ts"), "event_id", "price")
    found = last_before(ticks, edges).filter("price IS NOT NULL")
    return found.select("symbol", F.unix_millis(F.col("boundary").cast("timestamp")).alias("edge"), F.col("price").alias("close"))


def tick_trends(trades: DataFrame, candles: DataFrame | None = None, late: str = "1 minute", length: int = 60, spans: tuple[int, int, int] = (FAST, SLOW, SIGNAL), held: int = HELD) -> DataFrame:
    """(symbol, ts, event_id, price, histogram, trend) of each trade of a stream (symbol, ts, event_id, price), once its
    minute and `late` have passed; times in milliseconds.

    candles (symbol, edge, close) are stored closes to begin with, one a minute, edge its end in ms: the last `length`
    count, and the first trend is the sign of their histogram (none if it is 0). A symbol without candles begins with
    its first trade and has no trend until a crossover. A trade turns the trend UP (DOWN) if the histogram with its
    price is positive (negative) and that of the closed minutes was not, or if the last trade's was not and the trend is
    DOWN (UP). Trades with a price of 0, null or NaN count for nothing; trades of one millisecond go by event_id; trades
    later than the watermark are lost, as in all streams. At most `held` rows and one output batch of a symbol are in
    memory at a time.
    """
    spark = trades.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    known = trades.filter(F.col("price").isNotNull() & F.col("symbol").isNotNull()).withWatermark("ts", late)
    start = None if candles is None else candles.select("symbol", "edge", "close").groupBy("symbol")
    return known.groupBy("symbol").transformWithStateInPandas(TrendProcessor(length, spans, held), TREND, "Append", "EventTime", initialState=start)


def trend_changes(ticks: DataFrame) -> DataFrame:
    """The rows of tick_trends, read as a table, at which a symbol's trend is another than before."""
    from pyspark.sql.window import Window

    before = F.lag("trend").over(Window.partitionBy("symbol").orderBy("ts", "event_id"))
    return ticks.withColumn("before", before).filter(~F.col("trend").eqNullSafe(F.col("before"))).drop("before")
