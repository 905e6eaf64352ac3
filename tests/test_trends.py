"""The trend machine against a plain loop over all trades, restarts, late order and odd prices."""

from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from compare import assert_same
from pyspark.sql import functions as F

from barloom.plans import streams
from barloom.streaming import trends

START = pd.Timestamp("2024-03-01 10:00:00")
SPANS, LENGTH = (3, 6, 4), 12


def histogram(closes):
    x = pd.Series(closes, dtype=float)
    line = x.ewm(span=SPANS[0]).mean() - x.ewm(span=SPANS[1]).mean()
    return (line - line.ewm(span=SPANS[2]).mean()).iloc[-1]


def replay(rows, candles):
    """Every trade in order of time: (symbol, event_id) -> (histogram, trend); a deque of closes, averaged anew each time."""
    out = {}
    for symbol, group in rows.sort_values(["ts", "event_id"]).groupby("symbol"):
        closes = [c for s, _, c in candles if s == symbol]
        h = histogram(closes) if closes else 0.0
        trend, before = ("UP" if h > 1e-6 else "DOWN" if h < -1e-6 else None), h
        price, edge = (closes[-1] if closes else 0.0), (START + pd.Timedelta("1min") if closes else None)
        for r in group.itertuples():
            if not r.price or r.price != r.price:
                continue
            if edge is None:
                edge = r.ts.floor("min") + pd.Timedelta("1min")
            while edge <= r.ts:
                if price:
                    closes = [*closes, price][-LENGTH:]
                edge += pd.Timedelta("1min")
            closed = histogram(closes) if closes else 0.0
            h = histogram([*closes, r.price])
            zero = lambda x, p: 0.0 if abs(x) <= 1e-9 * p else x
            closed, h = zero(closed, closes[-1] if closes else 1), zero(h, r.price)
            if closed < 0 < h:
                trend = "UP"
            elif closed > 0 > h:
                trend = "DOWN"
            elif trend == "DOWN" and before < 0 < h:
                trend = "UP"
            elif trend == "UP" and before > 0 > h:
                trend = "DOWN"
            before, price = h, r.price
            out[symbol, r.event_id] = (h, trend)
    return out


@pytest.fixture(scope="module")
def ticks():
    rng, n = np.random.default_rng(4), 900
    gaps = rng.choice([0, 200, 4000, 20_000, 200_000, 1_500_000], n, p=[0.1, 0.3, 0.3, 0.2, 0.08, 0.02])
    rows = pd.DataFrame({"symbol": rng.choice(["a", "b", "c"], n), "ts": START + pd.to_timedelta(gaps.cumsum(), "ms"), "event_id": np.arange(n), "price": 100 + rng.normal(0, 1, n).cumsum()})
    rows.loc[rng.choice(n, 20, replace=False), "price"] = 0.0
    rows.loc[rows.index % 97 == 5, "price"] = np.nan
    return rows


CANDLES = [("a", int((START - pd.Timedelta(minutes=LENGTH - 1 - k)).timestamp() * 1000), float(100 + np.sin(k))) for k in range(LENGTH)] + [("b", int(START.timestamp() * 1000), 101.0)]


def written(rows, path):
    out = rows.copy()
    out["ts"] = out["ts"].astype("datetime64[us]")
    out.to_parquet(path, index=False)


def run(spark, folder, out, candles):
    stream = spark.readStream.schema("symbol string, ts timestamp_ntz, event_id long, price double").option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    found = trends.tick_trends(stream, candles, length=LENGTH, spans=SPANS)
    query = found.writeStream.format("parquet").option("path", f"{folder}/{out}").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start()
    query.awaitTermination()


@pytest.mark.parametrize("files", [1, 3])
def test_equals_a_loop_over_all_trades_and_survives_restarts(spark, ticks, tmp_path, files):
    """A restart goes on from the state: files come in one by one, the query ends and starts again between them."""
    (tmp_path / "in").mkdir()
    end = pd.DataFrame([("d", ticks["ts"].max() + pd.Timedelta("10min"), 10_000, 5.0)], columns=ticks.columns)
    candles = spark.createDataFrame(CANDLES, "symbol string, edge long, close double")
    for k, part in enumerate(np.array_split(pd.concat([ticks, end], ignore_index=True), files)):
        written(part.sample(frac=1, random_state=1), tmp_path / f"in/{k}.parquet")
        run(spark, tmp_path, "out", candles)
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    want = replay(ticks, CANDLES)
    assert len(rows) == len(want) and {(r.symbol, r.event_id) for r in rows} == set(want)
    for r in rows:
        h, trend = want[r.symbol, r.event_id]
        assert abs(r.histogram - h) < 1e-6 and r.trend == trend, r
    assert {"UP", "DOWN"} == {r.trend for r in rows if r.symbol == "a"}


def test_signs():
    """A crossover counts from any trend, one within the minute only against a known one; flat prices have no sign."""
    assert trends.turned(None, -1, 0, 1) == "UP" and trends.turned("UP", 1, 1, -1) == "DOWN"
    assert trends.turned("DOWN", 1, -1, 1) == "UP" and trends.turned("UP", -1, 1, -1) == "DOWN"
    assert trends.turned(None, 0, -1, 1) is None and trends.turned("UP", 0, 0, -1) == "UP"
    assert trends.sign(1e-12, 100.0) == 0 and trends.sign(1e-3, 100.0) == 1


def test_stored_closes_are_as_of_their_minutes(spark):
    rows = [("a", datetime(2024, 1, 1, 0, 0, 30), 1, 5.0), ("a", datetime(2024, 1, 1, 0, 2), 2, 6.0)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp_ntz, event_id long, price double")
    found = sorted(trends.minute_closes(df, "2024-01-01 00:03:00", 5).collect())
    base = 1704067200000
    assert [tuple(r) for r in found] == [("a", base + 60_000, 5.0), ("a", base + 120_000, 5.0), ("a", base + 180_000, 6.0)]


@pytest.mark.parametrize("name", ["stream_tick_trends", "stream_trends"])
def test_queries_match_sql(spark, name):
    assert len(assert_same(spark, streams.QUERIES[name], streams.ORACLE[name], "/root/testdata/sf0.01"))


class Held:
    """A processor's handle with states in memory."""

    def __init__(self):
        self.timers, self.states = set(), {}

    def getValueState(self, name, schema):
        return self.states.setdefault(name, Value())

    def getMapState(self, name, key_schema, schema):
        return self.states.setdefault(name, Map())

    def registerTimer(self, at):
        self.timers.add(at)

    def deleteTimer(self, at):
        self.timers.discard(at)


class Value:
    held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, value):
        self.held = value


class Map(dict):
    def containsKey(self, key):
        return key in self

    getValue, removeKey = dict.__getitem__, dict.__delitem__

    def updateValue(self, key, value):
        self[key] = value


class Mark:
    def __init__(self, at):
        self.at = at

    def getCurrentWatermarkInMs(self):
        return self.at


def test_a_large_batch_is_not_held(ticks):
    """Trades of a batch go to the state in pieces, whatever their order, so that memory does not grow with the batch;
    the trades of a minute are put together again."""
    own = ticks[ticks["symbol"] == "c"].sample(frac=1, random_state=2)
    end, found = Mark(int((ticks["ts"].max() + pd.Timedelta("10min")).timestamp() * 1000)), []
    for held in (7, 10_000):
        handle, machine = Held(), trends.TrendProcessor(LENGTH, SPANS, held)
        machine.init(handle)
        sizes = []

        def parts():
            for k in range(0, len(own), 7):
                sizes.append(sum(len(x[0]) for x in handle.states["trades"].values()))
                yield own.iloc[k : k + 7]

        assert list(machine.handleInputRows(("c",), parts(), end)) == []
        assert (sizes[-1] > 200) == (held == 7)  # nearly all are in the state before the last part comes
        assert len(handle.timers) == 1
        found.append(pd.concat(machine.handleExpiredTimer(("c",), end, None)))
        assert not handle.states["trades"]
    pd.testing.assert_frame_equal(*found)
    want = replay(ticks[ticks["symbol"] == "c"], [])
    assert [(r.event_id, r.trend) for r in found[0].itertuples()] == [(i, t) for (_, i), (_, t) in want.items()]
