"""Two-level scans and as-of joins against the single-level ones and plain loops, with buckets of a few rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.functions import longseries
from barloom.functions.recursive import ema
from barloom.operators.align import last_before

WANTED = {"w": ("weighted", "close", 9), "f": ("first", "close", 12), "s": ("sma", "close", 5), "r": ("wilder", "close", 14), "slow": ("first", "close", 400)}


@pytest.fixture(scope="module")
def bars(spark):
    rng, out = np.random.default_rng(8), []
    for symbol, n in (("a", 1500), ("b", 7), ("c", 1), ("d", 300)):
        gaps = rng.choice([1, 60, 5000], n, p=[0.6, 0.35, 0.05]).cumsum()  # bursts: buckets are uneven
        close = 100 + rng.normal(0, 1, n).cumsum()
        out.append(pd.DataFrame({"symbol": symbol, "interval": "x", "timestamp": (pd.Timestamp("2024-01-01") + pd.to_timedelta(gaps, "s")).astype("datetime64[us]"), "close": close}))
    return spark.createDataFrame(pd.concat(out))


@pytest.mark.parametrize("rows", [3, 40, 100_000])
def test_averages_equal_those_of_whole_series(bars, rows):
    keys = ["symbol", "timestamp"]
    found = longseries.ema_long(bars, WANTED, rows=rows).toPandas().sort_values(keys).reset_index(drop=True)
    want = ema(bars, WANTED).toPandas().sort_values(keys).reset_index(drop=True)
    assert list(found.columns) == list(want.columns) or set(found.columns) == set(want.columns)
    for name in WANTED:
        assert np.allclose(found[name].astype(float), want[name].astype(float), rtol=1e-9, equal_nan=True), name


def test_leading_nulls_and_empty_tables(bars):
    holes = bars.withColumn("close", F.when(F.col("timestamp") > "2024-01-01 02:00:00", F.col("close")))
    wanted = {"w": WANTED["w"]}
    keys = ["symbol", "timestamp"]
    found, want = (x.toPandas().sort_values(keys)["w"].to_numpy(float) for x in (longseries.ema_long(holes, wanted, rows=20), ema(holes, wanted)))
    assert np.allclose(found, want, equal_nan=True) and np.isnan(want).any()
    assert longseries.ema_long(bars.limit(0), wanted).count() == 0


@pytest.mark.parametrize("rows", [15, 100_000])
def test_appending_with_a_state_equals_one_run(spark, bars, rows):
    """Series in several parts, one of a few rows, one series that begins late and one that ends early."""
    keys = ["symbol", "timestamp"]
    edges = ["2024-01-01 00:00:04", "2024-01-01 01:00:00", "2024-01-02 00:00:00", "2100-01-01"]
    before, state, out = "1970-01-01", None, []
    for edge in edges:
        part = bars.filter((F.col("timestamp") > before) & (F.col("timestamp") <= edge) & ((F.col("symbol") != "d") | (F.col("timestamp") > edges[0])))
        out.append(longseries.ema_long(part, WANTED, rows=rows, state=state).toPandas())
        state = spark.createDataFrame(longseries.ema_state(part, WANTED, rows=rows, state=state).toPandas())
        before = edge
    found = pd.concat(out).sort_values(keys).reset_index(drop=True)
    whole = bars.filter((F.col("symbol") != "d") | (F.col("timestamp") > edges[0]))
    want = ema(whole, WANTED).toPandas().sort_values(keys).reset_index(drop=True)
    assert len(found) == len(want) and sum(map(len, out[:2])) > 20
    for name in WANTED:
        assert np.allclose(found[name].astype(float), want[name].astype(float), rtol=1e-9, equal_nan=True), name


def test_no_task_sorts_a_whole_series(bars):
    """Sorted windows by the keys alone stand over the table of buckets only: every sort of the rows has the bucket."""
    plan = longseries.ema_long(bars, WANTED, rows=40)._jdf.queryExecution().executedPlan().toString()
    windows = [x for x in plan.splitlines() if "windowspecdefinition" in x]
    assert windows
    for x in windows:
        over_rows = "timestamp" in x
        assert not over_rows or "__bucket" in x.split("windowspecdefinition")[1]


@pytest.mark.parametrize("rows", [2, 30, 100_000])
def test_last_before_is_strict_and_carried_over_empty_buckets(spark, rows):
    rng = np.random.default_rng(3)
    base = pd.Timestamp("2024-01-01")
    times = base + pd.to_timedelta(np.sort(np.concatenate([rng.integers(0, 500, 200), rng.integers(90_000, 90_100, 50)])), "s")
    trades = pd.DataFrame({"symbol": rng.choice(["a", "b"], 250), "ts": times.astype("datetime64[us]"), "event_id": np.arange(250), "price": rng.random(250)})
    edges = pd.DataFrame({"symbol": np.repeat(["a", "b", "none"], 80), "boundary": np.tile((base + pd.to_timedelta(np.concatenate([rng.integers(-5, 600, 60), rng.integers(80_000, 99_000, 20)]), "s")).astype("datetime64[us]"), 3)})
    found = last_before(spark.createDataFrame(trades), spark.createDataFrame(edges), rows).collect()
    assert len(found) == len(edges)
    for r in found:
        before = trades[(trades.symbol == r.symbol) & (trades.ts < pd.Timestamp(r.boundary).tz_localize(None))]
        want = (None, None) if before.empty else (before.iloc[-1].price, before.iloc[-1].ts)
        assert r.price == want[0] and (r.ts is None) == (want[1] is None)
