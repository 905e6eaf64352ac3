"""Nearest-neighbour information against a plain search over all pairs, with ties, nulls, lone labels and few ranges."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import information


def psi(x):
    out = 0.0
    while x < 30:
        out, x = out - 1 / x, x + 1
    z = 1 / (x * x)
    return out + math.log(x) - 0.5 / x - z * (1 / 12 - z * (1 / 120 - z / 252))


def plain(x, y, k):
    there = ~(np.isnan(x) | np.array([v is None for v in y]))
    x, y = x[there], np.array(y, dtype=object)[there]
    sizes = {v: int((y == v).sum()) for v in set(y)}
    keep = np.array([sizes[v] > 1 for v in y], bool)
    x, y = x[keep], y[keep]
    if not len(x):
        return None
    ks, of, m = [], [], []
    for a, v in zip(x, y):
        kk = min(k, sizes[v] - 1)
        r = np.sort(np.abs(x[y == v] - a))[kk]
        m.append(int((np.abs(x - a) < r).sum()) if r > 0 else int((x == a).sum()))
        ks.append(kk)
        of.append(sizes[v])
    return max(0.0, psi(len(x)) + np.mean([psi(i) for i in ks]) - np.mean([psi(i) for i in of]) - np.mean([psi(i) for i in m]))


def test_digamma(spark):
    xs = [1.0, 1.5, 2.0, 3.0, 10.0, 77.5, 1e6]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in xs], "x double").select(information.digamma(F.col("x"))).collect()]
    assert np.allclose(got, [psi(x) for x in xs], atol=1e-11) and abs(got[0] + 0.5772156649015329) < 1e-12


@pytest.mark.parametrize("k, ranges", [(3, 1), (3, 7), (1, 40), (5, 13)])
def test_equals_plain_search(spark, k, ranges):
    rng, n = np.random.default_rng(1), 300
    y = rng.integers(0, 4, n)
    frame = pd.DataFrame({"near": y + rng.normal(0, 0.3, n), "far": rng.normal(0, 1, n), "ties": np.round(rng.normal(0, 1, n) + (y == 1), 0), "same": 1.0, "hot": np.where(rng.random(n) < 0.4, 7.0, rng.normal(0, 1, n)), "none": np.nan})
    frame = frame.astype(np.float32).astype(float)  # differences of these are exact
    frame.loc[rng.choice(n, 30, replace=False), "far"] = np.nan
    labels = [None if i % 29 == 0 else "lone" if i == 5 else f"l{v}" for i, v in enumerate(y)]
    frame["label"] = labels
    columns = ["near", "far", "ties", "same", "hot", "none"]
    df = spark.createDataFrame(frame).repartition(4)
    found = {r.feature: r.mi for r in information.neighbour_information(df, columns, "label", k, ranges).collect()}
    assert set(found) == set(columns)
    for c in columns:
        want = plain(frame[c].to_numpy(), labels, k)
        assert (found[c] is None) == (want is None) and (want is None or abs(found[c] - want) < 1e-9), (c, found[c], want)


def test_empty_table(spark):
    none = spark.createDataFrame([], "a double, label int")
    assert [tuple(r) for r in information.neighbour_information(none, ["a"], "label").collect()] == [("a", None)]


def test_values_are_counted_once(spark):
    """The rows are read to be cut and stored, not again for each place that the values are needed in."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    frame = pd.DataFrame({"a": np.arange(200) % 17 / 3, "label": np.arange(200) % 3})
    df = spark.createDataFrame(frame).mapInArrow(counted, "a double, label long")
    found = information.neighbour_information(df, ["a"], "label", 3, 4)
    stored = read.value
    assert found.count() == 1 and found.collect()[0].mi is not None
    assert read.value == stored == 200
