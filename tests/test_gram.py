"""Sums of products against numpy: pairwise and listwise, by group, for whole series and for each rolling window."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.operators import gram, splits

X = ["a", "b", "c", "d", "flat"]


def near(found, want, digits=1e-9):
    return np.allclose(np.asarray(found, float), want, rtol=digits, atol=digits, equal_nan=True)


@pytest.fixture(scope="module")
def frame():
    rng, n = np.random.default_rng(6), 700
    a = 1e6 + rng.normal(0, 1, n).cumsum()
    x = pd.DataFrame({"a": a, "b": 2 * a + rng.normal(0, 3, n), "c": rng.random(n), "d": rng.normal(0, 1, n), "flat": 0.1})
    x["symbol"] = np.where(np.arange(n) < 500, "p", "q")
    x["interval"] = "1h"
    x["timestamp"] = (pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(n), "h")).astype("datetime64[us]")
    x.loc[rng.choice(n, 60, replace=False), "c"] = np.nan
    x.loc[rng.choice(n, 40, replace=False), "d"] = np.nan
    return x


@pytest.fixture(scope="module")
def df(spark, frame):
    return spark.createDataFrame(frame).repartition(5)


@pytest.mark.parametrize("listwise", [False, True])
def test_correlations(df, frame, listwise):
    found = {(r.f1, r.f2): r.corr for r in gram.correlations(df, X, listwise).collect()}
    want = (frame[X].dropna() if listwise else frame[X]).corr()
    assert len(found) == 10
    for (i, j), r in found.items():
        assert r is None if "flat" in (i, j) else abs(r - want.loc[i, j]) < 1e-9, (i, j)
    none = {r.corr for r in gram.correlations(df.limit(0), X).collect()}
    assert none == {None}


def test_sums_merge_by_group_with_null_keys(spark):
    rows = [(None, 1.0, 2.0), (None, 3.0, None), ("g", 5.0, 7.0), ("g", float("nan"), 1.0)]
    found = gram.moments(spark.createDataFrame(rows, "g string, x double, y double").repartition(3), ["x", "y"], ["g"]).filter("i < j")
    assert sorted(map(tuple, found.collect()), key=str) == sorted([(None, 0, 1, 1, 1.0, 2.0, 1.0, 4.0, 2.0), ("g", 0, 1, 1, 5.0, 7.0, 25.0, 49.0, 35.0)], key=str)


def fitted(x):
    x = x.dropna().to_numpy(float)
    std = x.std(0, ddof=1)
    std[x.max(0) == x.min(0)] = 1.0
    z = (x - x.mean(0)) / std
    values, vectors = np.linalg.eigh(z.T @ z / (len(x) - 1))
    values, vectors = values[::-1], vectors[:, ::-1].T
    return len(x), x.mean(0), std, values, vectors * np.sign(vectors[np.arange(len(values)), np.abs(vectors).argmax(1)])[:, None]


def agrees(model, x, k):
    n, mean, std, values, vectors = fitted(x)
    assert model.train_rows == n and near(model.mean, mean) and near(model.std, std, 1e-7) and near(model.eigenvalue, np.maximum(values, 0), 1e-7)
    assert len(model.loadings) == k and near(model.loadings, vectors[:k], 1e-5)


def test_each_rolling_window_equals_its_own_fit(df, frame):
    models = {(r.symbol, r.window_id): r for r in gram.window_models(df, X, windows=4, k=3).collect()}
    parts = splits.rolling(df, 4).filter("split = 'train'").toPandas()
    want = {k: g for k, g in parts.groupby(["symbol", "window_id"])}
    assert set(models) == set(want) and len(want) > 4
    for key, model in models.items():
        agrees(model, want[key][X], 3)
    counts = {(r.symbol, r.window_id): r for r in gram.counts_of(gram.window_models(df, X, windows=4)).collect()}
    for key, r in counts.items():
        values = np.maximum(fitted(want[key][X])[3], 0)
        share = values / values.sum()
        assert r.kaiser == (values > 1).sum() and r.var_90 == np.argmax(share.cumsum() >= 0.9 - 1e-12) + 1
        assert r.elbow == (share > 0.05 * share.max()).sum() and r.above_mean == (share > 0.2).sum()


def test_windows_are_one_aggregation_of_the_rows(df):
    """One pass multiplies rows for all windows, and no window is fitted by a job of its own."""
    plan = gram.window_models(df, X, windows=50)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1


def test_components_of_series_and_stored_models(spark, df, frame, tmp_path):
    models = gram.fit_components(df, X, k=2)
    path = f"file://{tmp_path}/models"
    gram.save_models(models, path)
    gram.save_models(gram.fit_components(df.filter("symbol = 'q'"), X, k=2), path)  # replaces its series only
    back = gram.load_models(spark, path, X)
    rows = {(r.symbol, r.timestamp): r for r in gram.apply_components(df, back).collect()}
    fresh = {(r.symbol, r.timestamp): r.pc for r in gram.apply_components(df, models).collect()}
    assert len(rows) == len(frame)
    for symbol, part in frame.groupby("symbol"):
        _, mean, std, _, vectors = fitted(part[X])
        want = (part[X].to_numpy() - mean) / std @ vectors[:2].T
        for t, w in zip(part["timestamp"], want):
            pc = rows[symbol, t.to_pydatetime()].pc
            if np.isnan(w).any():
                assert pc is None and fresh[symbol, t.to_pydatetime()] is None
            else:
                assert near(pc, w, 1e-5) and near(pc, fresh[symbol, t.to_pydatetime()])
    with pytest.raises(Exception, match="was fitted on"):
        gram.load_models(spark, path, X[::-1]).collect()
    shown = gram.export(gram.apply_components(df.withColumns({"direction": F.lit(1), "split": F.lit("t"), "close": F.lit(1.0)}), back), 2)
    assert shown.columns == ["symbol", "date", "PC1", "PC2", "direction", "close", "split"]


def test_series_that_are_too_short_have_no_model(spark, df):
    assert gram.fit_components(df.limit(0), X).count() == 0
    one = df.filter("symbol = 'p'").limit(1)
    assert gram.fit_components(one, X).count() == 0
    assert {r.pc for r in gram.apply_components(one, gram.fit_components(df.limit(0), X)).collect()} == {None}
