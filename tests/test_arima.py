"""ARIMA fits against planted coefficients, a numeric minimum and blocks of few rows."""

import numpy as np
import pandas as pd
import pytest

from barloom.operators import arima


def simulated(n, ar, ma, b, seed):
    rng = np.random.default_rng(seed)
    x, e = rng.normal(0, 1, n), rng.normal(0, 0.5, n)
    z = np.zeros(n)
    for t in range(n):
        z[t] = e[t] + sum(a * z[t - i] for i, a in enumerate(ar, 1) if t >= i) + sum(m * e[t - j] for j, m in enumerate(ma, 1) if t >= j)
    return b[0] + b[1] * x + z, x


def frame(spark, parts):
    out = []
    for symbol, (y, x) in parts.items():
        out.append(pd.DataFrame({"symbol": symbol, "interval": "1h", "timestamp": (pd.Timestamp("2024-01-01") + pd.to_timedelta(np.arange(len(y)), "h")).astype("datetime64[us]"), "y": y, "x": x}))
    return spark.createDataFrame(pd.concat(out, ignore_index=True))


def test_derivatives():
    y, x = simulated(60, [0.5], [0.3, 0.1], [1.0, 2.0], 0)
    x, w = np.column_stack([np.ones(60), x]), np.array([0.7, 1.5, 0.4, 0.2, 0.1])
    split = lambda w: (w[:2], w[2:3], w[3:])
    _, d = arima.errors(y, x, *split(w))
    for i in range(5):
        step = np.eye(5)[i] * 1e-6
        up, down = (arima.errors(y, x, *split(w + s), derive=False)[0] for s in (step, -step))
        assert np.allclose(d[:, i], (up - down) / 2e-6, atol=1e-6)


@pytest.mark.parametrize("block", [700, 20_000])
def test_planted_coefficients_within_their_errors(spark, block):
    """Two series with coefficients of their own, in one block or in several."""
    planted = {"a": ([0.6, -0.2], [0.4], [3.0, 1.5]), "b": ([-0.3, 0.1], [-0.5], [-1.0, 0.0])}
    df = frame(spark, {s: simulated(2500, *c, seed=i) for i, (s, c) in enumerate(planted.items())} | {"short": (np.ones(5), np.ones(5))})
    fits = {r.symbol: r for r in arima.fit_arima(df, "y", (2, 1), ["x"], block=block, warm=150).collect()}
    assert set(fits) == {"a", "b"}
    for s, (ar, ma, b) in planted.items():
        found, want = np.array([*fits[s].intercept_and_x, *fits[s].ar, *fits[s].ma]), np.array([*b, *ar, *ma])
        assert (np.abs(found - want) < 4 * np.array(fits[s].error)).all(), (s, found, fits[s].error)
        assert abs(fits[s].sigma2 - 0.25) < 0.03 and fits[s].rows == 2498
        y, x = df.filter(f"symbol = '{s}'").orderBy("timestamp").toPandas()[["y", "x"]].to_numpy().T
        design = np.column_stack([np.ones(len(y)), x])
        sse = lambda w: float((arima.errors(y, design, w[:2], w[2:4], w[4:], derive=False)[0] ** 2).sum())
        best = sse(found)
        for i in range(5):  # no better place nearby
            for move in (-1e-3, 1e-3):
                assert sse(found + move * np.eye(5)[i]) > best - 1e-6


def test_order_by_aic_and_fitted_values(spark):
    df = frame(spark, {"ma": simulated(1500, [], [0.8], [0.0, 1.0], 5), "ar": simulated(1500, [0.7], [], [0.0, 1.0], 6)})
    best = arima.choose_order(df, "y", [(0, 0), (1, 0), (0, 1)], ["x"])
    assert {r.symbol: (r.p, r.q) for r in best.collect()} == {"ma": (0, 1), "ar": (1, 0)}
    fits = arima.fit_arima(df, "y", (1, 1), ["x"])
    rows = arima.fitted_values(df, "y", fits, ["x"], block=400, warm=100).toPandas()
    assert len(rows) == 3000 and rows.groupby("symbol")["fitted"].apply(lambda v: v.isna().sum()).to_dict() == {"ar": 1, "ma": 1}
    for r in fits.collect():
        part = rows[rows.symbol == r.symbol]
        assert abs(((part.y - part.fitted) ** 2).mean() - r.sigma2) < 1e-3
    assert arima.fit_arima(df.limit(0), "y").count() == 0
