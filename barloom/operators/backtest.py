"""Back-tests and live labels."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.frames import KEYS, add, div, lag, ln, ratio, roll, row_index, series, so_far
from barloom.functions.recursive import ema


def portfolio(df: DataFrame, forecast: str, start: int = 48) -> DataFrame:
    """df with buy, portfolio, peak and drawdown: from row `start` on each bar with a positive forecast is bought at
    its open and sold at its close; before, the portfolio is 1."""
    df = add(df, __i=row_index())
    buy = F.when((F.col("__i") >= start) & (F.col(forecast) > 0), 1).otherwise(0)
    df = add(df, buy=buy)
    gain = F.col("buy") * div(F.col("close") - F.col("open"), "open")
    df = add(df, portfolio=F.exp(F.sum(F.log1p(F.coalesce(gain, F.lit(0.0)))).over(so_far())))
    df = add(df, peak=F.max("portfolio").over(so_far()))
    low = lag("portfolio") * (1 + F.col("buy") * div(F.col("low") - F.col("open"), "open"))
    return add(df, drawdown=1 - F.least(F.col("portfolio"), F.coalesce(low, F.col("portfolio"))) / F.col("peak")).drop("__i")


def summary(df: DataFrame, bars_per_day: int = 4) -> DataFrame:
    """(symbol, interval, trades, total_return, annual_return, max_drawdown, win_rate) of portfolio()."""
    won = F.count_if((F.col("buy") == 1) & (F.col("close") > F.col("open")))
    g = df.groupBy(*KEYS).agg(F.sum("buy").alias("trades"), (F.max_by("portfolio", "timestamp") - 1).alias("total_return"), F.count("*").alias("n"), F.max("drawdown").alias("max_drawdown"), won.alias("won"))
    return g.select(*KEYS, "trades", "total_return", (F.pow(1 + F.col("total_return"), 365 / (F.col("n") * bars_per_day)) - 1).alias("annual_return"), "max_drawdown", div("won", "trades").alias("win_rate"))


def on_change(label: Column, skip: int = 1) -> tuple[Column, Column]:
    """Two steps of alternating labels: keep a label only where it differs from the last one (null: none), then blank
    the first `skip` that are left. The second takes the column "__kept" that the first is stored in."""
    before = F.last(label, ignorenulls=True).over(series().rowsBetween(Window.unboundedPreceding, -1))
    kept = F.when(label.isNotNull() & (before.isNull() | (label != before)), label)
    return kept, F.when(F.count("__kept").over(so_far()) > skip, F.col("__kept"))


def live_bollinger(df: DataFrame, n: int = 20, mult: float = 2.0) -> DataFrame:
    """BBandSE / BBandLE on crossings of bands with the population deviation, alternating, the first one blanked."""
    df = add(df, __b=roll(F.avg, "close", n), __d=roll(F.stddev_pop, "close", n))
    df = add(df, __u=F.col("__b") + mult * F.col("__d"), __l=F.col("__b") - mult * F.col("__d"))
    c1, c2 = lag("close"), lag("close", 2)
    raw = F.when((c1 < lag("__u")) & (c2 >= lag("__u", 2)), "BBandSE").when((c1 > lag("__l")) & (c2 <= lag("__l", 2)), "BBandLE")
    return _labelled(df, raw, 1).drop("__b", "__d", "__u", "__l")


def live_rsi(df: DataFrame, n: int = 14) -> DataFrame:
    """RsiLE / RsiSE on delayed crossings of 30 and 70, alternating, the first two blanked. The live index (of df with
    RSI_n) doesn't show the row of its seed, the plain mean of the first n moves: it is 0 up to row n."""
    df = add(df, __x=F.when(row_index() <= n, 0.0).otherwise(F.col(f"RSI_{n}")))
    x = "__x"
    raw = F.when((lag(x) > 30) & (lag(x, 2) <= 30), "RsiLE").when((lag(x) < 70) & (lag(x, 2) >= 70), "RsiSE")
    return _labelled(df, raw, 2).drop("__x")


def live_macd(df: DataFrame, fast: int = 18, slow: int = 30, signal: int = 18) -> DataFrame:
    """MacdLE / MacdSE when the sign of line minus signal changes, one bar late, from row slow+signal-2 on; averages
    start with plain means."""
    df = ema(df, {"__f": ("sma", "close", fast), "__s": ("sma", "close", slow)})
    df = add(df, __line=F.col("__f") - F.col("__s"), __i=row_index())
    df = add(df, __late=F.coalesce(F.lead("__line", slow - 1).over(series()), F.lit(0.0)))
    df = ema(df, {"__sig": ("sma", "__late", signal)})
    df = add(df, __gap=F.col("__line") - lag("__sig", slow - 1))
    sign = F.when(F.col("__gap") > 0, "MacdLE").when(F.col("__gap") < 0, "MacdSE")
    df = add(df, __sign=F.when(F.col("__i") >= slow + signal - 2, sign))
    return _labelled(df, lag("__sign"), 0).drop("__f", "__s", "__line", "__i", "__late", "__sig", "__gap", "__sign")


def _labelled(df: DataFrame, raw: Column, skip: int) -> DataFrame:
    df = add(df, __raw=raw)
    kept, _ = on_change(F.col("__raw"), skip)
    df = add(df, __kept=kept)
    _, label = on_change(F.col("__raw"), skip)
    return add(df, label=label).drop("__raw", "__kept")


#: Features of the models that are also given one bar late.
LAGGED = [
    "close_log", "high_log", "low_log", "hilo_log", "close_log_2", "close_log_3", "body", "upper_wick", "lower_wick", "upper_ratio", "lower_ratio",
    "rvol", "rvol_growth", "range_sma", "body2_ema", "upper_ema", "lower_ema", "body_x_rvol", "wick_x_body", "ema_6", "rma_6", "rsi_ema",
]


def arima_features(df: DataFrame, spans: tuple[int, ...] = (6, 14, 21, 42, 84), rsi: str | None = None) -> DataFrame:
    """Log returns, powers, averages of the given spans, relative volume, body and wick sizes, and one-bar lags; where
    rsi names a column with the strength index, its average of three bars too. A price or volume of 0 gives logs and
    quotients that are infinite, or NaN."""
    o, h, low, c, v = (F.col(x) for x in ("open", "high", "low", "close", "volume"))
    logret = lambda x: ln(ratio(x, lag(x)))
    df = add(df, close_log=logret("close"), high_log=logret("high"), low_log=logret("low"), hilo_log=ln(ratio(h, low)))
    body = F.abs(c - o)
    upper, lower = h - F.greatest(o, c), F.least(o, c) - low
    size = F.when(body == 0, 1e-8).otherwise(body)
    df = add(df, close_log_2=F.col("close_log") ** 2, close_log_3=F.col("close_log") ** 3, body=body, upper_wick=upper, lower_wick=lower, upper_ratio=upper / size, lower_ratio=lower / size, **{f"sma_{n}": roll(F.avg, "close", n) for n in spans}, rvol=ratio(v, roll(F.avg, "volume", 21)))
    df = add(df, body_2=F.col("body") ** 2, range=h - low, rvol_growth=ratio("rvol", roll(F.avg, "close", 21)))
    df = ema(df, {**{f"ema_{n}": ("sma", "close", n) for n in spans}, **{f"rma_{n}": ("wilder", "close", n) for n in spans}, "upper_ema": ("sma", "upper_wick", 6), "lower_ema": ("sma", "lower_wick", 6), "body2_ema": ("sma", "body_2", 42)})
    df = add(df, range_sma=roll(F.avg, "range", 42), body_x_rvol=F.col("body") * F.col("rvol"), wick_x_body=F.col("upper_wick") * F.col("body"))
    if rsi:
        df = ema(df, {"rsi_ema": ("sma", rsi, 3)})
    return add(df, **{f"{x}_lag1": lag(x) for x in LAGGED if x in df.columns})


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """(symbol, interval, corr) of two fitted columns."""
    return df.groupBy(*KEYS).agg(div(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b)).alias("corr"))


def fit_autoregression(df: DataFrame, target: str, lags: int = 3) -> DataFrame:
    """df with fitted: a least-squares autoregression of the target on its lags, one for each series, from the means and
    covariances of its lags. It stands in for a maximum-likelihood ARIMA fit, which Spark has no operator for. Rows
    without a target or without all its lags go; where lags depend on each other the smallest weights are taken."""
    x = [f"__{k}" for k in range(1, lags + 1)]
    rows = add(df, **{f"__{k}": lag(target, k) for k in range(1, lags + 1)}).dropna(subset=[target, *x])
    means = F.array(*[F.avg(c) for c in [target, *x]]).alias("means")
    covariances = F.array(*[F.covar_pop(a, b) for a in x for b in [*x, target]]).alias("covariances")
    moments = rows.groupBy(*[F.col(k).alias(f"__{k}") for k in KEYS]).agg(means, covariances)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            weights = []
            for mean, covariance in zip(g["means"], g["covariances"]):
                c = np.reshape(covariance, (lags, lags + 1))
                w = np.linalg.lstsq(c[:, :-1], c[:, -1], rcond=None)[0]
                weights.append([mean[0] - w @ mean[1:], *w])
            yield g[[f"__{k}" for k in KEYS]].assign(__w=weights)

    keys = ", ".join(f"__{k} {df.schema[k].dataType.simpleString()}" for k in KEYS)
    fits = moments.mapInPandas(solve, f"{keys}, __w array<double>")
    same = " AND ".join(f"{k} <=> __{k}" for k in KEYS)
    fitted = sum((F.col("__w")[k] * F.col(f"__{k}") for k in range(1, lags + 1)), F.col("__w")[0])
    return rows.join(fits, F.expr(same)).withColumn("fitted", fitted).drop("__w", *x, *[f"__{k}" for k in KEYS])
