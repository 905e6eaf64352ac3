"""ARIMA with regressors for many series at once, by conditional sums of squares.

The errors of a series follow from its values by a recursion, y - X b being an ARMA process. Each series is cut into
blocks of rows that begin with some rows of the block before, over which the recursion forgets that it began there. A
pass gives every block's sums of products of derivatives and errors; added up by series they are one
Levenberg-Marquardt step of all its parameters. Blocks are packed once; a pass moves one row a block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barloom.functions.frames import KEYS, TIME
from barloom.functions.longseries import numbered

#: Rows of a block, and rows of the one before that it begins with.
BLOCK, WARM = 20_000, 500
#: Steps at most; relative improvement of the sum of squares at which a series is done.
STEPS, DONE = 25, 1e-9
#: Largest root of the recursions: errors of a block are forgotten over the rows it begins with.
ROOT = 0.99

FIT = "intercept_and_x array<double>, ar array<double>, ma array<double>, error array<double>, rows long, sigma2 double, loglik double, aic double, steps int"


def errors(y: np.ndarray, x: np.ndarray, b: np.ndarray, ar: np.ndarray, ma: np.ndarray, derive: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The errors of a stretch of rows, and their derivatives by b, ar and ma, one column each; both are 0 before the
    first row with all its lags."""
    p, q, n = len(ar), len(ma), len(y)
    z = y - x @ b
    white, wx = z.copy(), x.copy()
    for i, a in enumerate(ar, 1):
        white[i:] -= a * z[:-i]
        wx[i:] -= a * x[:-i]
    e = np.zeros(n)
    d = np.zeros((n, len(b) + p + q)) if derive else np.zeros((n, 0))
    if derive:
        d[:, : len(b)] = -wx
        for i in range(1, p + 1):
            d[i:, len(b) + i - 1] = -z[:-i]
    d[:p] = 0.0
    for t in range(p, n):
        e[t] = white[t] - sum(ma[j - 1] * e[t - j] for j in range(1, min(q, t) + 1))
        if derive:
            for j in range(1, min(q, t) + 1):
                d[t, len(b) + p + j - 1] -= e[t - j]
            for j in range(1, min(q, t) + 1):
                d[t] -= ma[j - 1] * d[t - j]
    return e, d


def blocks(df: DataFrame, target: str, regressors: Sequence[str], block: int = BLOCK, warm: int = WARM) -> DataFrame:
    """(symbol, interval, block, skip, t, y, x): the rows of each block in order, the first `skip` of them those of the
    block before. Rows with a null or NaN in the target or a regressor are left out."""
    used = [target, *regressors]
    whole = df.filter(~F.exists(F.array(*[F.col(c).cast("double") for c in used]), lambda v: v.isNull() | F.isnan(v)))
    d = numbered(whole.select(*KEYS, TIME, *[F.col(c).cast("double").alias(f"__v{k}") for k, c in enumerate(used)]))
    own = F.floor(F.col("__i") / block)
    again = F.when(F.col("__i") % block >= block - warm, F.array(own, own + 1)).otherwise(F.array(own))
    rows = d.withColumn("block", F.explode(again)).withColumn("old", F.col("block") > own)
    item = F.struct("__i", "old", F.col(TIME).alias("t"), F.array(*[F.col(f"__v{k}") for k in range(len(used))]).alias("v"))
    packed = rows.groupBy(*KEYS, "block").agg(F.sort_array(F.collect_list(item)).alias("r")).filter(F.exists("r", lambda r: ~r["old"]))
    return packed.select(*KEYS, "block", F.size(F.filter("r", lambda r: r["old"])).alias("skip"), F.transform("r", lambda r: r["t"]).alias("t"), F.transform("r", lambda r: r["v"]).alias("v"))


def _passed(packed: DataFrame, tries: DataFrame, p: int, q: int, k: int) -> DataFrame:
    """(symbol, interval, n, sse, jj, je): sums over each series at its parameters to try."""
    m = k + p + q
    kinds = ", ".join(f"{c} {packed.schema[c].dataType.simpleString()}" for c in KEYS)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for row in part.itertuples():
                v = np.array([list(x) for x in row.v])
                w = np.asarray(row.params)
                x = np.column_stack([np.ones(len(v)), v[:, 1:]])
                with np.errstate(all="ignore"):
                    e, d = errors(v[:, 0], x, w[:k], w[k : k + p], w[k + p :])
                    first = row.skip if row.skip else p
                    e, d = e[first:], d[first:]
                    sums = [float(len(e)), float(e @ e), *(d.T @ d).ravel(), *(d.T @ e)]
                out.append([*(getattr(row, c) for c in KEYS), sums])
            yield pd.DataFrame(out, columns=[*KEYS, "sums"])

    each = packed.join(F.broadcast(tries) if tries.count() <= 10_000 else tries, list(KEYS)).mapInPandas(run, f"{kinds}, sums array<double>")
    return each.groupBy(*KEYS).agg(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(2 + m * m + m)]).select(*KEYS, F.array(*[F.col(f"s{i}") for i in range(2 + m * m + m)]).alias("sums"))


def stable(*recursions: np.ndarray) -> bool:
    """Whether x[t] = c[0] x[t-1] + c[1] x[t-2] + ... dies out for each of the recursions' coefficients."""
    return all(not len(c) or np.abs(np.linalg.eigvals(np.vstack([c, np.eye(len(c) - 1, len(c))]))).max() < ROOT for c in recursions)


def _step(state: list | None, sums: list[float], params: list[float], k: int, p: int, m: int) -> list:
    """[params to try, best params, best sums, damping, done] after a pass at params."""
    sse = sums[1] if all(map(math.isfinite, sums)) else math.inf
    if state is None:
        best, kept, damping, done = list(params), list(sums), 1e-3, 0
    else:
        _, best, kept, damping, done = state
        if done:
            return state
        better = sse < kept[1]
        gain = (kept[1] - sse) / max(kept[1], 1e-300)
        if better:
            best, kept, damping = list(params), list(sums), max(damping / 10, 1e-12)
        else:
            damping *= 10
        done = int(better and gain < DONE or damping > 1e12 or kept[1] <= 1e-300)
    jj, je = np.reshape(kept[2 : 2 + m * m], (m, m)), np.asarray(kept[2 + m * m :])
    scale = np.diag(jj) + 1e-300
    while True:  # shorter moves until the process stays stationary and invertible
        move = np.asarray(best) + np.linalg.lstsq(jj + damping * np.diag(scale), -je, rcond=None)[0]
        if stable(move[k : k + p], -move[k + p :]) or damping > 1e12:
            break
        damping *= 10
    return [move.tolist(), best, kept, damping, done]


def fit_arima(df: DataFrame, target: str, order: tuple[int, int] = (2, 3), regressors: Sequence[str] = (), block: int = BLOCK, warm: int = WARM, store=None) -> DataFrame:
    """A fit for each series: (symbol, interval, columns of FIT), by the conditional likelihood of an ARMA(order) process
    about an intercept and the regressors, stationary and invertible. error has the standard errors of intercept, regressors, ar and ma in this
    order (null where they can't be told); loglik and aic are those of normal errors, the variance counted.

    A series with fewer rows than twice its parameters and lags has no fit. Parameters come to the driver, one row a
    series; values never do. store writes a frame and reads it back (by default the blocks are computed in each pass).
    """
    p, q = order
    k = 1 + len(regressors)
    m, spark = k + p + q, df.sparkSession
    packed = blocks(df, target, regressors, block, warm)
    packed = store(packed) if store else packed
    least = 2 * m + p
    sizes = packed.groupBy(*KEYS).agg(F.sum(F.size("v") - F.col("skip")).alias("n")).filter(F.col("n") >= least).select(*KEYS).collect()
    schema = T.StructType([*[packed.schema[c] for c in KEYS], T.StructField("params", T.ArrayType(T.DoubleType()))])
    states: dict[tuple, list | None] = {tuple(r): None for r in sizes}
    tries = {key: [0.0] * k + [0.1 / (i + 1) for i in range(p)] + [0.0] * q for key in states}
    used = 0
    for used in range(1, STEPS + 1):
        open_ = {key: w for key, w in tries.items() if not (states[key] and states[key][4])}
        if not open_:
            break
        told = _passed(packed, spark.createDataFrame([(*key, w) for key, w in open_.items()], schema), p, q, k)
        for r in told.collect():
            key = tuple(r)[: len(KEYS)]
            states[key] = _step(states[key], r["sums"], tries[key], k, p, m)
            tries[key] = states[key][0]
    rows = []
    for key, state in states.items():
        if state is None:
            continue
        _, w, sums, _, _ = state
        n, sse = int(sums[0]), sums[1]
        sigma2 = sse / n
        cov = np.linalg.pinv(np.reshape(sums[2 : 2 + m * m], (m, m))) * sigma2
        error = [math.sqrt(v) if v > 0 else None for v in np.diag(cov).tolist()]
        loglik = -n / 2 * (math.log(2 * math.pi * max(sigma2, 1e-300)) + 1)
        rows.append((*key, w[:k], w[k : k + p], w[k + p :], error, n, sigma2, loglik, 2 * (m + 1) - 2 * loglik, used))
    kinds = ", ".join(f"{c} {packed.schema[c].dataType.simpleString()}" for c in KEYS)
    return spark.createDataFrame(rows, f"{kinds}, {FIT}")


def choose_order(df: DataFrame, target: str, orders: Sequence[tuple[int, int]], regressors: Sequence[str] = (), **options) -> DataFrame:
    """The fit with the least aic of each series, with p and q; ties go to the earlier order."""
    fits = None
    for place, (p, q) in enumerate(orders):
        one = fit_arima(df, target, (p, q), regressors, **options).withColumns({"p": F.lit(p), "q": F.lit(q), "__place": F.lit(place)})
        fits = one if fits is None else fits.unionByName(one)
    cols = [c for c in fits.columns if c != "__place"]
    best = fits.groupBy(*KEYS).agg(F.min_by(F.struct(*[c for c in cols if c not in KEYS]), F.struct("aic", "__place")).alias("f"))
    return best.select(*KEYS, "f.*")


def fitted_values(df: DataFrame, target: str, fits: DataFrame, regressors: Sequence[str] = (), block: int = BLOCK, warm: int = WARM) -> DataFrame:
    """(symbol, interval, timestamp, y, fitted): the one-step forecasts of each row with a whole target and regressors by
    its series' fit; the first rows, without all lags, have none."""
    packed = blocks(df, target, regressors, block, warm).join(fits.select(*KEYS, "intercept_and_x", "ar", "ma"), list(KEYS))
    time = packed.schema["t"].dataType.elementType.simpleString()
    kinds = ", ".join(f"{c} {packed.schema[c].dataType.simpleString()}" for c in KEYS)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.itertuples():
                v, ar = np.array([list(x) for x in row.v]), np.asarray(row.ar, float)
                x = np.column_stack([np.ones(len(v)), v[:, 1:]])
                e, _ = errors(v[:, 0], x, np.asarray(row.intercept_and_x), ar, np.asarray(row.ma, float), derive=False)
                fitted = v[:, 0] - e
                if not row.skip:
                    fitted[: len(ar)] = np.nan
                out = pd.DataFrame({c: getattr(row, c) for c in KEYS} | {"timestamp": list(row.t), "y": v[:, 0], "fitted": fitted})
                yield out.iloc[row.skip :]

    found = packed.mapInPandas(run, f"{kinds}, timestamp {time}, y double, fitted double")
    return found.withColumn("fitted", F.when(~F.isnan("fitted"), F.col("fitted")))
