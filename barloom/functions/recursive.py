"""Recursive filters y[t] = q * y[t-1] + u[t] as window sums.

Within a block of BLOCK rows y is q^k * sum(u[j] * q^-j), a running sum that can't overflow; what earlier blocks add
are their last values times powers of q, and only as many blocks count as double precision can tell. All windows
share the partitioning of the series.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.frames import KEYS, TIME, add, row_index

BLOCK = 512


def scan(df: DataFrame, inputs: dict[str, tuple[Column, float]], keys: Sequence[str] = KEYS, time: str = TIME) -> DataFrame:
    """df with a column for each name: y of the input u (null counts as 0) and the factor q, 0 < q < 1, by keys in the
    order of time."""
    k = F.col("__scan_i") % BLOCK
    df = add(df, __scan_i=F.row_number().over(Window.partitionBy(*keys).orderBy(time)) - 1)
    df = add(df, __scan_b=F.floor(F.col("__scan_i") / BLOCK), **{f"__scan_u{n}": F.coalesce(u, F.lit(0.0)) for n, (u, _) in enumerate(inputs.values())})
    own = Window.partitionBy(*keys, "__scan_b").orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    df = add(df, **{f"__scan_y{n}": F.sum(F.col(f"__scan_u{n}") * F.pow(F.lit(q), -k)).over(own) * F.pow(F.lit(q), k) for n, (_, q) in enumerate(inputs.values())})

    def earlier(n: int, q: float) -> Column:
        total = F.lit(0.0)
        for m in range(1, max(1, math.ceil(46 / (-BLOCK * math.log(q)))) + 1):
            block = Window.partitionBy(*keys).orderBy("__scan_b").rangeBetween(-m, -m)
            end = F.max(F.when(k == BLOCK - 1, F.col(f"__scan_y{n}"))).over(block)
            total = total + F.coalesce(end, F.lit(0.0)) * F.pow(F.lit(q), k + 1 + (m - 1) * BLOCK)
        return total

    df = add(df, **{name: F.col(f"__scan_y{n}") + earlier(n, q) for n, (name, (_, q)) in enumerate(inputs.items())})
    return df.drop("__scan_i", "__scan_b", *[f"__scan_{x}{n}" for n in range(len(inputs)) for x in "uy"])


def ema(df: DataFrame, wanted: dict[str, tuple[str, str, float]]) -> DataFrame:
    """df with exponential averages: name -> (kind, column, span).

    kinds: "weighted" divides by the sum of the weights so far and skips leading nulls; "first" starts at the first
    value; "sma" and "wilder" start at row span-1 with the plain mean of the first span values (null before), and
    weigh a new value by 2/(span+1) and by 1/span. Columns have no nulls but leading ones ("weighted" only).
    """
    inputs: dict[str, tuple[Column, float]] = {}
    df = add(df, __ema_n=row_index())
    seeds = {f"__ema_s{k}": F.avg(F.when(F.col("__ema_n") < int(span), F.col(x))).over(Window.partitionBy(*KEYS).orderBy(TIME).rowsBetween(-(int(span) - 1), 0)) for k, (kind, x, span) in enumerate(wanted.values()) if kind in ("sma", "wilder")}
    df = add(df, **seeds) if seeds else df
    for k, (name, (kind, x, span)) in enumerate(wanted.items()):
        a = 1 / span if kind == "wilder" else 2 / (span + 1)
        v, n = F.col(x), F.col("__ema_n")
        if kind == "weighted":
            u = v
        elif kind == "first":
            u = F.when(n == 0, v).otherwise(v * a)
        else:
            u = F.when(n == int(span) - 1, F.col(f"__ema_s{k}")).when(n >= int(span), v * a)
        inputs[name] = (u, 1 - a)
    df = scan(df, inputs)
    out = {}
    for name, (kind, x, span) in wanted.items():
        q = 1 - (1 / span if kind == "wilder" else 2 / (span + 1))
        if kind == "weighted":
            seen = F.count(x).over(Window.partitionBy(*KEYS).orderBy(TIME).rowsBetween(Window.unboundedPreceding, 0))
            out[name] = F.when(seen > 0, F.col(name) * (1 - q) / (1 - F.pow(F.lit(q), seen)))
        elif kind in ("sma", "wilder"):
            out[name] = F.when(F.col("__ema_n") >= int(span) - 1, F.col(name))
    return add(df, **out).drop("__ema_n", *seeds) if out else df.drop("__ema_n", *seeds)
