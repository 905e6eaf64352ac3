"""Exact quantiles in two passes: a mergeable sketch cuts each group's values into ranges, their counts tell which ranges
hold the wanted ranks, and only those are sorted. No task holds the distinct values of a group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Ranges a group is cut into, and the groups whose cut points are broadcast at most.
RANGES, BROADCAST_GROUPS = 64, 20_000


def range_of(x: Column, cuts: Column) -> Column:
    """How many cut points are below x."""
    return F.size(F.filter(cuts, lambda c: c < x))


def quantiles(long: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], ranges: int = RANGES) -> DataFrame:
    """(keys, n, q): for each group how many values there are and an array of the quantiles at the shares, interpolated
    linearly between neighbours; nulls count for nothing, a group of nulls has no row. A group may be of any size."""
    wanted = F.array(*[F.lit(float(s)) for s in shares])
    d = long.select(*keys, F.col(value).cast("double").alias("x")).filter("x IS NOT NULL")
    probs = [i / ranges for i in range(1, ranges)]
    cuts = d.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("x", F.array(*map(F.lit, probs)), F.lit(10 * ranges)).alias("cuts"))
    small = cuts.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    held = F.broadcast if small else (lambda df: df)
    same = F.lit(True)
    for c in keys:
        same = same & F.col(f"d.{c}").eqNullSafe(F.col(f"c.{c}"))
    ranged = d.alias("d").join(held(cuts).alias("c"), same).select(*[F.col(f"d.{c}") for c in keys], "x", "n", range_of(F.col("x"), F.col("cuts")).alias("range"))
    # ranks lo and hi of each share, and the ranges that hold one of them
    position = F.transform(wanted, lambda s: s * (F.col("n") - 1))
    ranks = F.array_union(F.transform(position, lambda p: F.floor(p)), F.transform(position, lambda p: F.ceil(p)))
    counts = ranged.groupBy(*keys, "range").agg(F.count("*").alias("size"), F.first("n").alias("n"))
    before = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    counts = counts.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    holds = counts.filter(F.exists(ranks, lambda r: (r >= F.col("before")) & (r < F.col("before") + F.col("size")))).select(*keys, "range", "before")
    same_range = F.col("d.range") == F.col("c.range")
    for c in keys:
        same_range = same_range & F.col(f"d.{c}").eqNullSafe(F.col(f"c.{c}"))
    kept = ranged.alias("d").join(held(holds).alias("c"), same_range).select(*[F.col(f"d.{c}") for c in keys], "x", "n", F.col("d.range"), "before")
    weighed = kept.groupBy(*keys, "range", "before", "n", "x").agg(F.count("*").alias("w"))  # equal values are one row
    last = F.sum("w").over(Window.partitionBy(*keys, "range").orderBy("x").rowsBetween(Window.unboundedPreceding, 0))
    placed = weighed.withColumn("end", F.col("before") + last).withColumn("begin", F.col("end") - F.col("w"))
    at = lambda p: F.max(F.when((F.col("begin") <= p) & (p < F.col("end")), F.col("x")))
    out = placed.groupBy(*keys).agg(F.first("n").alias("n"), *[f for k, s in enumerate(shares) for p in [F.lit(float(s)) * (F.col("n") - 1)] for f in (at(F.floor(p)).alias(f"l{k}"), at(F.ceil(p)).alias(f"h{k}"))])
    between = [F.when(F.col(f"l{k}") == F.col(f"h{k}"), F.col(f"l{k}")).otherwise(F.col(f"l{k}") * (F.ceil(p) - p) + F.col(f"h{k}") * (p - F.floor(p))) for k, s in enumerate(shares) for p in [F.lit(float(s)) * (F.col("n") - 1)]]
    return out.select(*keys, "n", F.array(*between).alias("q"))


def column_quantiles(df: DataFrame, keys: Sequence[str], columns: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """(keys, __q_column...): an array of quantiles of each column, a row for each group that has any value."""
    long = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(list(keys), list(columns), "feature", "x")
    found = quantiles(long, [*keys, "feature"], "x", shares)
    return found.groupBy(*keys).agg(*[F.max(F.when(F.col("feature") == c, F.col("q"))).alias(f"__q_{c}") for c in columns])
