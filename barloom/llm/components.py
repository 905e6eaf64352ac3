"""Connected components by alternating large-star and small-star steps, each step stored."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import discard, stored


def components(edges: DataFrame) -> DataFrame:
    """(v, root) for every vertex of edges (a, b: long): root is the smallest vertex that can be reached.

    Repeated edges, loops and nulls change nothing; no edges give no rows. Each step moves every vertex to the least
    of its neighbourhood, so a few steps suffice; no neighbourhood is gathered in one place.
    """
    e = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    state = _state(e)
    while True:
        both = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.least("m", "a").alias("b")).distinct()
        large = stored(large, "large")
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select("a", "m", F.explode(F.array("a", "b")).alias("x")).filter("x <> m")
        last, e = e, stored(small.select(F.greatest("x", "m").alias("a"), F.least("x", "m").alias("b")).distinct(), "edges")
        discard(last, large)
        before, state = state, _state(e)
        if state == before:
            break
    return e.select(F.col("a").alias("v"), F.col("b").alias("root")).unionAll(e.select(F.col("b").alias("v"), F.col("b").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple:
    """Number and checksum of the edges: they no longer change when all are stars around their least vertices."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
