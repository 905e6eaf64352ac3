"""Mutual information of columns with a label by nearest neighbours, in sorted ranges of values.

For each value the distance to its k-th neighbour of the same label is the radius, and what counts is how many values of
any label lie within it. Both are questions about sorted values of one column: values are cut into ranges, sorted in
each, and what a range needs of others (k neighbours at its ends, the number of values before it) is carried over a table
with a row a range. Equal values of one label are one row with a weight, so that no value fills a range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.folders import stored
from barloom.functions.quantiles import range_of


def digamma(x: Column) -> Column:
    """The logarithmic derivative of the gamma function for x >= 1, to about 1e-13: ten steps up, then its series."""
    y = x + 10
    z = 1 / (y * y)
    tail = F.log(y) - 0.5 / y - z * (1 / 12 - z * (1 / 120 - z * (1 / 252 - z * (1 / 240 - z / 132))))
    return tail - sum((1 / (x + i) for i in range(10)), F.lit(0.0))


def neighbour_information(df: DataFrame, columns: Sequence[str], label: str, neighbours: int = 3, ranges: int | None = None) -> DataFrame:
    """(feature, mi) in nats, 0 at least: psi(n) + mean psi(k) - mean psi(rows of the label) - mean psi(rows within the
    radius), k the neighbours or as many as the label has besides the row.

    Rows whose value or label is null or NaN count for nothing in that column, nor do labels with a single row; a column
    without any others has mi null. Where k rows share a value the radius is 0 and the rows of that value count. Ranges
    are about equal shares of a column's rows, as many as shuffle partitions unless told.
    """
    spark = df.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    values = df.select(F.col(label).alias("y"), *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(["y"], list(columns), "feature", "x")
    values = values.filter(F.col("x").isNotNull() & ~F.isnan("x") & F.col("y").isNotNull()).groupBy("feature", "y", "x").agg(F.count("*").alias("w"))
    values = stored(values, "values")  # this and what follows is read several times: stored, so that it is made once
    labels = values.groupBy("feature", "y").agg(F.sum("w").alias("of_label")).filter("of_label > 1")
    cuts = values.groupBy("feature").agg(F.percentile_approx("x", F.array(*[F.lit(i / ranges) for i in range(1, ranges)]) if ranges > 1 else F.array(F.lit(0.5)), F.lit(1000)).alias("cuts"))
    cuts = stored(cuts, "cuts")  # a row a column
    d = values.join(labels, ["feature", "y"]).join(F.broadcast(cuts), "feature")
    d = stored(d.withColumn("range", range_of(F.col("x"), F.col("cuts"))).drop("cuts"), "ranges")

    # the radius: k values on either side, those at a range's ends from the ranges before and after
    own, k = ["feature", "y", "range"], neighbours
    ends = _ends(d, own, k)
    side = Window.partitionBy("feature", "y").orderBy("range")  # a row a range
    below = F.flatten(F.collect_list("high").over(side.rowsBetween(Window.unboundedPreceding, -1)))
    above = F.flatten(F.collect_list("low").over(side.rowsBetween(1, Window.unboundedFollowing)))
    halo = ends.select(*own, F.slice(F.sort_array(below, asc=False), 1, k).alias("below"), F.slice(F.sort_array(above), 1, k).alias("above"))
    halo = halo.select(*own, F.explode(F.concat("below", "above")).alias("h")).select(*own, "h.x", "h.w", F.lit(True).alias("halo"))
    both = d.select(*own, "x", "w", "of_label", F.lit(False).alias("halo")).unionByName(halo, allowMissingColumns=True)
    near = Window.partitionBy(*own).orderBy("x")
    around = F.filter(F.array(*[F.struct(F.abs(F.col("x") - f("x", i).over(near)).alias("d"), f("w", i).over(near).alias("w")) for f in (F.lag, F.lead) for i in range(1, k + 1)]), lambda s: s["d"].isNotNull())
    steps = F.sort_array(F.concat(F.array(F.struct(F.lit(0.0).alias("d"), (F.col("w") - 1).alias("w"))), around))
    reach = F.flatten(F.transform("steps", lambda s: F.array_repeat(s["d"], F.least(s["w"], F.lit(k)).cast("int"))))
    known = both.withColumn("steps", steps).filter("NOT halo").withColumn("k", F.least(F.lit(k), F.col("of_label") - 1))
    radius = known.select("feature", "y", "x", "w", "of_label", "k", F.get(reach, (F.col("k") - 1).cast("int")).alias("r"))

    # rows within the radius: ranks of x - r and x + r among all values of the column
    asked = radius.join(F.broadcast(cuts), "feature").withColumn("q", F.explode(F.array(F.struct((F.col("x") - F.col("r")).alias("at"), F.lit(2).alias("kind")), F.struct((F.col("x") + F.col("r")).alias("at"), F.lit(0).alias("kind")))))
    # with r = 0 the values equal to x count: up to x itself, without those below
    kind = F.when(F.col("r") > 0, F.col("q.kind")).otherwise(2 - F.col("q.kind"))
    asked = asked.select("feature", range_of(F.col("q.at"), F.col("cuts")).alias("range"), F.col("q.at").alias("at"), kind.alias("kind"), F.lit(0).cast("long").alias("w"), F.struct("y", "x", F.col("w").alias("times"), "of_label", "k", (F.col("q.kind") == 0).alias("upper")).alias("row"))
    told = d.select("feature", "range", F.col("x").alias("at"), F.lit(1).alias("kind"), "w").unionByName(asked, allowMissingColumns=True)
    counts = d.groupBy("feature", "range").agg(F.sum("w").alias("n"))
    every = told.select("feature", "range").distinct().join(counts, ["feature", "range"], "left")
    before = Window.partitionBy("feature").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    offsets = every.select("feature", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    local = F.sum("w").over(Window.partitionBy("feature", "range").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    ranks = told.withColumn("rank", local).filter("row IS NOT NULL").join(offsets, ["feature", "range"]).select("feature", "row.*", (F.col("rank") + F.col("before")).alias("rank"))
    within = ranks.groupBy("feature", "y", "x").agg((F.max(F.when(F.col("upper"), F.col("rank"))) - F.max(F.when(~F.col("upper"), F.col("rank")))).alias("m"), F.first("times").alias("times"), F.first("of_label").alias("of_label"), F.first("k").alias("k"))
    mean = lambda c: F.sum(F.col("times") * digamma(F.col(c).cast("double"))) / F.sum("times")
    mi = digamma(F.sum("times").cast("double")) + mean("k") - mean("of_label") - mean("m")
    found = within.groupBy("feature").agg(F.greatest(mi, F.lit(0.0)).alias("mi"))
    names = spark.createDataFrame([(c,) for c in columns], "feature string")
    return names.join(found, "feature", "left")


def _ends(d: DataFrame, own: list[str], k: int) -> DataFrame:
    """The k lowest and highest values of each label in each range, by place: no list of a whole range."""
    up, down = Window.partitionBy(*own).orderBy("x"), Window.partitionBy(*own).orderBy(F.desc("x"))
    placed = d.select(*own, F.struct("x", "w").alias("v"), F.row_number().over(up).alias("u"), F.row_number().over(down).alias("v_down")).filter((F.col("u") <= k) | (F.col("v_down") <= k))
    return placed.groupBy(*own).agg(F.collect_list(F.when(F.col("u") <= k, F.col("v"))).alias("low"), F.collect_list(F.when(F.col("v_down") <= k, F.col("v"))).alias("high"))
