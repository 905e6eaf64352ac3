"""Trend lines over windows of bars: candidate lines, rejection, touches, offsets, breakout.

A window is the unit of work: rows carry window_id and bar (place in the window), so all joins are equi-joins on the
window and its fan-out is bounded by the window's size."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.frames import KEYS, row_index


def windows(df: DataFrame, size: int = 50, step: int = 50) -> DataFrame:
    """(symbol, window_id, bar, open, high, low, close): windows that begin every step rows and are full."""
    n = F.count("*").over(Window.partitionBy(*KEYS))
    base = df.select(*KEYS, "open", "high", "low", "close", row_index().alias("i"), n.alias("n"))
    first, last = F.greatest(F.lit(0), F.ceil((F.col("i") - size + 1) / step)), F.floor(F.col("i") / step)
    many = base.withColumn("window_id", F.explode(F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))))
    return many.filter(F.col("window_id") * step + size <= F.col("n")).select("symbol", "interval", "window_id", (F.col("i") - F.col("window_id") * step).cast("int").alias("bar"), "open", "high", "low", "close")


WINDOW = ["symbol", "interval", "window_id"]


def trend(w: DataFrame) -> DataFrame:
    """(window, trend): UP, DOWN or None by the sum of close - open."""
    s = F.sum(F.col("close") - F.col("open"))
    return w.groupBy(*WINDOW).agg(F.when(s > 0, "UP").when(s < 0, "DOWN").otherwise("None").alias("trend"))


def wick_overlaps(w: DataFrame) -> DataFrame:
    """(window, bar, upper array, lower array): the other bars whose upper, and lower, wick ranges overlap the bar's."""
    wick = w.select(*WINDOW, "bar", "high", "low", F.greatest("open", "close").alias("top"), F.least("open", "close").alias("bottom"))
    other = wick.select(*WINDOW, *[F.col(c).alias(f"o_{c}") for c in ("bar", "high", "low", "top", "bottom")])
    upper = (F.col("top") <= F.col("o_high")) & (F.col("o_top") <= F.col("high"))
    lower = (F.col("low") <= F.col("o_bottom")) & (F.col("o_low") <= F.col("bottom"))
    pairs = wick.join(other, WINDOW).filter(F.col("bar") != F.col("o_bar"))
    return pairs.groupBy(*WINDOW, "bar").agg(F.sort_array(F.collect_list(F.when(upper, F.col("o_bar")))).alias("upper"), F.sort_array(F.collect_list(F.when(lower, F.col("o_bar")))).alias("lower"))


def trend_lines(w: DataFrame, grid: int = 5, least: int = 3, exact: bool = False, decimals: int = 6) -> DataFrame:
    """(window, trend, x1, y1, x2, y2, touches): lines through the wicks of two bars that cross no body, leave no bar
    on their wrong side, touch at least (or exactly) `least` wicks, and slope with the trend.

    Each end takes grid + 1 heights between wick tip and body edge: below the bars of an UP window, above those of a
    DOWN one. The body test is half-open, so a bar without a body is never crossed.

    A window becomes one row with its bars in an array, dealt once; a line is judged where it is made, up to the first
    bar that forbids it, so no rows of lines times bars are made."""
    bar = F.struct("bar", "open", "high", "low", "close", F.least("open", "close").alias("bottom"), F.greatest("open", "close").alias("top"))
    one = w.groupBy(*WINDOW).agg(F.sort_array(F.collect_list(bar)).alias("bars"), F.sum(F.col("close") - F.col("open")).alias("s"))
    one = one.filter("s <> 0").withColumn("trend", F.when(F.col("s") > 0, "UP").otherwise("DOWN"))
    # a window is few bytes and much work, so its partitions are dealt by number and not coalesced by size
    one = one.repartition(int(w.sparkSession.conf.get("spark.sql.shuffle.partitions")), *WINDOW)
    up = F.col("trend") == "UP"
    tip, edge = lambda b: F.when(up, b["low"]).otherwise(b["high"]), lambda b: F.when(up, b["bottom"]).otherwise(b["top"])

    def heights(b: Column) -> Column:
        ys = F.transform(F.sequence(F.lit(0), F.lit(grid)), lambda k: tip(b) + (edge(b) - tip(b)) * k / grid)
        return F.transform(F.array_distinct(ys), lambda y: F.struct(b["bar"].alias("x"), y.alias("y")))

    points = one.withColumn("points", F.flatten(F.transform("bars", heights))).withColumn("p", F.explode("points"))
    slope = lambda q: (q["y"] - F.col("p.y")) / (q["x"] - F.col("p.x"))

    def forbidden(b: Column, q: Column) -> Column:
        y = F.col("p.y") + slope(q) * (b["bar"] - F.col("p.x"))
        return ((b["bottom"] <= y) & (y < b["top"])) | F.when(up, y > b["high"]).otherwise(y < b["low"])

    def stays(q: Column) -> Column:
        later = (q["x"] > F.col("p.x")) & F.when(up, q["y"] >= F.col("p.y")).otherwise(q["y"] <= F.col("p.y"))
        return F.when(later, ~F.exists("bars", lambda b: forbidden(b, q))).otherwise(False)

    lines = points.withColumn("q", F.explode(F.filter("points", stays)))

    def touched(b: Column) -> Column:
        at, t, e = F.round(F.col("p.y") + slope(F.col("q")) * (b["bar"] - F.col("p.x")), decimals), F.round(tip(b), decimals), F.round(edge(b), decimals)
        return (F.least(t, e) <= at) & (at <= F.greatest(t, e))

    judged = lines.select(*WINDOW, "trend", F.col("p.x").alias("x1"), F.col("p.y").alias("y1"), F.col("q.x").alias("x2"), F.col("q.y").alias("y2"), F.size(F.filter("bars", touched)).cast("long").alias("touches"))
    return judged.filter(F.col("touches") == least if exact else F.col("touches") >= least)


def clear_offset(lines: DataFrame, w: DataFrame, tick: float, beyond: bool = True) -> DataFrame:
    """lines with offset: the fewest ticks, at least 1, by which a line moved through the bars crosses no body again
    (up for UP windows, down for DOWN). Closed form: each body forbids an interval of ticks; the first gap wins."""
    sign = F.when(F.col("trend") == "UP", 1.0).otherwise(-1.0)
    keys = [*WINDOW, "trend", "x1", "y1", "x2", "y2", "touches"]
    slope = (F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1"))
    y = F.col("y1") + slope * (F.col("bar") - F.col("x1"))
    lo = (F.when(sign > 0, F.least("open", "close")).otherwise(F.greatest("open", "close")) - y) * sign / tick
    hi = (F.when(sign > 0, F.greatest("open", "close")).otherwise(F.least("open", "close")) - y) * sign / tick
    spans = lines.join(w, WINDOW).withColumn("lo", F.ceil(lo)).withColumn("hi", F.ceil(hi))
    spans = spans.withColumns({c: F.when(F.col("hi") > F.col("lo"), F.col(c)) for c in ("lo", "hi")})  # else nothing is forbidden
    order = Window.partitionBy(*keys).orderBy("lo", "hi")
    reach = F.greatest(F.lit(1), F.coalesce(F.max("hi").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(1)))
    gaps = spans.withColumn("reach", reach).groupBy(*keys).agg(F.min(F.when(F.col("lo") > F.col("reach"), F.col("reach"))).alias("gap"), F.greatest(F.lit(1), F.max("hi")).alias("end"))
    return gaps.select(*keys, F.coalesce("gap", "end").alias("offset"))


def best_lines(lines: DataFrame) -> DataFrame:
    """The line of each window with most touches; of equals the flattest, then the first."""
    w = Window.partitionBy(*WINDOW).orderBy(F.desc("touches"), F.abs((F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1"))), "x1", "x2", "y1", "y2")
    return lines.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def _bars(w: DataFrame) -> DataFrame:
    """A row for each window with its bars, and the height of its range."""
    bar = F.struct("bar", "open", "high", "low", "close", F.least("open", "close").alias("bottom"), F.greatest("open", "close").alias("top"))
    return w.groupBy(*WINDOW).agg(F.sort_array(F.collect_list(bar)).alias("bars"), (F.max("high") - F.min("low")).alias("range"))


def _height(at: Column, shift: Column) -> Column:
    """Of a line moved through the bars by shift, at a bar."""
    slope = (F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1"))
    return F.col("y1") + F.when(F.col("trend") == "UP", 1.0).otherwise(-1.0) * shift + slope * (at - F.col("x1"))


def _wicks(shift: Column, lower: Column, decimals: int) -> Column:
    """How many lower, or upper, wicks a line touches that is moved by shift."""

    def touched(b: Column) -> Column:
        y = F.round(_height(b["bar"], shift), decimals)
        return F.when(lower, (b["low"] <= y) & (y <= b["bottom"])).otherwise((b["top"] <= y) & (y <= b["high"]))

    return F.size(F.filter("bars", touched))


def _ticks(tick: float, *counts: Column) -> Column:
    """The product of whole numbers and a tick that has a few decimals, as the nearest double: 35 ticks of 0.01 are 0.35.
    Lines that are moved by ticks come to lie on prices, so that a last bit decides what they touch."""
    exact = F.lit(Decimal(repr(tick)))
    for n in counts:
        exact = exact * n.cast("decimal(10,0)")
    return exact.cast("double")


def middle_lines(lines: DataFrame, w: DataFrame, tick: float, ratio: float = 0.2, decimals: int = 6) -> DataFrame:
    """lines (with the offset of clear_offset) with shift and score: the best places between a line and its cleared
    copy. Places are one tick off the line and then every `ratio` of the gap; the score is the wicks touched there less
    the bodies that the cleared copy crosses. All places with a line's best score stay, so a line may have several
    rows; a gap of one tick has no place and its line goes."""
    gap = _ticks(tick, F.col("offset"))
    crossed = lambda b: (b["bottom"] <= _height(b["bar"], gap)) & (_height(b["bar"], gap) < b["top"])
    places = F.filter(F.transform(F.sequence(F.lit(0), F.lit(int(1 / ratio))), lambda k: F.lit(tick) + _ticks(tick, F.col("offset"), k) * ratio), lambda t: t < gap)
    made = lines.join(_bars(w), WINDOW).withColumn("bodies", F.size(F.filter("bars", crossed))).withColumn("shift", F.explode(places))
    made = made.withColumn("score", _wicks(F.col("shift"), F.col("trend") == "UP", decimals) - F.col("bodies"))
    best = F.max("score").over(Window.partitionBy(*lines.columns))
    return made.withColumn("best", best).filter("score = best").select(*lines.columns, "shift", "score")


def far_lines(middles: DataFrame, w: DataFrame, ratio: float = 0.2, decimals: int = 6) -> DataFrame:
    """middles with far_shift, far_touches and back_shift. The far line lies beyond the middle one, by one to two times
    the distance from line to middle in steps of 2 * ratio, where it touches most wicks of the other side, of equals
    the nearest. The new line lies back_shift to the other side of the line: the higher end's low (of DOWN windows:
    high) and 5 % of the window's range away, but no farther than the middle one."""
    up = F.col("trend") == "UP"
    steps = F.filter(F.transform(F.sequence(F.lit(0), F.lit(int(1 / ratio))), lambda k: F.col("shift") * (1 + 2 * ratio * k)), lambda t: t < 2 * F.col("shift"))
    made = middles.join(_bars(w), WINDOW)
    options = F.transform(steps, lambda t: F.struct(_wicks(F.col("shift") + t, ~up, decimals).alias("touches"), (-t).alias("near")))
    bar = lambda x: F.element_at("bars", F.col(x) + 1)  # noqa: E731  windows are full, so bar k is the k-th
    end = lambda x: F.when(up, bar(x)["low"]).otherwise(bar(x)["high"])
    back = F.abs(F.col("y1") - F.greatest(end("x1"), end("x2"))) + 0.05 * F.col("range")
    made = made.withColumn("far", F.array_max(options)).withColumn("back_shift", F.least(back, "shift"))
    return made.select(*middles.columns, (F.col("shift") - F.col("far.near")).alias("far_shift"), F.col("far.touches").alias("far_touches"), "back_shift")


def best_far_lines(far: DataFrame) -> DataFrame:
    """The row of each window whose far line touches most; of equals the flattest of those that rise, else the first."""
    slope = (F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1"))
    w = Window.partitionBy(*WINDOW).orderBy(F.desc("far_touches"), F.when(slope > 0, slope).asc_nulls_last(), "x1", "y1", "x2", "y2", "shift")
    return far.withColumn("__r", F.row_number().over(w)).filter("__r = 1").drop("__r")


def channel_breakouts(best: DataFrame, df: DataFrame, tick: float, size: int = 50, step: int = 50, ahead: int = 50) -> DataFrame:
    """best (of far lines) with breakout: the first bar after the window, counted from its start, that leaves the channel:
    below the new line or above the cleared copy of an UP window, the reverse for DOWN; null if none ever does.

    The next `ahead` bars are looked at first. Windows that are still open go on to blocks of `ahead` bars whose highest
    or lowest price may leave the channel, to the end of the series."""
    up = F.col("trend") == "UP"
    at = F.col("i") - F.col("window_id") * step
    # a shift is added to the height of the line itself, in this order: flat lines often meet prices exactly
    sign, back, over = F.when(up, 1.0).otherwise(-1.0), -F.col("back_shift"), _ticks(tick, F.col("offset"))
    near, clear = _height(at, F.lit(0.0)) + sign * back, _height(at, F.lit(0.0)) + sign * over
    left = F.when(up, (F.col("low") < near) | (F.col("high") > clear)).otherwise((F.col("high") > near) | (F.col("low") < clear))
    bars = df.select(*KEYS, row_index().alias("i"), "high", "low").withColumn("block", F.floor(F.col("i") / ahead))
    start = F.col("window_id") * step + size

    def first(lines: DataFrame) -> DataFrame:
        hit = F.min(F.when(left & (F.col("i") >= start), at)).alias("breakout")
        return lines.join(bars, [*KEYS, "block"], "left").groupBy(*best.columns).agg(hit)

    soon = first(best.withColumn("block", F.explode(F.sequence(F.floor(start / ahead), F.floor((start + ahead - 1) / ahead)))))
    blocks = bars.groupBy(*KEYS, "block").agg(F.max("high").alias("high"), F.min("low").alias("low"), F.min("i").alias("a"), F.max("i").alias("b"))
    edge = lambda shift, x: _height(F.col(x) - F.col("window_id") * step, shift)
    below = lambda shift: F.col("low") < F.greatest(edge(shift, "a"), edge(shift, "b")) + tick / 2  # noqa: E731  the bars are judged exactly
    above = lambda shift: F.col("high") > F.least(edge(shift, "a"), edge(shift, "b")) - tick / 2
    may = F.when(up, below(back) | above(over)).otherwise(above(back) | below(over))
    still = soon.filter("breakout is null").drop("breakout").join(blocks, list(KEYS)).filter((F.col("b") >= start) & may).select(*best.columns, "block")
    later = first(still).withColumnRenamed("breakout", "later")
    joined = soon.join(later, list(best.columns), "left")
    return joined.withColumn("breakout", F.coalesce("breakout", "later")).drop("later")


def breakouts(lines: DataFrame, df: DataFrame, size: int = 50, step: int = 50, ahead: int = 50) -> DataFrame:
    """lines with breakout: the first of the next `ahead` bars after the window whose body the line crosses; null if
    none does."""
    bars = df.select(*KEYS, row_index().alias("i"), "open", "close")
    near = lines.withColumn("block", F.explode(F.sequence(F.floor((F.col("window_id") * step + size) / ahead), F.floor((F.col("window_id") * step + size + ahead - 1) / ahead))))
    joined = near.join(bars.withColumn("block", F.floor(F.col("i") / ahead)), [*KEYS, "block"], "left")
    x = F.col("i") - F.col("window_id") * step
    y = F.col("y1") + (F.col("y2") - F.col("y1")) / (F.col("x2") - F.col("x1")) * (x - F.col("x1"))
    hit = (x >= size) & (x < size + ahead) & (F.least("open", "close") <= y) & (y < F.greatest("open", "close"))
    return joined.groupBy(*lines.columns).agg(F.min(F.when(hit, x)).alias("breakout"))


def intersection(slope_a: Column, level_a: Column, slope_b: Column, level_b: Column) -> Column:
    """(x, y) where two lines y = slope * x + level meet; null where they are parallel."""
    x = F.try_divide(level_b - level_a, slope_a - slope_b)
    return F.when(x.isNotNull(), F.struct(x.alias("x"), (slope_a * x + level_a).alias("y")))
