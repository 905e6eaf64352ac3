"""Alignment of time frames: tolerance, positional and as-of joins, all as equi-joins on derived keys."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from barloom.functions.longseries import BUCKET, ROWS, bucket_of, bucket_width, ema_long, ema_state, last_value_before


def _prefixed(df: DataFrame, prefix: str, skip: tuple[str, ...]) -> DataFrame:
    return df.select(*[F.col(c) if c in skip else F.col(c).alias(prefix + c) for c in df.columns])


def _seconds(x: str) -> Column:
    return F.unix_timestamp(F.col(x).cast("timestamp"))


def _clusters(rows: DataFrame, seconds: int, bucket_rows: int) -> DataFrame:
    """rows (symbol, t, ...) with cluster: the time from which no two rows in a row are more than `seconds` apart. Rows of
    different clusters are never as near as that. Two carries over a table of time buckets, no sort by symbol alone."""
    width = bucket_width(rows, ["symbol"], "at", bucket_rows)
    rows = rows.withColumn(BUCKET, bucket_of("at", width))
    own, before = Window.partitionBy("symbol", BUCKET).orderBy("t"), Window.partitionBy("symbol").orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    ends = rows.groupBy("symbol", BUCKET).agg(F.max("t").alias("end"), F.min("t").alias("begin"))
    ends = ends.withColumn("earlier", F.max("end").over(before))
    gap = F.col("t") - F.coalesce(F.lag("t").over(own), F.col("earlier"))
    marked = rows.join(ends.select("symbol", BUCKET, "earlier"), ["symbol", BUCKET]).withColumn("start", F.when(F.coalesce(gap > seconds, F.lit(True)), F.col("t")))
    starts = marked.groupBy("symbol", BUCKET).agg(F.max("start").alias("last"))
    carried = starts.select("symbol", BUCKET, F.max("last").over(before).alias("carried"))
    so_far = F.max("start").over(own.rangeBetween(Window.unboundedPreceding, 0))
    return marked.join(carried, ["symbol", BUCKET]).withColumn("cluster", F.coalesce(so_far, F.col("carried"))).drop(BUCKET, "earlier", "start", "carried")


def _matched(seconds: int):
    """A task's rows, sorted by cluster and time, in pairs: the oldest row without a partner of one side with the next row
    of the other, if it is near enough, each once. Rows wait only as long as one of the other side may still be near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = None, []
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if held is None else pa.concat_tables([held, rows])
            n, old = rows.num_rows, 0 if held is None else held.num_rows
            t, side = rows["t"].to_pylist(), rows["side"].to_pylist()
            key = list(zip(rows["symbol"].to_pylist(), rows["cluster"].to_pylist()))
            waiting, left, right = deque(range(old)), [], []
            for i in range(old, n):
                while waiting and (key[waiting[0]] != key[i] or side[waiting[0]] != side[i] and t[i] - t[waiting[0]] > seconds):
                    waiting.popleft()
                if waiting and side[waiting[0]] != side[i]:
                    j = waiting.popleft()
                    left.append(j if side[j] == 0 else i)
                    right.append(i if side[j] == 0 else j)
                else:
                    waiting.append(i)
            yield from pa.table({"a": rows["a"].take(pa.array(left, pa.int64())), "b": rows["b"].take(pa.array(right, pa.int64()))}).combine_chunks().to_batches()
            held = rows.take(pa.array(list(waiting), pa.int64()))

    return run


def tolerance_join(a: DataFrame, b: DataFrame, seconds: int = 60, from_later_start: bool = False, rows: int = ROWS) -> DataFrame:
    """Rows of a and b of one symbol whose timestamps are at most `seconds` apart, one to one; columns of b that a has too
    get the prefix dataset2_. Both sides are gone through in order of time: if the next two are near enough they are a
    pair, else the earlier one has no partner. Rows of one time go by a hash of all their columns. from_later_start leaves
    out what is before the later side's first row, by symbol. Null symbols and timestamps have no partner.

    Rows are cut into clusters at gaps wider than the tolerance, and clusters are dealt to tasks, each of which goes
    through its rows once, in order, and holds no more than those within the tolerance."""
    second = b.select("symbol", *[F.col(c).alias(f"dataset2_{c}" if c in a.columns else c) for c in b.columns if c not in ("symbol", "interval", "timestamp")], _seconds("timestamp").alias("dataset2_unix_timestamp"))
    first = a.withColumn("dataset1_unix_timestamp", _seconds("timestamp"))

    def side(df: DataFrame, time: str, number: int) -> DataFrame:
        row = F.struct(*[F.col(c) for c in df.columns if c != "symbol" or number == 0])
        return df.select("symbol", F.col(time).alias("t"), F.timestamp_seconds(time).alias("at"), F.lit(number).alias("side"), F.xxhash64(*df.columns).alias("tie"), row.alias("ab"[number])).filter("symbol IS NOT NULL AND t IS NOT NULL")

    left, right = side(first, "dataset1_unix_timestamp", 0), side(second, "dataset2_unix_timestamp", 1)
    if from_later_start:
        start = left.groupBy("symbol").agg(F.min("t").alias("l")).join(right.groupBy("symbol").agg(F.min("t").alias("r")), "symbol").select("symbol", F.greatest("l", "r").alias("start"))
        left, right = (x.join(start, "symbol").filter("t >= start").drop("start") for x in (left, right))
    both = _clusters(left.unionByName(right, allowMissingColumns=True), seconds, rows)
    order = both.select("symbol", "cluster", "t", "side", "tie", "a", "b").repartition("symbol", "cluster").sortWithinPartitions("symbol", "cluster", "t", "side", "tie")
    pairs = order.mapInArrow(_matched(seconds), T.StructType([order.schema["a"], order.schema["b"]]))
    return pairs.select("a.*", "b.*")


def numbered(df: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """df with pos: 0, 1, ... in each symbol, counted from the first row that is not before start (symbol, start)."""
    if start is not None:
        df = df.join(start, "symbol").filter(F.col("timestamp") >= F.col("start")).drop("start")
    return df.withColumn("pos", F.row_number().over(Window.partitionBy("symbol").orderBy("timestamp")) - 1)


def common_start(*frames: DataFrame) -> DataFrame:
    """(symbol, start): the latest first timestamp of the frames; symbols that one lacks are left out."""
    firsts = [f.groupBy("symbol").agg(F.min("timestamp").alias(f"s{i}")) for i, f in enumerate(frames)]
    out = firsts[0]
    for f in firsts[1:]:
        out = out.join(f, "symbol")
    return out.select("symbol", F.greatest(*[f"s{i}" for i in range(len(frames))]).alias("start") if len(frames) > 1 else F.col("s0").alias("start"))


def positional_1_to_3(long: DataFrame, short: DataFrame, prefix: str = "4h_batch", values: tuple[str, ...] = ("close", "volume")) -> DataFrame:
    """The k-th bar of long with the bars 3k, 3k+1, 3k+2 of short, as columns prefix1_x .. prefix3_x; both counted
    from their common start; a bar without all three has no row."""
    start = common_start(long, short)
    numbers = numbered(short, start).withColumn("slot", F.col("pos") % 3 + 1).withColumn("pos", F.floor(F.col("pos") / 3))
    wide = numbers.groupBy("symbol", "pos").agg(F.count("*").alias("__n"), *[F.max(F.when(F.col("slot") == k, F.col(v))).alias(f"{prefix}{k}_{v}") for k in (1, 2, 3) for v in values])
    return numbered(long, start).withColumn("pos", F.col("pos").cast("long")).join(wide.filter("__n = 3").drop("__n"), ["symbol", "pos"])


def positional_2_to_1(short: DataFrame, long: DataFrame, prefix: str = "1d_") -> DataFrame:
    """Each bar of long beside two bars of short in a row, from their common start; a half pair at the end goes."""
    start = common_start(short, long)
    small = numbered(short, start).withColumn("pair", F.floor(F.col("pos") / 2))
    small = small.withColumn("__n", F.count("*").over(Window.partitionBy("symbol", "pair"))).filter("__n = 2").drop("__n")
    big = _prefixed(numbered(long, start).drop("interval"), prefix, ("symbol", "pos")).withColumn("pair", F.col("pos").cast("long")).drop("pos")
    return small.join(big, ["symbol", "pair"])


def three_frames(half_day: DataFrame, four_hours: DataFrame, day: DataFrame) -> DataFrame:
    """12-hour bars with their three 4-hour bars and their day, each counted from the common start of all three."""
    start = common_start(half_day, four_hours, day)
    late = [f.join(start, "symbol").filter(F.col("timestamp") >= F.col("start")).drop("start") for f in (half_day, four_hours, day)]
    joined = positional_1_to_3(late[0], late[1])
    days = _prefixed(numbered(late[2]).drop("interval"), "1d_", ("symbol", "pos")).withColumnRenamed("pos", "pair")
    return joined.withColumn("pair", F.floor(F.col("pos") / 2).cast("int")).join(days, ["symbol", "pair"])


def last_before(trades: DataFrame, boundaries: DataFrame, rows: int = ROWS) -> DataFrame:
    """For each boundary (symbol, boundary) the last trade strictly before it: (symbol, boundary, price, ts), null
    where there is none. Trades of one time go by event_id. Time is cut into buckets of about `rows` trades, so that no
    symbol is sorted as a whole; no pairs are made."""
    ticks = trades.select("symbol", F.col("ts").alias("t"), "price", "event_id")
    edges = boundaries.select("symbol", F.col("boundary").alias("t"))
    found = last_value_before(ticks, edges, "symbol", F.struct("price", F.col("t").alias("ts")), ["event_id"], rows)
    return found.select("symbol", F.col("t").alias("boundary"), "last.price", "last.ts")


def append_newer(old: DataFrame, new: DataFrame) -> DataFrame:
    """old and the rows of new that are later than the last of old, by symbol; all of new where old has none."""
    last = old.groupBy("symbol").agg(F.max("timestamp").alias("__m"))
    later = new.join(last, "symbol", "left").filter(F.col("__m").isNull() | (F.col("timestamp") > F.col("__m"))).drop("__m")
    return old.unionByName(later)


def prepend_older(old: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of new that are earlier than the first of old, by symbol, and old."""
    first = old.groupBy("symbol").agg(F.min("timestamp").alias("__m"))
    return new.join(first, "symbol", "left").filter(F.col("__m").isNull() | (F.col("timestamp") < F.col("__m"))).drop("__m").unionByName(old)


def append_features(features: DataFrame, new_bars: DataFrame, pipeline, lookback: int = 50) -> DataFrame:
    """features and the pipeline's rows for new_bars, computed over them and the last `lookback` stored bars. The
    recursive averages restart there, so values differ a little from a full run; a longer lookback brings them nearer.
    """
    bars = [c for c in ("symbol", "interval", "timestamp", "open", "high", "low", "close", "volume") if c in features.columns]
    recent = features.withColumn("__r", F.row_number().over(Window.partitionBy("symbol", "interval").orderBy(F.desc("timestamp")))).filter(F.col("__r") <= lookback).select(*bars)
    last = features.groupBy("symbol", "interval").agg(F.max("timestamp").alias("__m"))
    out = pipeline(recent.unionByName(new_bars.select(*bars))).join(last, ["symbol", "interval"], "left")
    return features.unionByName(out.filter(F.col("__m").isNull() | (F.col("timestamp") > F.col("__m"))).drop("__m"))


def common_rows(frames: list[DataFrame], features: list[str]) -> DataFrame:
    """(symbol, interval, timestamp, features) of the rows that all frames have; each feature from the first frame that
    has it, null as 0. A feature of no frame raises. Each frame keeps only what it gives, so all joins are on one key."""
    keys, left, out = ["symbol", "interval", "timestamp"], list(features), None
    for f in frames:
        own = [c for c in left if c in f.columns]
        left = [c for c in left if c not in own]
        part = f.select(*keys, *own)
        out = part if out is None else out.join(part, keys)
    if left:
        raise ValueError(f"no frame has {', '.join(left)}")
    return out.select(*keys, *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in features])


def append_averages(old: DataFrame, state: DataFrame, new_bars: DataFrame, wanted: dict[str, tuple[str, str, float]]) -> tuple[DataFrame, DataFrame]:
    """old (bars with averages) and the rows of new_bars with theirs, exactly as in one run over all bars, and the state
    to store for the next append; nothing is computed again. new_bars are later than old, by series."""
    new = ema_long(new_bars, wanted, state=state)
    return old.unionByName(new.select(*old.columns)), ema_state(new_bars, wanted, state=state)
