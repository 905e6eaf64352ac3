"""Chronological splits, fitted parameters, sequences, cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.frames import KEYS, TIME, row_index, series
from barloom.functions.quantiles import column_quantiles


def chronological(df: DataFrame, train: float = 0.7, val: float = 0.15) -> DataFrame:
    """df with split: the first train share of each series, the next val share, the rest is test (cut like int())."""
    n = F.count("*").over(Window.partitionBy(*KEYS))
    i = row_index()
    return df.withColumn("split", F.when(i < F.floor(n * train), "train").when(i < F.floor(n * (train + val)), "val").otherwise("test"))


def fixed(df: DataFrame, val_start: int, val_rows: int) -> DataFrame:
    """df with split by place: val from row val_start (from 1) on for val_rows rows."""
    i = row_index() + 1
    return df.withColumn("split", F.when(i < val_start, "train").when(i < val_start + val_rows, "val").otherwise("test"))


def rolling(df: DataFrame, windows: int, train: float = 0.85, val: float = 0.10, seq_len: int = 4, offset: int = 1, samples: int = 5) -> DataFrame:
    """df for each rolling window (window_id): train and val end by growing shares, each window `offset * samples`
    rows further; the test rows follow and shrink at the end; rows after are "unknown". A window whose test would not
    hold seq_len rows ends the series."""
    step = offset * samples
    n = F.count("*").over(Window.partitionBy(*KEYS))
    base = df.withColumn("__n", n).withColumn("__i", row_index()).withColumn("window_id", F.explode(F.sequence(F.lit(0), F.lit(windows - 1))))
    end_train = F.floor(F.col("__n") * train) + step * F.col("window_id")
    end_val = F.floor(F.col("__n") * (train + val)) + step * F.col("window_id")
    left = F.col("__n") - end_val
    size = F.least(F.lit(seq_len + offset * (samples - 1)), left)
    i = F.col("__i")
    out = base.filter(left >= seq_len).withColumn("split", F.when(i < end_train, "train").when(i < end_val, "val").when(i < end_val + size, "test").otherwise("unknown"))
    return out.drop("__n", "__i")


def rolling_fixed(df: DataFrame, windows: int, val_start: int, val_rows: int, seq_len: int = 4, offset: int = 1, samples: int = 5) -> DataFrame:
    """df for each rolling window (window_id) with fixed places: val begins at row val_start (from 1), `offset * samples`
    rows further in each window, and takes one row more than val_rows, the one between val and test. The test rows
    follow and shrink at the end; rows after are "unknown". A window whose test would not hold seq_len rows ends."""
    n, i = F.count("*").over(Window.partitionBy(*KEYS)), F.col("__i")
    base = df.withColumn("__n", n).withColumn("__i", row_index()).withColumn("window_id", F.explode(F.sequence(F.lit(0), F.lit(windows - 1))))
    start = F.lit(val_start - 1) + offset * samples * F.col("window_id")
    end = start + val_rows + 1
    size = F.least(F.lit(seq_len + offset * (samples - 1)), F.col("__n") - end)
    split = F.when(i < start, "train").when(i < end, "val").when(i < end + size, "test").otherwise("unknown")
    return base.filter(F.col("__n") - end >= seq_len).withColumn("split", split).drop("__n", "__i")


def fit_zscore(df: DataFrame, features: list[str], skip: int = 0) -> DataFrame:
    """(symbol, interval, feature, mean, std) over the train rows from row `skip` on; a std of 0 or none counts as 1,
    a mean of nothing as 0. One aggregation for all features."""
    train = df.withColumn("__i", row_index()).filter((F.col("split") == "train") & (F.col("__i") >= skip))
    wide = train.groupBy(*KEYS).agg(*[F.struct(F.coalesce(F.avg(c), F.lit(0.0)).alias("mean"), F.coalesce(F.when(F.stddev_samp(c) > 0, F.stddev_samp(c)), F.lit(1.0)).alias("std")).alias(c) for c in features])
    return wide.unpivot(list(KEYS), features, "feature", "p").select(*KEYS, "feature", "p.mean", "p.std")


def apply_zscore(df: DataFrame, params: DataFrame, features: list[str]) -> DataFrame:
    """df with x_norm for each feature; parameters missing for a series raise."""
    wide = params.groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "std")))).alias("__p"))
    joined = df.join(wide, list(KEYS), "left")
    p = lambda c: F.when(F.col("__p").isNull() | F.col("__p")[c].isNull(), F.raise_error(F.lit(f"no parameters for {c}"))).otherwise(F.col("__p")[c])
    return joined.withColumns({f"{c}_norm": (F.col(c) - p(c)["mean"]) / p(c)["std"] for c in features}).drop("__p")


def undo_zscore(df: DataFrame, params: DataFrame, features: list[str]) -> DataFrame:
    wide = params.groupBy(*KEYS).agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "std")))).alias("__p"))
    return df.join(wide, list(KEYS), "left").withColumns({c: F.col(f"{c}_norm") * F.col("__p")[c]["std"] + F.col("__p")[c]["mean"] for c in features}).drop("__p")


def sequences(df: DataFrame, features: list[str], target: str, length: int) -> DataFrame:
    """A row for each window of `length` rows but the last: seq_start, x (array of arrays), y (of its last row)."""
    w = series().rowsBetween(0, length - 1)
    x = F.collect_list(F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in features])).over(w)
    n = F.count("*").over(Window.partitionBy(*KEYS))
    i = row_index()
    out = df.select(*KEYS, F.col(TIME).alias("seq_start"), x.alias("x"), F.lead(target, length - 1).over(series()).alias("y"), (i < n - length).alias("__ok"))
    return out.filter("__ok").drop("__ok")


def winsorize(df: DataFrame, columns: list[str]) -> DataFrame:
    """Values beyond five times the 1..99 percentile range outside it are drawn in, by series."""
    q = column_quantiles(df, KEYS, columns, [0.01, 0.99])
    bound: dict[str, Column] = {}
    for c in columns:
        lo, hi = F.col(f"__q_{c}")[0], F.col(f"__q_{c}")[1]
        bound[c] = F.when(F.col(c).isNotNull(), F.least(F.greatest(F.col(c), lo - 5 * (hi - lo)), hi + 5 * (hi - lo)))
    return df.join(q, list(KEYS), "left").withColumns(bound).drop(*[f"__q_{c}" for c in columns])


def median_fill(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls, NaN and infinities become the median of the train rows (split), by series."""
    clean = df.withColumns({c: F.when(F.isnan(c) | F.col(c).isin(float("inf"), float("-inf")), None).otherwise(F.col(c)) for c in columns})
    q = column_quantiles(clean.filter("split = 'train'"), KEYS, columns, [0.5])
    return clean.join(q, list(KEYS), "left").withColumns({c: F.coalesce(F.col(c), F.col(f"__q_{c}")[0]) for c in columns}).drop(*[f"__q_{c}" for c in columns])


FORMATS = ("yyyy-MM-dd HH:mm:ss", "M/d/yy HH:mm", "yyyy/MM/dd HH:mm:ss", "d/M/yyyy HH:mm", "yyyy-MM-dd'T'HH:mm:ss", "M/d/yyyy h:mm:ss a")


def parse_time(x: str) -> Column:
    """Epoch seconds, or the first format that fits; null otherwise."""
    epoch = F.timestamp_seconds(F.col(x).try_cast("bigint"))
    return F.coalesce(epoch, *[F.try_to_timestamp(F.col(x), F.lit(f)) for f in FORMATS])


def short_time(x: str) -> Column:
    """Month/day/year and time without leading zeros of month and day."""
    return F.date_format(x, "M/d/yy HH:mm")
