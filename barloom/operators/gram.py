"""Sums of products of columns in one pass, mergeable by group, and what follows from them: correlations, components of
whole series and of rolling windows, and stored models of them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.frames import KEYS, TIME
from barloom.functions.longseries import BUCKET, numbered

SUMS = ("n", "sx", "sy", "sxx", "syy", "sxy")
#: Groups whose sums a task holds before it sends them on; numbers in them at most.
HELD = 8_000_000
#: A column's own variance below this share of its squares is rounding.
FLAT = 1e-13


def shifts(df: DataFrame, columns: Sequence[str]) -> list[float]:
    """A value near each column's middle (its own if it has but one; 0 without any): sums of squares about it stay exact."""
    if not columns:
        return []
    row = df.agg(*[F.when(F.min(c) == F.max(c), F.min(c)).otherwise(F.avg(c)).cast("double") for c in columns]).first()
    return [x if x is not None and np.isfinite(x) else 0.0 for x in row]


def moments(df: DataFrame, columns: Sequence[str], by: Sequence[str] = (), listwise: bool = False, shift: Sequence[float] | None = None) -> DataFrame:
    """(by, i, j, n, sx, sy, sxx, syy, sxy) for each pair of columns i <= j, by their places: sums over the group's rows
    that have both, or (listwise) all columns, of values less the shift. NaN counts as null.

    A task multiplies matrices of its rows and sends one row a group and pair; groups may be larger than any task."""
    d, shift = len(columns), np.asarray([0.0] * len(columns) if shift is None else shift)
    at_i, at_j = np.triu_indices(d)
    kinds = {f.name: f.dataType for f in df.schema}
    ddl = "".join(f"`{c}` {kinds[c].simpleString()}, " for c in by) + "i int, j int, n long, " + ", ".join(f"{c} double" for c in SUMS[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}

        def sent() -> Iterator[pa.RecordBatch]:
            for key, s in sums.items():
                heads = [pa.array([k] * len(at_i), t) for k, t in zip(key, types)]
                yield pa.RecordBatch.from_arrays([*heads, pa.array(at_i, pa.int32()), pa.array(at_j, pa.int32()), pa.array(s[0].astype(np.int64)), *map(pa.array, s[1:])], names=[*by, "i", "j", *SUMS])

        types: list[pa.DataType] = []
        for batch in batches:
            types = [batch.schema.field(c).type for c in by]
            x = np.column_stack([batch[f"__{k}"].to_numpy(zero_copy_only=False).astype(float) for k in range(d)]) - shift
            groups = pa.Table.from_batches([batch.select(list(by))]).to_pandas() if by else None
            parts = [((), np.arange(len(x)))] if groups is None else [(k if isinstance(k, tuple) else (k,), v) for k, v in groups.groupby(list(by), sort=False, dropna=False).indices.items()]
            for key, rows in parts:
                key = tuple(None if k != k else k for k in key)
                z = x[rows]
                there = ~np.isnan(z)
                if listwise:
                    z = z[there.all(axis=1)]
                    there = np.ones_like(z, bool)
                z, m = np.where(there, z, 0.0), there.astype(float)
                one, two, many = z.T @ m, (z * z).T @ m, z.T @ z
                new = np.stack([(m.T @ m)[at_i, at_j], one[at_i, at_j], one[at_j, at_i], two[at_i, at_j], two[at_j, at_i], many[at_i, at_j]])
                sums[key] = sums[key] + new if key in sums else new
            if len(sums) * len(at_i) * len(SUMS) > HELD:
                yield from sent()
                sums.clear()
        yield from sent()

    rows = df.select(*by, *[F.col(c).cast("double").alias(f"__{k}") for k, c in enumerate(columns)])
    return rows.mapInArrow(run, ddl).groupBy(*by, "i", "j").agg(*[F.sum(c).alias(c) for c in SUMS])


def correlation() -> Column:
    """Of moments(): null where one of the two does not vary."""
    own = lambda s, ss: F.when(F.col("n") > 1, F.col(ss) - F.col(s) * F.col(s) / F.col("n"))
    vx, vy = own("sx", "sxx"), own("sy", "syy")
    both = (vx > FLAT * F.col("sxx")) & (vy > FLAT * F.col("syy"))
    return F.when(both, (F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n")) / F.sqrt(vx * vy))


def correlations(df: DataFrame, columns: Sequence[str], listwise: bool = False) -> DataFrame:
    """(f1, f2, corr) for each pair f1 before f2, over the rows that have both (listwise: all columns); null where one
    does not vary or no rows are left. One aggregation for any number of columns."""
    found = moments(df, columns, (), listwise, shifts(df, columns)).filter("i < j").select("i", "j", correlation().alias("corr"))
    names = F.array(*[F.lit(c) for c in columns])
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1, len(columns))]
    every = df.sparkSession.createDataFrame(pairs, "i int, j int")  # without rows too
    return every.join(found, ["i", "j"], "left").select(names[F.col("i")].alias("f1"), names[F.col("j")].alias("f2"), "corr")


def _matrices(part: pd.DataFrame, d: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, sums and products of listwise moments."""
    n, one, two = int(part["n"].max()), np.zeros(d), np.zeros((d, d))
    i, j = part["i"].to_numpy(), part["j"].to_numpy()
    two[i, j] = two[j, i] = part["sxy"].to_numpy()
    one[i] = part["sx"].to_numpy()
    return n, one, two


MODEL = "columns array<string>, train_rows long, mean array<double>, std array<double>, eigenvalue array<double>, share array<double>, loadings array<array<double>>"


def _models(sums: DataFrame, columns: Sequence[str], by: Sequence[str], shift: Sequence[float], k: int | None) -> DataFrame:
    d = len(columns)
    kinds = {f.name: f.dataType.simpleString() for f in sums.schema}

    def fit(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        n, one, two = _matrices(part, d)
        if n < 2:
            return pd.DataFrame(columns=[*by, "columns", "train_rows", "mean", "std", "eigenvalue", "share", "loadings"])
        mean = one / n
        var = np.diag(two) - n * mean**2
        varies = var > FLAT * np.diag(two)
        std = np.where(varies, np.sqrt(np.maximum(var, 0) / (n - 1)), 1.0)
        cov = (two - n * np.outer(mean, mean)) / (n - 1) / np.outer(std, std)
        cov[~varies, :] = cov[:, ~varies] = 0.0
        values, vectors = np.linalg.eigh(cov)
        values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1].T
        vectors = vectors * np.sign(vectors[np.arange(d), np.abs(vectors).argmax(axis=1)])[:, None]
        row = [*key, list(columns), n, (mean + shift).tolist(), std.tolist(), values.tolist(), (values / max(values.sum(), 1e-300)).tolist(), vectors[:k].tolist()]
        return pd.DataFrame([row], columns=[*by, "columns", "train_rows", "mean", "std", "eigenvalue", "share", "loadings"])

    return sums.groupBy(*by).applyInPandas(fit, "".join(f"`{c}` {kinds[c]}, " for c in by) + MODEL)


def fit_components(train: DataFrame, columns: Sequence[str], by: Sequence[str] = KEYS, k: int | None = None) -> DataFrame:
    """A model for each series, one row each: principal components of its standardised columns, with shares of variance
    and eigenvalues of all and the loadings of the first k, the largest loading of each positive. Rows with nulls count
    for nothing, a series with fewer than two other rows has no model, a column that does not vary has loadings of 0 in
    all components with variance."""
    shift = shifts(train, columns)
    return _models(moments(train, columns, by, True, shift), columns, by, np.asarray(shift), k)


def window_models(df: DataFrame, columns: Sequence[str], windows: int = 100, train: float = 0.85, val: float = 0.10, seq_len: int = 4, offset: int = 1, samples: int = 5, k: int | None = None) -> DataFrame:
    """fit_components for the train rows of each of splits.rolling's windows (window_id), in one aggregation: rows are cut
    where a window's train ends, and a window's sums are those of all blocks up to its own."""
    step = offset * samples
    d = numbered(df)
    first, end_val = F.floor(F.col("__n") * train), F.floor(F.col("__n") * (train + val))
    some = F.floor((F.col("__n") - end_val - seq_len) / step) + 1  # windows whose test rows hold a sequence
    sizes = d.groupBy(*KEYS, BUCKET).agg(F.count("*").alias("n")).groupBy(*KEYS).agg(F.sum("n").alias("__n"))
    sizes = sizes.select(*KEYS, first.alias("__first"), F.least(F.lit(windows), some).cast("int").alias("__windows")).filter("__windows > 0")
    d = d.join(sizes, list(KEYS)).withColumn("window_id", F.greatest(F.lit(0), F.floor((F.col("__i") - F.col("__first")) / step) + 1).cast("int"))
    shift = shifts(df, columns)
    sums = moments(d.filter("window_id < __windows"), columns, (*KEYS, "window_id"), True, shift)
    pairs = F.array(*[F.struct(F.lit(int(i)).alias("i"), F.lit(int(j)).alias("j")) for i, j in zip(*np.triu_indices(len(columns)))])
    every = sizes.select(*KEYS, F.explode(F.sequence(F.lit(0), F.col("__windows") - 1)).alias("window_id")).select("*", F.explode(pairs).alias("p"))
    every = every.select(*KEYS, "window_id", "p.i", "p.j")
    so_far = Window.partitionBy(*KEYS, "i", "j").orderBy("window_id").rowsBetween(Window.unboundedPreceding, 0)  # a row a window
    summed = every.join(sums, [*KEYS, "window_id", "i", "j"], "left").select(*KEYS, "window_id", "i", "j", *[F.coalesce(F.sum(c).over(so_far), F.lit(0)).alias(c) for c in SUMS])
    return _models(summed, columns, (*KEYS, "window_id"), np.asarray(shift), k)


def counts_of(models: DataFrame) -> DataFrame:
    """How many components the usual rules keep, for each model: eigenvalue over 1, shares reached, over 5 % of the
    largest share, over the mean share."""
    share, cumulative = F.col("share"), lambda s: F.size(F.filter(F.transform("share", lambda x, i: F.aggregate(F.slice("share", 1, i + 1), F.lit(0.0), lambda a, b: a + b)), lambda x: x < s - 1e-12)) + 1
    keys = [c for c in models.columns if c not in {x.split()[0] for x in MODEL.split(", ")}]
    reached = {f"var_{int(s * 100)}": F.least(cumulative(s), F.size(share)).cast("int") for s in (0.7, 0.8, 0.9, 0.95, 0.98)}
    return models.select(
        *keys,
        "train_rows",
        F.size(F.filter("eigenvalue", lambda x: x > 1)).alias("kaiser"),
        *[c.alias(n) for n, c in reached.items()],
        F.size(F.filter(share, lambda x: x > 0.05 * F.array_max(share))).alias("elbow"),
        F.size(F.filter(share, lambda x: x > 1 / F.size(share))).alias("above_mean"),
    )


def apply_components(df: DataFrame, models: DataFrame, by: Sequence[str] = KEYS) -> DataFrame:
    """df with pc, an array of the components of each row by its series' model; null where a column is null, infinite or
    the series has no model. Several counts of components are slices of it."""
    columns = models.select("columns").first()
    if columns is None:
        return df.withColumn("pc", F.lit(None).cast("array<double>"))
    m = models.select(*by, F.struct("mean", "std", "loadings").alias("__m"))
    x = F.array(*[F.col(c).cast("double") for c in columns[0]])
    z = F.transform(x, lambda v, i: (v - F.col("__m.mean")[i]) / F.col("__m.std")[i])
    whole = ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    pc = F.transform(F.col("__m.loadings"), lambda row: F.aggregate(F.zip_with(F.col("__z"), row, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b))
    return df.join(m, list(by), "left").withColumn("__z", z).withColumn("pc", F.when(whole, pc)).drop("__m", "__z")


def export(df: DataFrame, k: int, keys: Sequence[str] = ("symbol",)) -> DataFrame:
    """The fixed column order of an export: keys, date, PC1..PCk, direction, close, split, from rows with pc."""
    return df.select(*keys, F.col(TIME).alias("date"), *[F.get("pc", F.lit(i)).alias(f"PC{i + 1}") for i in range(k)], "direction", "close", "split")


def save_models(models: DataFrame, path: str) -> None:
    """Models by series, each replacing the stored one of its series and leaving the others."""
    models.write.mode("overwrite").partitionBy(*[c for c in KEYS if c in models.columns]).option("partitionOverwriteMode", "dynamic").parquet(path)


def load_models(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """The stored models; raises where one was fitted on other columns or in another order."""
    models = spark.read.option("basePath", path).parquet(path)
    same = F.col("columns") == F.array(*[F.lit(c) for c in columns])
    other = F.raise_error(F.concat(F.lit("the model was fitted on "), F.concat_ws(", ", "columns")))
    return models.withColumn("columns", F.when(same, F.col("columns")).otherwise(other.cast("array<string>")))
