"""Descriptions, correlations, pruning, components, selection. Statistics are Spark aggregations; only matrices of
features by features come to the driver."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import PCA, RobustScaler, StandardScaler, VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from barloom.functions.frames import KEYS, div, lag, roll
from barloom.functions.quantiles import column_quantiles, quantiles
from barloom.operators.gram import correlations


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each column: n, nulls, zeros, mean, std, min, p25, median, p75, max, outliers (beyond 1.5 IQR)."""
    long = df.select(*[F.col(c).cast("double") for c in columns]).unpivot([], columns, "feature", "x")
    q = long.groupBy("feature").agg(
        F.count("*").alias("n"), F.count_if(F.col("x").isNull()).alias("nulls"), F.count_if(F.col("x") == 0).alias("zeros"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.min("x").alias("min"), F.max("x").alias("max")
    )
    cuts = quantiles(long, ["feature"], "x", [0.25, 0.5, 0.75]).select("feature", *[F.col("q")[i].alias(c) for i, c in enumerate(("p25", "median", "p75"))])
    q = q.join(cuts, "feature", "left")
    lo, hi = F.col("p25") - 1.5 * (F.col("p75") - F.col("p25")), F.col("p75") + 1.5 * (F.col("p75") - F.col("p25"))
    out = long.join(q, "feature").groupBy("feature").agg(F.count_if((F.col("x") < lo) | (F.col("x") > hi)).alias("outliers"))
    return q.join(out, "feature")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def time_range(df: DataFrame) -> DataFrame:
    return df.groupBy(*KEYS).agg(F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.count("*").alias("n"))


def _corr(a: str, b: str) -> Column:
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    both = x.isNotNull() & y.isNotNull()
    px, py = F.when(both, x), F.when(both, y)
    return div(F.covar_samp(px, py), F.stddev_samp(px) * F.stddev_samp(py))


def high_pairs(df: DataFrame, columns: list[str], least: float = 0.7) -> DataFrame:
    return correlations(df, columns).filter(F.abs("corr") > least)


def prune_correlated(df: DataFrame, columns: list[str], most: float = 0.95, target: str | None = None) -> list[str]:
    """The columns that stay when of each pair above `most` one goes: the one less correlated with the target, or the
    second; pairs by falling correlation; exact copies (1) stay without a target. The matrix is small."""
    pairs = [(r["f1"], r["f2"], abs(r["corr"])) for r in high_pairs(df, columns, most).collect()]
    power = {}
    if target:
        others = [c for c in columns if c != target]
        row = df.agg(*[_corr(c, target).alias(c) for c in others]).first()
        power = {c: abs(row[c] or 0.0) for c in others}
    gone: set[str] = set()
    for a, b, r in sorted(pairs, key=lambda x: (-x[2], x[0], x[1])):
        if a in gone or b in gone or (not target and r >= 1):
            continue
        gone.add(b if not target or power.get(a, 0) >= power.get(b, 0) else a)
    return [c for c in columns if c not in gone]


def prune_constant(df: DataFrame, columns: list[str], least: float = 1e-10) -> list[str]:
    row = df.agg(*[F.var_samp(c).alias(c) for c in columns]).first()
    return [c for c in columns if row[c] is not None and row[c] >= least]


def autocorrelation(df: DataFrame, column: str, lags: int = 10) -> DataFrame:
    """(symbol, interval, lag, corr) of the column with itself k rows before."""
    shifted = df.withColumns({f"__{k}": lag(column, k) for k in range(1, lags + 1)})
    wide = shifted.groupBy(*KEYS).agg(*[_corr(column, f"__{k}").alias(f"{k}") for k in range(1, lags + 1)])
    return wide.unpivot(list(KEYS), [f"{k}" for k in range(1, lags + 1)], "lag", "corr").withColumn("lag", F.col("lag").cast("int"))


def variation(df: DataFrame, columns: list[str]) -> DataFrame:
    """(feature, cv): std by mean, for means that are not about 0 and values that are not beyond use."""
    wide = df.agg(*[F.when(F.abs(F.avg(c)) > 1e-6, F.stddev_samp(c) / F.abs(F.avg(c))).alias(c) for c in columns])
    return wide.unpivot([], columns, "feature", "cv").filter(F.col("cv").isNotNull() & (F.col("cv") < 1e6))


def rolling_variation(df: DataFrame, column: str, n: int = 100) -> DataFrame:
    return df.withColumn(f"{column}_cv_{n}", div(roll(F.stddev_samp, column, n), F.abs(roll(F.avg, column, n))))


def top_per_group(scores: DataFrame, group: str, score: str, n: int) -> DataFrame:
    return scores.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), "feature"))).filter(F.col("place") <= n)


GROUPS = (("MACD", "MACD"), ("BB", "Bollinger"), ("RSI", "RSI"), ("MARKET", "Market"), ("HORIZON", "Horizon"), ("volume", "Volume"))


def feature_group(x: str = "feature") -> Column:
    out = F.when(F.lit(False), "")
    for start, name in GROUPS:
        out = out.when(F.col(x).startswith(start), name)
    return out.otherwise("Price")


def mutual_information(df: DataFrame, columns: list[str], label: str, bins: int = 10) -> DataFrame:
    """(feature, mi): between equal-frequency bins of each column and the label, in nats. A histogram estimate; it
    is not the nearest-neighbour one. Bin edges are exact quantiles, so no window over all rows is needed."""
    found = column_quantiles(df, [], columns, [i / bins for i in range(1, bins)]).first()
    edges = {c: found[f"__q_{c}"] if found else None for c in columns}
    long = df.select(F.col(label).alias("y"), *[F.when(F.col(c).isNotNull(), sum(((F.col(c) > e).cast("int") for e in edges[c] or []), F.lit(0))).alias(c) for c in columns]).unpivot(["y"], columns, "feature", "b").filter("b is not null and y is not null")
    joint = long.groupBy("feature", "b", "y").agg(F.count("*").alias("n"))
    by = lambda *k: F.sum("n").over(Window.partitionBy("feature", *k))
    term = F.col("n") / by() * F.log(F.col("n") * by() / (by("b") * by("y")))
    return joint.select("feature", term.alias("t")).groupBy("feature").agg(F.greatest(F.sum("t"), F.lit(0.0)).alias("mi"))


def composite_scores(parts: DataFrame, core: list[str]) -> DataFrame:
    """(feature, score) from (feature, corr, pca, cv, mi): 10 or 1, and up to 5 points for each measure."""
    top = lambda c: F.max(c).over(Window.partitionBy())  # noqa: E731  a row for each feature
    cv = F.when(F.col("cv") <= 1, 1 - F.col("cv")).otherwise(0.0)
    points = [F.abs("corr"), div("pca", top("pca")), cv, div("mi", top("mi"))]
    return parts.select("feature", (F.when(F.col("feature").isin(core), 10.0).otherwise(1.0) + sum(5 * F.coalesce(p, F.lit(0.0)) for p in points)).alias("score"))


def select_best(scores: DataFrame, core: list[str], total: int, per_group: int = 2) -> DataFrame:
    """(place, feature, score) of the selected: core features, then the best of each group but prices, then the best of
    the rest up to total; core and groups stay whole where they are more. Scores have one row for each feature."""
    ranked = scores.withColumn("group", feature_group()).withColumn("rank", F.row_number().over(Window.partitionBy("group").orderBy(F.desc("score"), "feature")))
    kind = F.when(F.col("feature").isin(core), 0).when((F.col("rank") <= per_group) & (F.col("group") != "Price"), 1).otherwise(2)
    ordered = ranked.withColumn("kind", kind).withColumn("place", F.row_number().over(Window.orderBy("kind", F.desc("score"), "feature")))
    return ordered.filter((F.col("kind") < 2) | (F.col("place") <= total)).select("place", "feature", "score")


def fit_pca(train: DataFrame, columns: list[str], k: int, robust: bool = False) -> PipelineModel:
    """Standardised (or robustly scaled) columns to k components, fitted on train; rows with nulls are left out."""
    scaler = RobustScaler(inputCol="__v", outputCol="__z", withCentering=True, relativeError=1e-4) if robust else StandardScaler(inputCol="__v", outputCol="__z", withMean=True, withStd=True)
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="__v", handleInvalid="skip"), scaler, PCA(k=k, inputCol="__z", outputCol="pc")]).fit(train.select(*columns))


def apply_pca(df: DataFrame, model: PipelineModel, k: int | None = None) -> DataFrame:
    """df with PC1..PCk beside its columns (a vector is sliced; nothing is fitted again)."""
    from pyspark.ml.functions import vector_to_array

    out = model.transform(df).withColumn("__a", vector_to_array("pc"))
    n = k or model.stages[-1].getK()
    return out.select(*df.columns, *[F.col("__a")[i].alias(f"PC{i + 1}") for i in range(n)])


def variance_table(model: PipelineModel) -> list[dict]:
    """For each component its share, the sum so far and the eigenvalue of standardised features."""
    share = list(model.stages[-1].explainedVariance)
    features = len(model.stages[0].getInputCols())
    return [{"component": i + 1, "share": float(x), "cumulative": float(sum(share[: i + 1])), "eigenvalue": float(x * features)} for i, x in enumerate(share)]


def component_counts(table: list[dict]) -> dict[str, int]:
    """How many components the usual rules keep: eigenvalue over 1, shares reached, over 5 % of the largest."""
    first = lambda s: next((r["component"] for r in table if r["cumulative"] >= s - 1e-12), len(table))
    largest = max(r["share"] for r in table)
    mean = sum(r["share"] for r in table) / len(table)
    return {"kaiser": sum(r["eigenvalue"] > 1 for r in table), **{f"var_{int(s * 100)}": first(s) for s in (0.7, 0.8, 0.9, 0.95, 0.98)}, "elbow": sum(r["share"] > 0.05 * largest for r in table), "above_mean": sum(r["share"] > mean for r in table)}


def pca_importance(model: PipelineModel, columns: list[str], components: int = 10) -> dict[str, float]:
    loadings, share = model.stages[-1].pc.toArray(), model.stages[-1].explainedVariance
    n = min(components, loadings.shape[1])
    return {c: float(sum(abs(loadings[i, j]) * share[j] for j in range(n))) for i, c in enumerate(columns)}
