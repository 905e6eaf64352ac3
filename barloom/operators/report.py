"""What a table holds: kinds and sizes of columns, nulls, decimals, statistics of feature groups; rows that are signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from barloom.operators.stats import feature_group


def _kind(t: T.DataType) -> str:
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, T.StringType):
        return "text"
    return "time" if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "other"


def _bytes(c: str, t: T.DataType) -> Column:
    """Bytes of the values: their width, or the length of text; of nested values that of their JSON."""
    width = {T.ByteType: 1, T.ShortType: 2, T.IntegerType: 4, T.FloatType: 4, T.DateType: 4, T.BooleanType: 1}.get(type(t), 8)
    if isinstance(t, T.StringType):
        return F.coalesce(F.sum(F.octet_length(F.col(c))), F.lit(0))
    if isinstance(t, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(F.sum(F.octet_length(F.to_json(F.col(c)))), F.lit(0))
    return F.count(F.col(c)) * width


def column_report(df: DataFrame) -> DataFrame:
    """(feature, kind, n, nulls, null_pct, bytes) for each column; kind is number, text, time or other. One aggregation;
    an empty table has rows of zeros and no share of nulls."""
    one = df.agg(F.count("*").alias("__n"), *[F.struct((F.count("*") - F.count(F.col(f"`{c}`"))).alias("nulls"), _bytes(f"`{c}`", t.dataType).alias("bytes")).alias(c) for c, t in zip(df.columns, df.schema)])
    each = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(_kind(t.dataType)).alias("kind"), F.col(f"`{c}`")["nulls"].alias("nulls"), F.col(f"`{c}`")["bytes"].alias("bytes")) for c, t in zip(df.columns, df.schema)])
    rows = one.select("__n", F.explode(each).alias("x"))
    return rows.select("x.feature", "x.kind", F.col("__n").alias("n"), "x.nulls", F.try_divide(100 * F.col("x.nulls"), F.col("__n")).alias("null_pct"), "x.bytes")


def kind_report(report: DataFrame) -> DataFrame:
    """(kind, columns, n, bytes) of a column_report."""
    return report.groupBy("kind").agg(F.count("*").alias("columns"), F.max("n").alias("n"), F.sum("bytes").alias("bytes"))


def decimals(x: Column | str) -> Column:
    """How many digits a number has after its point as it is written, one at least: 100.0 has one. Numbers that are
    written with an exponent count as written out."""
    written = F.col(x).cast("string") if isinstance(x, str) else x.cast("string")
    long = F.regexp_replace(written.cast("decimal(38,18)").cast("string"), "0+$", "")
    return F.greatest(F.lit(1), F.length(F.substring_index(F.when(written.contains("E"), long).otherwise(written), ".", -1)))


def keep_signals(df: DataFrame, column: str, nothing: str | int | float = "None") -> DataFrame:
    """The rows whose value is not `nothing`; null is a value of its own and stays."""
    return df.filter(~F.col(column).eqNullSafe(F.lit(nothing)))


def group_statistics(parts: DataFrame, top: int = 3) -> DataFrame:
    """(group, features, corr, pca, mi, top_corr, top_pca) from (feature, corr, pca, mi), a row a feature: for each group of
    features how many, the mean sizes of correlation, component weight and information (nulls left out), and the names
    of the best by correlation and by weight, ties by name."""
    ranked = parts.withColumn("group", feature_group()).withColumn("corr", F.abs("corr"))
    place = lambda c: F.row_number().over(Window.partitionBy("group").orderBy(F.desc_nulls_last(c), "feature"))  # noqa: E731  a row a feature
    ranked = ranked.withColumns({"__corr": place("corr"), "__pca": place("pca")})
    best = lambda c: F.transform(F.sort_array(F.collect_list(F.when((F.col(f"__{c}") <= top) & F.col(c).isNotNull(), F.struct(f"__{c}", "feature")))), lambda s: s["feature"])
    return ranked.groupBy("group").agg(F.count("*").alias("features"), *[F.avg(c).alias(c) for c in ("corr", "pca", "mi")], best("corr").alias("top_corr"), best("pca").alias("top_pca"))
