"""Reports of columns and groups, decimals, signals and crossing lines on odd values."""

from datetime import datetime

from pyspark.sql import functions as F

from barloom.operators import geometry, report


def test_columns_and_kinds(spark):
    rows = [(1, "é", 1.5, datetime(2024, 1, 1), [1, 2], None), (2, None, None, None, None, None)]
    df = spark.createDataFrame(rows, "`a b` int, t string, x double, at timestamp, l array<int>, void double")
    found = {r.feature: (r.kind, r.n, r.nulls, r.null_pct, r.bytes) for r in report.column_report(df).collect()}
    assert found == {"a b": ("number", 2, 0, 0.0, 8), "t": ("text", 2, 1, 50.0, 2), "x": ("number", 2, 1, 50.0, 8), "at": ("time", 2, 1, 50.0, 8), "l": ("other", 2, 1, 50.0, 5), "void": ("number", 2, 2, 100.0, 0)}
    assert {(r.kind, r.columns, r.n, r.bytes) for r in report.kind_report(report.column_report(df)).collect()} == {("number", 3, 2, 16), ("text", 1, 2, 2), ("time", 1, 2, 8), ("other", 1, 2, 5)}
    assert {(r.n, r.null_pct) for r in report.column_report(df.limit(0)).collect()} == {(0, None)}


def test_decimals(spark):
    xs = {100.0: 1, 0.25: 2, 1e-5: 5, 1.5e10: 1, 123.456: 3, -2.5: 1}
    df = spark.createDataFrame([(x,) for x in xs] + [(None,)], "x double")
    assert {r.x: r.d for r in df.select("x", report.decimals("x").alias("d")).collect() if r.x is not None} == xs


def test_signals(spark):
    df = spark.createDataFrame([("LE",), ("None",), (None,)], "s string")
    assert [r.s for r in report.keep_signals(df, "s").collect()] == ["LE", None]


def test_groups(spark):
    rows = [("RSI_14", -0.5, 0.2, 0.1), ("RSI_7", 0.1, 0.4, None), ("RSI_9", None, 0.4, 0.3), ("close", 0.9, 0.0, 0.0)]
    found = {r.group: r for r in report.group_statistics(spark.createDataFrame(rows, "feature string, corr double, pca double, mi double"), 2).collect()}
    assert set(found) == {"RSI", "Price"} and found["RSI"].features == 3
    assert abs(found["RSI"]["corr"] - 0.3) < 1e-12 and abs(found["RSI"].pca - 1 / 3) < 1e-12 and abs(found["RSI"].mi - 0.2) < 1e-12
    assert found["RSI"].top_corr == ["RSI_14", "RSI_7"] and found["RSI"].top_pca == ["RSI_7", "RSI_9"]


def test_lines_meet_or_are_parallel(spark):
    rows = [(1.0, 0.0, -1.0, 4.0), (1.0, 0.0, 1.0, 4.0)]
    got = spark.createDataFrame(rows, "a double, b double, c double, d double").select(geometry.intersection(*[F.col(x) for x in "abcd"]).alias("p")).collect()
    assert [None if r.p is None else tuple(r.p) for r in got] == [(2.0, 2.0), None]
