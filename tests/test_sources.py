"""Paged candles backwards, forwards and as a stream across restarts; parameter stores and split JSON files."""

import json

import pytest
from pyspark.sql import functions as F

from barloom.operators.splits import apply_zscore, fit_zscore, undo_zscore
from barloom.sources import candles

HOUR = 3_600_000


def candle(i):
    return [i * HOUR, "1", "2", "0.5", str(i), "9", i * HOUR + HOUR - 1, "1", 3, "0", "0", "0"]


def put(folder, hours, limit=4):
    """Adds candles to the page files of a folder."""
    for i in hours:
        f = folder / f"s-1h-{i // limit * limit * HOUR}.json"
        rows = json.loads(f.read_text()) if f.exists() else []
        f.write_text(json.dumps([*rows, candle(i)]))


def read(spark, folder, **options):
    spark.dataSource.register(candles.KlinePages)
    df = spark.read.format("klines").options(path=str(folder), symbol="s", interval="1h", limit=4, now=1000 * HOUR, **options).load()
    return sorted(int(r.close) for r in df.collect())


def test_backwards_until_three_empty_pages(spark, tmp_path):
    put(tmp_path, [*range(40, 51), *range(60, 70), 5])  # gaps of two pages and, before 40, of many
    assert read(spark, tmp_path, end=72 * HOUR) == [*range(40, 51), *range(60, 70)]
    assert read(spark, tmp_path, end=72 * HOUR, patience=9) == [5, *range(40, 51), *range(60, 70)]
    assert read(spark, tmp_path, end=65 * HOUR, patience=1) == list(range(60, 65))
    assert read(spark, tmp_path, end=200 * HOUR) == []


def test_probes_end_after_the_third_empty_page():
    asked = []
    spans = candles.pages_backwards(20 * HOUR, "1h", 2, lambda a, b: asked.append(a // HOUR) or a // HOUR in (16, 10))
    assert spans == [(10 * HOUR, 12 * HOUR), (16 * HOUR, 18 * HOUR)] and asked == [18, 16, 14, 12, 10, 8, 6, 4]
    assert candles.pages_backwards(3 * HOUR, "1h", 2, lambda a, b: True) == [(0, HOUR), (HOUR, 3 * HOUR)]


def test_forwards_and_no_future(spark, tmp_path):
    put(tmp_path, range(10, 31))
    assert read(spark, tmp_path, start=11 * HOUR, end=30 * HOUR) == list(range(11, 30))
    assert read(spark, tmp_path, start=25 * HOUR) == list(range(25, 31))
    for options in ({"start": 1001 * HOUR}, {"end": 1001 * HOUR}):
        with pytest.raises(Exception, match="in the future"):
            read(spark, tmp_path, **options)
    with pytest.raises(Exception, match="no interval"):
        spark.read.format("klines").options(path=str(tmp_path), symbol="s", interval="7h").load().collect()


def test_stream_goes_on_after_a_restart(spark, tmp_path):
    """Each closed candle comes once, whether it was there at the first start, came between starts, or was still open."""
    spark.dataSource.register(candles.KlinePages)
    (tmp_path / "pages").mkdir()

    def run(now):
        df = spark.readStream.format("klines").options(path=f"{tmp_path}/pages", symbol="s", interval="1h", limit=4, start=8 * HOUR, now=now).load()
        query = df.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(int(r.close) for r in spark.read.schema("close double").parquet(f"{tmp_path}/out").collect())

    put(tmp_path / "pages", range(5, 14))
    assert run(13 * HOUR + 5) == list(range(8, 13))  # the candle of hour 13 is open
    assert run(13 * HOUR + 5) == list(range(8, 13))
    put(tmp_path / "pages", range(14, 23))
    assert run(20 * HOUR) == list(range(8, 20))
    assert run(40 * HOUR) == list(range(8, 23))  # no further than what is there
    put(tmp_path / "pages", [23, 30])
    assert run(40 * HOUR) == [*range(8, 24), 30]


def test_parameters_by_series(spark, tmp_path):
    df = spark.createDataFrame([(s, "1h", i, float(i * k)) for k, s in enumerate("abc", 1) for i in range(5)], "symbol string, interval string, timestamp int, close double").withColumn("split", F.lit("train"))
    path = f"{tmp_path}/params"
    candles.save_params(fit_zscore(df, ["close"]), path)
    candles.save_params(fit_zscore(df.filter("symbol = 'b'").withColumn("close", F.col("close") + 100), ["close"]), path)
    back = candles.read_params(spark, path)
    assert {(r.symbol, round(r["mean"], 6)) for r in back.collect()} == {("a", 2.0), ("b", 104.0), ("c", 6.0)}
    only = df.filter("symbol <> 'b'")
    there = undo_zscore(apply_zscore(only, back, ["close"]).drop("close"), back, ["close"])
    assert {(r.symbol, r.timestamp, round(r.close, 9)) for r in there.collect()} == {(r.symbol, r.timestamp, r.close) for r in only.collect()}


def test_split_json_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i, None if i == 3 else f"é{i}") for i in range(9)], "n int, x string").repartition(3)
    candles.write_split_json(df, f"{tmp_path}/out")
    back = candles.read_split_json(spark, f"{tmp_path}/out/part*")
    assert sorted((r.n, r.x) for r in back.collect()) == sorted((str(r.n), r.x) for r in df.collect())


def test_ticks_of_overlapping_pages_come_once(spark):
    rows = [("a", 1, 1, 5.0), ("a", 1, 1, 5.0), ("a", 1, 2, 5.0)]
    assert candles.distinct_ticks(spark.createDataFrame(rows, "symbol string, ts long, event_id long, price double")).count() == 2
