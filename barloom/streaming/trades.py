"""Streams of trades, and candles of them with a watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.folders import shared_folder
from barloom.operators.bars import bars

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read_trades(spark: SparkSession, folder: str, pattern: str = "events*.parquet") -> DataFrame:
    """A stream of trades (symbol, ts, event_id, price) of the files that come to a folder."""
    raw = spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).parquet(folder)
    return raw.select(F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("value").alias("price"))


def stream_bars(trades: DataFrame, hours: int, late: str = "1 hour") -> DataFrame:
    """Candles of a stream, each once its time and `late` have passed: the batch candles but the open ones."""
    return bars(trades.withWatermark("ts", late), hours)


def run_once(df: DataFrame, name: str) -> DataFrame:
    """Runs a stream over what is there, to files in the session's shared folder, and reads them."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    query = df.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/log").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/out")
