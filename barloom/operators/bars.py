"""Bars: ticks to candles, direction, returns of the next bars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.functions.frames import lag, lead


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, ts, event_id, price): the trades of the event table."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("symbol"), "ts", "event_id", F.col("value").alias("price"))


def bars(trades: DataFrame, hours: int) -> DataFrame:
    """Candles of `hours` hours: (symbol, interval, timestamp, open, high, low, close, volume, trades).

    Aggregates are partial before the only shuffle; ties of ts go by event_id; a bar without trades has no row."""
    at = F.struct("ts", "event_id")
    grouped = trades.groupBy("symbol", F.window("ts", f"{hours} hours").alias("w")).agg(
        F.min_by("price", at).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", at).alias("close"), F.sum("price").alias("volume"), F.count("*").alias("trades")
    )
    return grouped.select("symbol", F.lit(f"{hours}h").alias("interval"), F.col("w.start").alias("timestamp"), "open", "high", "low", "close", "volume", "trades")


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One long series: the days of lineitem by ship date, volume the sum of quantities."""
    at = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    grouped = items.groupBy(F.date_trunc("day", "l_shipdate").alias("timestamp")).agg(
        F.min_by("l_extendedprice", at).alias("open"), F.max("l_extendedprice").alias("high"), F.min("l_extendedprice").alias("low"), F.max_by("l_extendedprice", at).alias("close"), F.sum("l_quantity").alias("volume"), F.count("*").alias("trades")
    )
    return grouped.select(F.lit("lineitem").alias("symbol"), F.lit("1d").alias("interval"), "timestamp", "open", "high", "low", "close", "volume", "trades")


def direction() -> Column:
    """1 where the close rose, else 0; 0 for the first bar."""
    return F.coalesce((F.col("close") > lag("close")).cast("int"), F.lit(0))


def forward_return(horizon: int) -> Column:
    """How far the close moves in the next bars; null at the end. A target, not a feature: it looks ahead."""
    return lead("close", horizon) / F.col("close") - 1


def forward_label(horizon: int, threshold: float) -> Column:
    return F.coalesce((forward_return(horizon) > threshold).cast("int"), F.lit(0))
