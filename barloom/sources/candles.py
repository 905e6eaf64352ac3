"""Candle sources and sinks: CSV and JSON files, exchange pages, parameter tables, exports."""

from __future__ import annotations

import json
import os
import time
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from barloom.operators.splits import parse_time

REQUIRED = ("timestamp", "open", "high", "low", "close", "volume")
#: Fields of an exchange candle, in the order of its pages, and milliseconds of its intervals. Fixed values.
KLINE = ("timestamp", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "trades", "taker_buy_base", "taker_buy_quote", "ignore")
INTERVAL_MS = {"1m": 60_000, "3m": 180_000, "5m": 300_000, "15m": 900_000, "30m": 1_800_000, "1h": 3_600_000, "2h": 7_200_000, "4h": 14_400_000, "6h": 21_600_000, "8h": 28_800_000, "12h": 43_200_000, "1d": 86_400_000}


def read_csv(spark: SparkSession, path: str, symbol: str, interval: str) -> DataFrame:
    """Bars of a CSV file with a header: "time" counts as timestamp (epoch seconds or text of several formats), the
    other columns as numbers, null where they are none; a required column that is missing raises. No inference scan."""
    raw = spark.read.csv(path, header=True)
    if "time" in raw.columns and "timestamp" not in raw.columns:
        raw = raw.withColumnRenamed("time", "timestamp")
    missing = [c for c in REQUIRED if c not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    rest = [c for c in raw.columns if c not in REQUIRED]
    return raw.select(F.lit(symbol).alias("symbol"), F.lit(interval).alias("interval"), parse_time("timestamp").alias("timestamp"), *[F.col(c).try_cast("double").alias(c) for c in (*REQUIRED[1:], *rest)])


def read_split_json(spark: SparkSession, path: str) -> DataFrame:
    """A table of JSON {"columns": [...], "index": [...], "data": [[...]]} with one object per file, as text columns."""
    one = spark.read.json(path, schema="columns array<string>, data array<array<string>>", multiLine=True)
    names = one.select("columns").first()[0]
    rows = one.select(F.explode("data").alias("r"))
    return rows.select(*[F.col("r")[i].alias(c) for i, c in enumerate(names)])


def pages_between(start_ms: int, end_ms: int, interval: str, limit: int = 1000) -> list[tuple[int, int]]:
    """(start, end) of the pages that cover a span, oldest first; a page has at most limit candles."""
    step = INTERVAL_MS[interval] * limit
    return [(a, min(a + step, end_ms)) for a in range(start_ms, end_ms, step)]


def pages_backwards(end_ms: int, interval: str, limit: int, has_rows: Callable[[int, int], bool], patience: int = 3) -> list[tuple[int, int]]:
    """(start, end) of the pages before end_ms, oldest first, without a known beginning: pages are probed from the last one
    backwards, and after `patience` empty ones in a row there is nothing older. Shorter gaps are crossed."""
    step, found, empty = INTERVAL_MS[interval] * limit, [], 0
    while empty < patience and end_ms > 0:
        start = max(0, end_ms - step)
        if has_rows(start, end_ms):
            found.append((start, end_ms))
            empty = 0
        else:
            empty += 1
        end_ms = start
    return found[::-1]


class _Page(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class PageFiles:
    """The transport of pages: files {path}/{symbol}-{interval}-{start}.json with lists of candles, each file of a span of
    limit candles that begins at a multiple of its length. Another transport has the same three methods."""

    def __init__(self, options: dict[str, str]):
        self.path, self.stem = options["path"], f"{options['symbol']}-{options['interval']}-"
        self.step = INTERVAL_MS[options["interval"]] * int(options.get("limit", 1000))

    def _spans(self, start: int, end: int) -> list[str]:
        names = [f"{self.path}/{self.stem}{a}.json" for a in range(start - start % self.step, end, self.step)]
        return [x for x in names if os.path.exists(x)]

    def has_rows(self, start: int, end: int) -> bool:
        return any(start <= k[0] < end for x in self._spans(start, end) for k in self._read(x))

    def fetch(self, start: int, end: int) -> Iterator[list]:
        """The candles that open in [start, end), oldest first, each once."""
        for x in self._spans(start, end):
            rows = {k[0]: k for k in self._read(x) if start <= k[0] < end}
            yield from (rows[t] for t in sorted(rows))

    def newest(self) -> int | None:
        """When the newest candle that is there opens."""
        starts = sorted((int(x[len(self.stem) : -5]) for x in os.listdir(self.path) if x.startswith(self.stem) and x.endswith(".json")), reverse=True)
        return next((max(k[0] for k in rows) for rows in (self._read(f"{self.path}/{self.stem}{s}.json") for s in starts) if rows), None)

    @staticmethod
    def _read(path: str) -> list[list]:
        with open(path) as f:
            return json.load(f)


class KlinePages(DataSource):
    """Candles by pages: format("klines") with path, symbol, interval and limit (candles of a page, 1000).

    As a table: start and end in ms; without a start the pages before end are sought backwards until three in a row are
    empty (option patience). A start or an end in the future raises; without an end it is now. As a stream: from start on
    (required), each closed candle once, in order, across restarts; the offset is the end of the last closed candle.
    A page is a partition, read by its own task. The option now (ms) stands for the clock. A reader of another transport
    overrides pages()."""

    @classmethod
    def name(cls) -> str:
        return "klines"

    def schema(self) -> str:
        return "symbol string, interval string, timestamp timestamp, " + ", ".join(f"{c} double" for c in KLINE[1:6]) + ", close_time timestamp, quote_volume double, trades long"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return KlineReader(self.options)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return KlineStreamReader(self.options)


class _Klines:
    def __init__(self, options):
        self.o = dict(options)
        self.interval, self.limit = self.o["interval"], int(self.o.get("limit", 1000))
        if self.interval not in INTERVAL_MS:
            raise ValueError(f"no interval {self.interval}")

    def pages(self) -> PageFiles:
        return PageFiles(self.o)

    def now(self) -> int:
        return int(self.o.get("now") or time.time() * 1000)

    def past(self, name: str) -> int:
        ms = int(self.o.get(name) or self.now())
        if ms > self.now():
            raise ValueError(f"{name} is in the future")
        return ms

    def read(self, page: _Page) -> Iterator[tuple]:
        def number(x):
            try:
                return float(x)
            except (TypeError, ValueError):
                return None

        when = lambda ms: datetime.fromtimestamp(ms / 1000, timezone.utc)
        for k in self.pages().fetch(page.start, page.end):
            yield (self.o["symbol"], self.interval, when(k[0]), *map(number, k[1:6]), when(k[6]), number(k[7]), int(k[8]))


class KlineReader(_Klines, DataSourceReader):
    def partitions(self) -> list[InputPartition]:
        end = self.past("end")
        if self.o.get("start") is None:
            spans = pages_backwards(end, self.interval, self.limit, self.pages().has_rows, int(self.o.get("patience", 3)))
        else:
            spans = pages_between(self.past("start"), end, self.interval, self.limit)
        return [_Page(a, b) for a, b in spans] or [_Page(end, end)]


class KlineStreamReader(_Klines, DataSourceStreamReader):
    """The offset {"closed": ms}: all candles that open before it are read. It never passes a candle that is still open,
    nor the newest that is there, so that a candle which comes late is not passed by."""

    def initialOffset(self) -> dict:
        return {"closed": self.past("start")}

    def latestOffset(self) -> dict:
        step, newest, start = INTERVAL_MS[self.interval], self.pages().newest(), self.past("start")
        closed = self.now() // step * step
        return {"closed": max(start, min(closed, start if newest is None else newest + step))}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_Page(a, b) for a, b in pages_between(start["closed"], end["closed"], self.interval, self.limit)]

    def commit(self, end: dict) -> None:
        """Files stay; a transport that keeps a cursor would move it here."""


def distinct_ticks(ticks: DataFrame, keys: tuple[str, ...] = ("symbol", "ts", "event_id")) -> DataFrame:
    """Pages overlap at their edges: each tick once."""
    return ticks.dropDuplicates(list(keys))


def save_params(params: DataFrame, path: str) -> None:
    """Fitted parameters (symbol, interval, feature, mean, std), one row each, so that families do not overwrite each
    other; replaced by series."""
    params.write.mode("overwrite").partitionBy("symbol", "interval").option("partitionOverwriteMode", "dynamic").parquet(path)


def read_params(spark: SparkSession, path: str) -> DataFrame:
    """What save_params stored, all series; a store that is not there raises."""
    return spark.read.schema("feature string, mean double, std double, symbol string, interval string").parquet(path).select("symbol", "interval", "feature", "mean", "std")


def write_split_json(df: DataFrame, path: str) -> None:
    """A table as files of one JSON object {"columns": [...], "index": [...], "data": [[...]]}, one of each partition's rows,
    that read_split_json reads; values as text, null as null. No rows leave no file."""
    names = df.columns

    def run(parts):
        for part in parts:
            if len(part):
                yield pd.DataFrame({"value": [json.dumps({"columns": names, "index": list(range(len(part))), "data": part.astype(object).where(part.notna(), None).values.tolist()})]})

    text = df.select(*[F.col(c).cast("string").alias(c) for c in names])
    text.mapInPandas(run, "value string").write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)
