"""Queries over streams of trades and the SQL they are compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.operators.bars import ticks
from barloom.streaming import trades, trends

#: Trades before are history, from which the states start; trades from here on are streamed. Closes of a state.
START, LENGTH = "2024-01-08 00:00:00", 60


def tick_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trend at each trade of the stream, states starting from the stored minutes before it."""
    stream = trades.read_trades(spark, sf_dir).filter(F.col("ts") >= F.lit(START).cast("timestamp"))
    candles = trends.minute_closes(ticks(spark, sf_dir), START, LENGTH)
    return trades.run_once(trends.tick_trends(stream, candles, length=LENGTH), "trends")


def stream_tick_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tick_trends(spark, sf_dir)
    return out.select("symbol", "event_id", "price", F.round("histogram", 6).alias("histogram"), "trend")


def stream_trends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trades at which the trend changes."""
    return trends.trend_changes(tick_trends(spark, sf_dir)).select("symbol", "event_id", "price", "trend")


def _decay(span: int) -> str:
    return f"{1 - 2 / (span + 1)!r}::DOUBLE"


_F, _S, _G = (_decay(span) for span in (trends.FAST, trends.SLOW, trends.SIGNAL))
_SIGN = "CASE WHEN abs({h}) <= {flat} * price THEN 0 WHEN {h} > 0 THEN 1 ELSE -1 END"
#: The closes of LENGTH minutes before each trade's minute, times the weights that follow from the averages' definition.
TICK_SQL = f"""
WITH trade AS (
    SELECT event_type AS symbol, event_id, time_bucket(INTERVAL 1 millisecond, ts) AS ts, date_trunc('minute', ts) AS m, value AS price
    FROM events WHERE value <> 0),
age AS (SELECT i AS j FROM range({LENGTH}) t(i)),
line AS (
    SELECT a.j, b.j AS i, pow({_F}, a.j - b.j) / ((1 - pow({_F}, a.j + 1)) / (1 - {_F})) - pow({_S}, a.j - b.j) / ((1 - pow({_S}, a.j + 1)) / (1 - {_S})) AS w
    FROM age a JOIN age b ON b.j <= a.j),
weight AS (
    SELECT i, pow({_F}, {LENGTH} - 1 - i) AS wf, pow({_S}, {LENGTH} - 1 - i) AS ws, sum(pow({_G}, {LENGTH} - 1 - j) * w) AS wg
    FROM line GROUP BY i),
minute AS (
    SELECT DISTINCT symbol, m FROM trade WHERE ts >= TIMESTAMP '{START}'
    UNION SELECT DISTINCT symbol, TIMESTAMP '{START}' FROM trade),
edge AS (SELECT symbol, m, i, m - to_minutes({LENGTH} - 1 - i::BIGINT) AS b FROM minute, (SELECT j AS i FROM age)),
held AS (SELECT edge.*, trade.price FROM edge ASOF JOIN (SELECT DISTINCT ON (symbol, ts) symbol, ts, price FROM trade ORDER BY symbol, ts, event_id DESC) trade ON edge.symbol = trade.symbol AND edge.b > trade.ts),
closed AS (
    SELECT symbol, m, sum(wf * price) AS nf, sum(ws * price) AS ns, sum(wg * price) AS ng, max_by(price, i) AS price
    FROM held JOIN weight USING (i) GROUP BY symbol, m HAVING count(*) = {LENGTH}),
df AS (SELECT n, (1 - pow({_F}, n)) / (1 - {_F}) AS f, (1 - pow({_S}, n)) / (1 - {_S}) AS s, (1 - pow({_G}, n)) / (1 - {_G}) AS g FROM range({LENGTH}, {LENGTH + 2}) t(n)),
bar AS (SELECT closed.*, nf / f - ns / s - ng / g AS h FROM closed JOIN df ON n = {LENGTH}),
bars AS (SELECT *, {_SIGN.format(h="h", flat=trends.FLAT)} AS closed_sign FROM bar),
tick AS (
    SELECT t.symbol, t.event_id, t.ts, t.price, b.closed_sign, (b.nf * {_F} + t.price) / f - (b.ns * {_S} + t.price) / s AS line, b.ng, g
    FROM trade t JOIN bars b USING (symbol, m) JOIN df ON n = {LENGTH + 1} WHERE t.ts >= TIMESTAMP '{START}'),
hist AS (SELECT *, line - (ng * {_G} + line) / g AS h FROM tick),
signs AS (SELECT *, {_SIGN.format(h="h", flat=trends.FLAT)} AS now FROM hist),
first AS (SELECT symbol, closed_sign AS start FROM bars WHERE m = TIMESTAMP '{START}'),
steps AS (
    SELECT signs.*, start, lag(now, 1, start) OVER (PARTITION BY symbol ORDER BY ts, event_id) AS before
    FROM signs JOIN first USING (symbol)),
known AS (
    SELECT *, start <> 0 OR coalesce(bool_or(now * closed_sign < 0) OVER (PARTITION BY symbol ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS known
    FROM steps),
turns AS (SELECT *, CASE WHEN now * closed_sign < 0 OR known AND now * before < 0 THEN now END AS turn FROM known),
judged AS (
    SELECT *, coalesce(last_value(turn IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY ts, event_id), start) AS state,
        (SELECT max(ts) FROM events WHERE value IS NOT NULL) - INTERVAL 1 minute AS until
    FROM turns),
told AS (
    SELECT symbol, event_id, ts, price, round(h, 6) AS histogram, CASE WHEN state > 0 THEN 'UP' WHEN state < 0 THEN 'DOWN' END AS trend
    FROM judged WHERE date_trunc('minute', ts) + INTERVAL 1 minute <= until)"""

QUERIES = {"stream_tick_trends": stream_tick_trends, "stream_trends": stream_trends}
ORACLE = {
    "stream_tick_trends": f"{TICK_SQL} SELECT symbol, event_id, price, histogram, trend FROM told",
    "stream_trends": f"""{TICK_SQL}, steps_told AS (SELECT *, lag(trend) OVER (PARTITION BY symbol ORDER BY ts, event_id) AS old FROM told)
    SELECT symbol, event_id, price, trend FROM steps_told WHERE trend IS DISTINCT FROM old""",
}
