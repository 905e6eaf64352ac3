"""Periodic runs of words: stretches that repeat themselves several times in a row.

Every lag is compared: with words as ids, the array is set against itself shifted by q for each q up to n / REPEATS,
and stretches where both agree are runs of period q. The texts of a slice lie in one array, longest first, so that one
comparison serves all texts that are long enough for the lag. A text with more lags than LAGS is dealt out in ranges of
lags, each a row of its own, so that machines share its quadratic work.

If a stretch has more than one period, then by Fine and Wilf, as it is four times as long as each, the smallest divides
the others and has the same ends: of equal stretches the one with the smallest period is the run.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import partitions, slices, stored, table, words
from barloom.llm.crc import CRC_TABLES, crc_of

#: A run has so many words at least, and so many times its period. Lags of a row.
LEAST, REPEATS, LAGS = 6, 4, 4096


def stretches(ids: np.ndarray, start: np.ndarray, first: int, last: np.ndarray | int, least: int = LEAST, repeats: int = REPEATS) -> np.ndarray:
    """Rows (text, start, end, period), sorted: the runs of texts ids[start[i]:start[i+1]] whose periods are in
    [first, last], starts and ends counted in each text. Texts without words have none."""
    size = np.diff(start)
    order = np.argsort(-size, kind="stable")
    size, last = size[order], np.broadcast_to(last, len(size))[order]
    top = np.minimum(size // repeats, last)
    falling = np.maximum.accumulate(top[::-1])[::-1]  # the texts up to the last one that has a lag are compared
    at = np.zeros(len(size) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    joined = ids[np.repeat(start[:-1][order] - at[:-1], size) + np.arange(at[-1])].astype(np.int32)
    found = []
    for q in range(first, int(top.max(initial=0)) + 1):
        texts = np.searchsorted(-falling, -q, side="right")
        end = at[texts]
        same = np.flatnonzero(joined[: end - q] == joined[q:end])
        need = max(least - q, (repeats - 1) * q)
        if len(same) < need:
            continue
        full = same[need - 1 :] - same[: len(same) - need + 1] == need - 1
        if not full.any():
            continue
        # stretches of agreement: from each position without its neighbour to the left to the one without that to the right
        a = same[np.append(True, np.diff(same) > 1)]
        b = same[np.append(np.diff(same) > 1, True)] + 1
        long = b - a >= need
        a, b = a[long], b[long] + q
        # the end of one text may agree with the next one's beginning
        for x, y in zip(a.tolist(), b.tolist()):
            t = int(np.searchsorted(at, x, side="right")) - 1
            while x < y:
                stop = min(y, int(at[t + 1]))
                if stop - x >= max(least, repeats * q) and q <= top[t]:
                    found.append((order[t], x - at[t], stop - at[t], q))
                x, t = int(at[t + 1]), t + 1
    if not found:
        return np.empty((0, 4), np.int64)
    rows = np.array(sorted(found), np.int64)
    return rows[np.append(True, (np.diff(rows[:, :3], axis=0) != 0).any(axis=1))]  # of equal stretches the least period


def collapsed(names: list[str], ids: np.ndarray, runs: np.ndarray) -> str:
    """The words joined by one space, without those that repeat a run's first period."""
    if len(runs):
        edge = np.zeros(len(ids) + 1, np.int64)
        np.add.at(edge, runs[:, 1] + runs[:, 3], 1)
        np.add.at(edge, runs[:, 2], -1)
        ids = ids[np.cumsum(edge)[:-1] == 0]
    return " ".join([names[i] for i in ids.tolist()])


RUNS = "runs array<struct<start:long,length:long,period:long>>, collapsed string"
_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _columns(out: list[list[dict]], texts: list[str]) -> list[pa.Array]:
    return [pa.array(out, pa.list_(_RUN)), pa.array(texts, pa.string())]


def _structs(rows: np.ndarray) -> list[dict]:
    return [{"start": a, "length": b - a, "period": q} for _, a, b, q in rows.tolist()]


def _short(docs: DataFrame, text: str, least: int, repeats: int) -> DataFrame:
    """docs with runs and collapsed, each text in one piece."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            ids, names, start = words(part[text], lower=False)
            rows = stretches(ids, start, 1, len(ids), least, repeats)
            cut = np.searchsorted(rows[:, 0], np.arange(len(part) + 1))
            of = [rows[cut[i] : cut[i + 1]] for i in range(len(part))]
            texts = [collapsed(names, ids[start[i] : start[i + 1]], of[i]) for i in range(len(part))]
            yield pa.RecordBatch.from_arrays([*part.columns, *_columns([_structs(x) for x in of], texts)], names=[*part.schema.names, "runs", "collapsed"])

    return docs.mapInArrow(run, f"{_ddl(docs)}, {RUNS}")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in df.schema)


def most_words(text: Column) -> Column:
    """At least the number of words: white space and one more."""
    return F.octet_length(text) - F.octet_length(F.translate(text, " \t\n\x0b\x0c\r", "")) + 1


def _long(docs: DataFrame, text: str, lags: int, least: int, repeats: int) -> DataFrame:
    """docs with runs and collapsed: each different text is dealt out in ranges of lags, their runs meet by its digest."""
    spark = docs.sparkSession
    keyed = docs.select(F.sha2(F.col(text).cast("binary"), 256).alias("key"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    texts = keyed.groupBy("key").agg(F.first(F.col("row")[text]).alias("text"))
    ranges = F.ceil(most_words(F.col("text")) / repeats / lags)
    dealt = texts.withColumn("range", F.explode(F.sequence(F.lit(0), F.greatest(ranges, F.lit(1)).cast("int") - 1)))
    dealt = dealt.withColumn("first", F.col("range") * lags + 1).repartition(4 * partitions(spark), "key", "range")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part = batch.slice(i, 1)
                ids, _, start = words(part["text"], lower=False)
                first = part["first"][0].as_py()
                rows = stretches(ids, start, first, first + lags - 1, least, repeats)
                key = pa.array([part["key"][0].as_py()] * len(rows), pa.string())
                yield pa.RecordBatch.from_arrays([key, *(pa.array(rows[:, k]) for k in (1, 2, 3))], names=["key", "start", "end", "period"])

    found = dealt.mapInArrow(run, "key string, start long, end long, period long").groupBy("key", "start", "end").agg(F.min("period").alias("period"))
    one = F.struct("start", (F.col("end") - F.col("start")).alias("length"), "period")
    runs = stored(found.groupBy("key").agg(F.sort_array(F.collect_list(one)).alias("runs")), "runs")  # no more than the text has words
    none = F.array().cast("array<struct<start:long,length:long,period:long>>")
    with_runs = keyed.join(runs, "key", "left").select("row.*", F.coalesce("runs", none).alias("runs"))

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text):
            ids, names, start = words(part[text], lower=False)
            texts = []
            for i, runs in enumerate(part["runs"].to_pylist()):
                rows = np.array([(i, r["start"], r["start"] + r["length"], r["period"]) for r in runs], np.int64).reshape(-1, 4)
                texts.append(collapsed(names, ids[start[i] : start[i + 1]], rows))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*part.schema.names, "collapsed"])

    return with_runs.mapInArrow(collapse, f"{_ddl(with_runs)}, collapsed string")


def periodic_runs(docs: DataFrame, text_col: str = "text", lags: int = LAGS, least: int = LEAST, repeats: int = REPEATS) -> DataFrame:
    """docs with runs, an array of (start, length, period) in words by start and period, and collapsed, the text's words
    joined by one space without those that any run has after its first period.

    Words are runs of anything but blanks, case kept. A run is as long as it can be; of its periods the smallest counts;
    it has `least` words and `repeats` (2 or more) periods at least. Null and empty texts have no runs and collapse to
    "". Rows are kept as they are, repeated ones too; columns named runs or collapsed are replaced; other columns are
    carried along. An empty table has no rows. A text with more than `lags` lags is dealt out in ranges of lags.
    """
    if least < 2 or repeats < 2:
        raise ValueError("a run has two words and two periods at least")
    docs = docs.drop(*({"runs", "collapsed"} - {text_col}))
    text = F.col(text_col)
    long = F.coalesce((F.octet_length(text) > 2 * lags * repeats) & (most_words(text) > lags * repeats), F.lit(False))  # most are told by size alone
    return _short(docs.filter(~long), text_col, least, repeats).unionByName(_long(docs.filter(long), text_col, lags, least, repeats))


_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def loop(doc_id: int, text: str | None) -> str | None:
    """The text, or its words with those of a short stretch coming again and again: word i >= a is word a + (i - a) % p,
    with a and p from crc32 of the id."""
    h = zlib.crc32(str(doc_id).encode())
    ws = _WORD.findall(text or "") if h % 10 == 0 else []
    if not ws:
        return text
    n, g = len(ws), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return " ".join(ws[:a] + (ws[a : a + p] * (1 + (n - a) // p))[: n - a])


def looped(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with a loop in every tenth document, by crc32 of its id. A null id has no loop, a null text stays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            texts = [t if i is None else loop(i, t) for i, t in zip(part["doc_id"].to_pylist(), part["text"].to_pylist())]
            yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array(texts, pa.string())], names=["doc_id", "text"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, text string")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs of every document, loops put into every tenth: how many, the longest one (ties: least start, then
    period), digests of all and of the collapsed text. Nulls, empty texts and repeated rows as in periodic_runs()."""
    found = periodic_runs(looped(table(spark, sf_dir, "documents")))
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.withColumn("best", best)
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.concat_ws("", lines).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


#: Pairs of equal words by lag, then islands of neighbours; of equal stretches the least period.
OP12_SQL = f"""
WITH RECURSIVE {CRC_TABLES},
crc AS ({crc_of("SELECT DISTINCT doc_id::VARCHAR AS x FROM documents WHERE doc_id IS NOT NULL")}),
raw AS (
    SELECT doc_id, row_number() OVER () AS r, h, h // 10 AS g,
        regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws
    FROM documents LEFT JOIN crc ON x = doc_id::VARCHAR),
cut AS (SELECT *, len(ws) AS n, CASE WHEN h % 10 = 0 AND len(ws) > 0 THEN g % len(ws) END AS a FROM raw),
period AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM cut),
texts AS (
    SELECT doc_id, r, n, CASE WHEN a IS NULL THEN ws ELSE list_transform(range(n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) END AS ws
    FROM period),
word AS (SELECT r, n, unnest(ws) AS w, unnest(range(n)) AS i FROM texts),
pair AS (SELECT x.r, x.i, y.i - x.i AS q FROM word x JOIN word y ON x.r = y.r AND x.w = y.w AND y.i > x.i AND {REPEATS} * (y.i - x.i) <= x.n),
island AS (SELECT r, q, i, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS part FROM pair),
stretch AS (SELECT r, q, min(i) AS s, max(i) + 1 + q AS e FROM island GROUP BY r, q, part HAVING count(*) + q >= greatest({LEAST}, {REPEATS} * q)),
run AS (SELECT r, s, e - s AS len, min(q) AS q FROM stretch GROUP BY r, s, e),
gone AS (SELECT DISTINCT r, unnest(range(s + q, s + len)) AS i FROM run),
kept AS (SELECT r, string_agg(w, ' ' ORDER BY i) AS t FROM word LEFT JOIN (SELECT *, 1 AS dropped FROM gone) g USING (r, i) WHERE dropped IS NULL GROUP BY r),
best AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY len DESC, s, q) AS place FROM run),
lines AS (SELECT r, count(*) AS n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q) AS t FROM run GROUP BY r)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, len AS length, q AS period, 1000 * len // q AS exponent_milli,
    sha256(coalesce(lines.t, '')) AS runs_sha256, sha256(coalesce(kept.t, '')) AS collapsed_sha256
FROM texts LEFT JOIN lines USING (r) LEFT JOIN kept USING (r) LEFT JOIN (SELECT * FROM best WHERE place = 1) b USING (r)
"""
