"""Importance resampling of documents towards the n-gram distribution of target texts.

Each block of texts has an integer word dictionary: its distinct words get ids, an n-gram is a tuple of ids, and only
the distinct tuples are written out as bytes and hashed, once in a block; their buckets are joined back to the places
where they stand. Blocks keep a document's buckets as sorted differences in a stored table, so that texts are read and
hashed once: the first pass over it adds up counts of buckets, the second one weighs documents. The largest of weight
plus Gumbel noise are drawn without replacement.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import in_blocks, pack, partitions, stored, table, unpack, words
from barloom.llm.crc import CRC_TABLES, crc_of

#: Words of an n-gram at most, hash buckets, words of a document that can be drawn, percent drawn, seed of the noise.
LONGEST, BUCKETS, LEAST_WORDS, PERCENT, SEED = 2, 10_000, 20, 25, 7
#: Bytes that part words: all ASCII but digits and letters.
_PARTS = np.ones(256, bool)
_PARTS[48:58] = _PARTS[65:91] = _PARTS[97:123] = _PARTS[128:] = False


def buckets_of(texts: pa.Array, longest: int = LONGEST, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bucket of each n-gram of the texts, with its text's number, and how many words each text has.

    Tuples of k words are numbered from those of k-1: (number of the first k-1, id of the last) is one integer. The
    bytes of a distinct tuple are those of its shorter one, a space and a word."""
    ids, names, start = words(texts, _PARTS)
    doc = np.repeat(np.arange(len(texts)), np.diff(start))
    names = [x.encode() for x in names]
    at, tuples, written = np.arange(len(ids)), ids, names
    found, owner = [], []
    for k in range(1, longest + 1):
        if k > 1:
            fits = at + k - 1 < start[doc[at] + 1] if len(at) else np.zeros(0, bool)
            at, tuples = at[fits], tuples[fits]
            distinct, tuples = np.unique(tuples * len(names) + ids[at + k - 1], return_inverse=True)
            written = [b"%b %b" % (written[a], names[b]) for a, b in zip(*(x.tolist() for x in np.divmod(distinct, max(1, len(names)))))]
        bucket = np.fromiter((zlib.crc32(x) % buckets for x in written), np.int64, len(written))
        found.append(bucket[tuples])
        owner.append(doc[at])
    return np.concatenate(found), np.concatenate(owner), np.diff(start)


_BLOCK = "block long, ids binary, features binary"


def features(docs: DataFrame, longest: int = LONGEST, buckets: int = BUCKETS) -> DataFrame:
    """A row for each block of docs (doc_id, text): its ids, and for each document its words and its buckets."""
    schema = pa.schema([("block", pa.int64()), ("ids", pa.binary()), ("features", pa.binary())])

    def build(number: int, part: pa.Table) -> tuple:
        bucket, owner, n_words = buckets_of(part["text"].combine_chunks(), longest, buckets)
        step = np.diff(np.sort(owner * buckets + bucket) % buckets, prepend=0)
        size = np.bincount(owner, minlength=len(part))
        ids = part["doc_id"].combine_chunks()
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        head = pack(ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), known, n_words.astype(np.int64), size.astype(np.int64))
        return number, head, pack(step.astype(np.int32))

    return in_blocks(docs, build, schema, _BLOCK)


def _read(row: dict) -> tuple[np.ndarray, ...]:
    """ids, whether they are known, words and features of each document of a block, and the features' buckets in order
    of documents."""
    ids, known, n_words, size = unpack(row["ids"], np.int64, bool, np.int64, np.int64)
    return ids, known, n_words, size, np.cumsum(unpack(row["features"], np.int32)[0].astype(np.int64))


def bucket_counts(blocks: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features all documents have in each bucket; a task sends one row a bucket, the driver gets as many."""
    schema = pa.schema([("bucket", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                total += np.bincount(_read(row)[4], minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], schema=schema)

    sums = blocks.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for bucket, n in sums:
        out[bucket] = n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of how much likelier each bucket is in the target), both counts smoothed by one a bucket."""
    buckets, s, t = float(len(source)), float(source.sum()), float(target.sum())
    ratio = ((target + 1.0) * (s + buckets)) / ((source + 1.0) * (t + buckets))
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], np.int64)


def weights(blocks: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of each document: weight is the floored mean of its features' gains."""
    schema = pa.schema([(x, pa.int64()) for x in ("doc_id", "n_words", "n_features", "weight")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, known, n_words, size, bucket = _read(row)
                ends = np.append(0, np.cumsum(gain[bucket]))
                last = np.cumsum(size)
                weight = np.where(size > 0, (ends[last] - ends[last - size]) // np.maximum(size, 1), 0)
                yield pa.RecordBatch.from_arrays([pa.array(ids, mask=~known), pa.array(n_words), pa.array(size), pa.array(weight)], schema=schema)

    return blocks.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def ranked(scored: DataFrame) -> DataFrame:
    """scored with rank: 1, 2, 3, ... by falling score, then rising doc_id (null last).

    Rows are sorted in ranges and numbered in each; a range's first rank is the number of rows in the ranges before it.
    Rows alike in score and id are dealt by a salt, so that no key fills a range."""
    spark = scored.sparkSession
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("salt")]
    salted = scored.withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20)))
    sorted_ = salted.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).drop("salt")
    placed = stored(sorted_.withColumn("at", F.monotonically_increasing_id()), "ranked")
    part = F.shiftright("at", 33)
    before, total = [], 0
    for p, n in sorted((r.p, r.n) for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()):
        before.append((p, total))
        total += n
    offsets = F.broadcast(spark.createDataFrame(before, "p int, before long"))  # a row for each range
    return placed.join(offsets, part.cast("int") == F.col("p")).withColumn("rank", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1) + 1).drop("at", "p", "before")


def noise(seed: int) -> F.Column:
    """floor(1000 * standard Gumbel noise) of each doc_id, from the first 32 bits of the digest of "seed:doc_id"."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", percent: int = PERCENT, least_words: int = LEAST_WORDS, longest: int = LONGEST, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank) of each row of docs: rank is 1, 2, ... for the percent of the
    documents with least_words words or more that are drawn, by falling score, ties to the smaller id; else null.

    A null text counts as empty. Documents without features weigh 0. Equal rows are drawn one by one, with ranks of
    their own; a null id has the noise of "null" and comes last among ties. An empty table has no rows; an empty target
    is even over the buckets. Other columns are not read.
    """
    source = stored(features(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), longest, buckets), "features")
    wanted = features(target.select(F.lit(0).cast("long").alias("doc_id"), F.col(target_col).alias("text")), longest, buckets)
    gain = gains(bucket_counts(source, buckets), bucket_counts(wanted, buckets))
    scored = weights(source, gain).withColumn("score", F.col("weight") + noise(seed))
    able = ranked(scored.filter(F.col("n_words") >= least_words))
    drawn = F.col("rank") <= able.count() * percent // 100
    rest = scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return able.withColumn("rank", F.when(drawn, F.col("rank"))).unionByName(rest)


_SQL_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
OP11_SQL = f"""
WITH RECURSIVE {CRC_TABLES},
texts AS (
    SELECT 'd' AS kind, doc_id, row_number() OVER () AS r, {_SQL_WORDS} AS ws FROM documents
    UNION ALL SELECT 'b', NULL, row_number() OVER (), {_SQL_WORDS} FROM benchmark),
runs AS (SELECT kind, r, unnest(ws || list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS x FROM texts),
crc AS ({crc_of("SELECT DISTINCT x FROM runs")}),
features AS (SELECT kind, r, h % {BUCKETS} AS bucket FROM runs JOIN crc USING (x)),
counts AS (SELECT bucket, count(*) FILTER (kind = 'd') AS s, count(*) FILTER (kind = 'b') AS t FROM features GROUP BY bucket),
sums AS (SELECT coalesce(sum(s), 0)::DOUBLE AS s, coalesce(sum(t), 0)::DOUBLE AS t FROM counts),
gain AS (
    SELECT bucket, floor(1000 * ln(((c.t + 1)::DOUBLE * (sums.s + {BUCKETS})) / ((c.s + 1)::DOUBLE * (sums.t + {BUCKETS}))))::BIGINT AS gain
    FROM counts c, sums),
weight AS (SELECT r, count(*) AS n, floor(sum(gain) / count(*))::BIGINT AS weight FROM features JOIN gain USING (bucket) WHERE kind = 'd' GROUP BY r),
scored AS (
    SELECT doc_id, len(ws) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
    FROM texts LEFT JOIN weight USING (r) WHERE kind = 'd'),
able AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_words >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN place <= {PERCENT} * n // 100 THEN place END AS rank FROM able
UNION ALL SELECT doc_id, n_features, weight, score, NULL FROM scored WHERE n_words < {LEAST_WORDS}
"""


def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of documents drawn towards benchmark, one row a document. Nulls, empty texts, ties, repeated rows and
    empty tables as in resample()."""
    drawn = resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
