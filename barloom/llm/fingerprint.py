"""Document fingerprints by content-defined chunking.

A gear hash over the last 16 bytes sets chunk boundaries; chunking is normalised: a boundary needs seven zero bits
before the normal size and four after it, so that sizes gather around the normal one. A fingerprint is the set of
chunk digests with their lengths; the containment of one set in another, weighted by length, is the likeness.
"""

from __future__ import annotations

import hashlib
from base64 import b64decode, b64encode
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import SLICE_BYTES, mix64, partitions, table

#: Bytes of a chunk: least, normal, most (a text's last chunk may be shorter than the least).
LEAST, NORMAL, MOST = 16, 40, 128
_GEAR = (mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(0xFFFF)).astype(np.uint16)
_HARD, _EASY = np.uint16(0b1111111 << 9), np.uint16(0b1111 << 12)


def chunk_ends(joined: np.ndarray, start: np.ndarray) -> list[list[int]]:
    """For each text joined[start[i]:start[i+1]], the ends of its chunks. Texts without bytes have none."""
    rolled = _GEAR[joined]
    for step in (1, 2, 4, 8):
        shifted = np.zeros_like(rolled)
        shifted[step:] = rolled[:-step] << np.uint16(step)
        rolled = rolled + shifted
    easy = np.flatnonzero((rolled & _EASY) == 0) + 1
    hard = np.flatnonzero((rolled & _HARD) == 0) + 1
    far = len(joined) + 2 * MOST
    easy_at, hard_at = [*easy.tolist(), far], [*hard.tolist(), far]

    def after(at: int) -> int:
        first = hard_at[bisect_left(hard_at, at + LEAST)]
        if first < at + NORMAL:
            return first
        second = easy_at[bisect_left(easy_at, at + NORMAL)]
        return second if second <= at + MOST else at + MOST

    # where a chunk that begins at an easy boundary ends, for all of them at once
    first = np.append(hard, far)[np.searchsorted(hard, easy + LEAST)]
    second = np.append(easy, far)[np.searchsorted(easy, easy + NORMAL)]
    end = np.where(first < easy + NORMAL, first, np.minimum(second, easy + MOST))
    jump = dict(zip(easy_at, end.tolist()))
    out = []
    for a, b in zip(start[:-1].tolist(), start[1:].tolist()):
        ends, at = [], a
        while at < b:
            at = jump.get(at) or after(at)
            if at > b:
                at = b
            ends.append(at)
        out.append(ends)
    return out


def chunk_sets(texts: list[str]) -> list[set[int]]:
    """For each text its chunks as numbers: 40 bits of digest, then 8 bits of length."""
    raw = [x.encode() for x in texts]
    joined = b"".join(raw)
    start = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(x) for x in raw], out=start[1:])
    digest = xxhash.xxh3_64_intdigest
    out = []
    for a, ends in zip(start.tolist(), chunk_ends(np.frombuffer(joined, np.uint8), start)):
        found = set()
        for b in ends:
            found.add((digest(joined[a:b]) >> 24 << 8) | (b - a))
            a = b
        out.append(found)
    return out


def pack(chunks: set[int]) -> str:
    """A set as text: sorted six-byte numbers in base 64."""
    return b64encode(np.array(sorted(chunks), dtype=">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()).decode()


def unpack(fingerprint: str) -> set[int]:
    raw = b64decode(fingerprint)
    return {int.from_bytes(raw[i : i + 6], "big") for i in range(0, len(raw), 6)}


def containment(a: set[int], b: set[int]) -> float:
    """The share of a's bytes that lie in chunks of b; of no bytes: 1.0 if b has none either, else 0.0."""
    if not a:
        return 0.0 if b else 1.0
    return sum(x & 255 for x in a & b) / sum(x & 255 for x in a)


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with a column fingerprint (string, replaced if there); null counts as empty, empty texts have ""."""

    def run(texts: Iterator) -> Iterator:
        import pandas as pd

        for part in texts:
            values, out, size, group = part.fillna("").tolist(), [], 0, []
            for x in [*values, None]:
                if x is None or size + len(x) > SLICE_BYTES:
                    out += [pack(s) for s in chunk_sets(group)]
                    size, group = 0, []
                if x is not None:
                    size += len(x)
                    group.append(x)
            yield pd.Series(out, index=part.index, dtype=object)

    return docs.withColumn("fingerprint", F.pandas_udf(run, "string", F.PandasUDFType.SCALAR_ITER)(F.col(text_col)))


def id_groups(docs: DataFrame, id_col: str, groups: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Boundaries that cut the ids into about equal ranges, and each range's largest id, from the largest range down.

    Both hold at most `groups` numbers, however many rows there are."""
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63)))
    cuts = docs.select(F.percentile_approx(key, [i / groups for i in range(1, groups)] or [0.5], 10000).alias("c")).first()["c"] or []
    cuts = np.unique(np.array(cuts, np.int64))
    return cuts, _largest(docs.select(key.alias("k")), cuts)


def _group_udf(cuts: np.ndarray):
    import pandas as pd

    return F.pandas_udf(lambda k: pd.Series(len(cuts) - np.searchsorted(cuts, k.to_numpy(), side="left")), "long")


def _largest(keys: DataFrame, cuts: np.ndarray) -> list[tuple[int, int]]:
    rows = keys.groupBy(_group_udf(cuts)("k").alias("g")).agg(F.max("k").alias("m")).collect()
    return sorted((r["g"], r["m"]) for r in rows)


RESULT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's fingerprint beside those of its edited text and of the next document.

    The next document is the one with the next smaller id, after the last the first. The edited text has its last
    floor(n/3) code points replaced by the first as many, or all, of the next document's. Null texts count as empty; a
    null id counts as the smallest number; rows with equal ids follow each other by text; a single document is its
    own next; no rows give none. Other columns are not looked at.

    The texts are dealt once, by ranges of ids; the first document of a range also goes to the range before it.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    key = F.coalesce("doc_id", F.lit(-(2**63)))
    cuts, largest = id_groups(docs, id_col, 4 * partitions(spark))
    before = {m: largest[i - 1][0] for i, (_, m) in enumerate(largest)}  # of the first of all: the last range
    own = _group_udf(cuts)(key)
    edges = F.create_map(*[F.lit(x) for pair in before.items() for x in pair]) if before else F.lit(None).cast("map<bigint,bigint>")
    placed = base.withColumn("k", key).withColumn("own", own).withColumn("to", F.filter(F.array(F.col("own"), edges[F.col("k")]), lambda x: x.isNotNull()))
    dealt = placed.select("doc_id", "k", "text", F.posexplode("to").alias("edge", "range"))
    dealt = dealt.repartition(partitions(spark), "range").sortWithinPartitions("range", "edge", F.col("k").desc(), "text").select("doc_id", "text", "edge", "range")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for row in zip(*(batch[c].to_pylist() for c in ("range", "edge", "doc_id", "text"))):
                rows.append(row)
                size += len(row[3])
                if size > SLICE_BYTES // 2:
                    yield from compared(rows)
                    rows, size = rows[-1:], 0
        yield from compared(rows)

    def compared(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
        pairs = [i for i in range(len(rows) - 1) if rows[i][0] == rows[i + 1][0] and not rows[i][1]]
        if not pairs:
            return
        texts = [r[3] for r in rows]
        edited = []
        for i in pairs:
            n = len(texts[i]) // 3
            edited.append(texts[i][: len(texts[i]) - n] + texts[i + 1][:n])
        own, other = chunk_sets(texts), chunk_sets(edited)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][2] for i in pairs], pa.int64()),
                pa.array([len(texts[i]) for i in pairs], pa.int64()),
                pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited]),
                pa.array([pack(own[i]) for i in pairs]),
                pa.array([pack(x) for x in other]),
                pa.array([containment(own[i], x) for i, x in zip(pairs, other)]),
                pa.array([containment(own[i], own[i + 1]) for i in pairs]),
            ],
            schema=RESULT,
        )

    return dealt.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op1_content_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_with_edits(table(spark, sf_dir, "documents"))
