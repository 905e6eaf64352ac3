"""Benchmark decontamination by pigeonhole edit matching.

A test item that may differ from a passage by k edits is split into k + 1 pieces: one of them must stand in the
passage unchanged. An automaton finds all pieces in a text in one pass; the places around the hits are verified with
Myers' bit-parallel edit distance.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import slices, stored, table

#: Edits allowed for a character of an item.
ERROR_RATE = 0.05
#: Characters of items that one pass over the documents holds, about; more items take more passes.
BLOCK_CHARS = 2_000_000
_OTHER = re.compile(r"[\W_]+")


def normal(text: str | None) -> str:
    """Lower case, with single blanks for all runs of other characters than letters and digits."""
    return _OTHER.sub(" ", (text or "").lower()).strip()


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece): errors + 1 pieces of about equal length that make up the item."""
    cuts = [len(item) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:]) if b > a]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """The least edit distance of pattern to any substring of text, and where the first such substring ends."""
    m = len(pattern)
    if not m:
        return 0, 0
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score = full, 0, m
    best, end = m, 0
    for i, c in enumerate(text):
        eq = masks[c] if c in masks else 0
        diagonal = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | (full & ~(diagonal | up)), up & diagonal
        if plus & top:
            score += 1
        elif minus & top:
            score -= 1
        plus, minus = (plus << 1) & full, (minus << 1) & full
        up, down = minus | (full & ~(diagonal | plus)), plus & diagonal
        if score < best:
            best, end = score, i + 1
    return best, end


class Matcher:
    """All items of one block; items whose normal form is empty match nothing."""

    def __init__(self, items: list[tuple], rate: float = ERROR_RATE):
        self.items = [(key, x, int(len(x) * rate)) for key, x in ((key, normal(text)) for key, text in items) if x]
        found: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, (_, x, errors) in enumerate(self.items):
            for offset, piece in pieces(x, errors):
                found[piece].append((n, offset))
        self.automaton = ahocorasick.Automaton()
        for piece, where in found.items():
            self.automaton.add_word(piece, (len(piece), where))
        if found:
            self.automaton.make_automaton()

    def matches(self, text: str | None) -> list[tuple[int, int, int]]:
        """(number of the item, least distance, end in the normalised text) of each item within its error budget."""
        plain = normal(text)
        if not self.items or not plain:
            return []
        near: dict[int, list[int]] = defaultdict(list)
        for last, (size, where) in self.automaton.iter(plain):
            for n, offset in where:
                near[n].append(last + 1 - size - offset)
        out = []
        for n, begins in near.items():
            _, item, errors = self.items[n]
            best = None
            begins = sorted(set(begins))
            i = 0
            while i < len(begins):
                a = b = begins[i]
                while i < len(begins) and begins[i] <= b + len(item):  # places that overlap are verified together
                    b = begins[i]
                    i += 1
                a, b = max(0, a - errors), b + len(item) + errors
                distance, end = myers(item, plain[a:b])
                if distance <= errors and (best is None or (distance, a + end) < best):
                    best = (distance, a + end)
                    if not distance:
                        break
            if best:
                out.append((n, *best))
        return sorted(out)


def blocks(benchmark: DataFrame, chars: int = BLOCK_CHARS) -> Iterator[tuple[bool, list[tuple]]]:
    """Whether it is the last one, and the items (item_id, text) of each block of about chars characters."""
    size = benchmark.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-size // chars)
    for i in range(n):
        yield i == n - 1, [tuple(r) for r in benchmark.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i).select("item_id", "text").orderBy("item_id", "text").collect()]


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, id_col: str = "doc_id", text_col: str = "text", chars: int = BLOCK_CHARS) -> DataFrame:
    """(id, item_id, distance, ends): a row for each document and item of which the document has a passage within
    floor(rate * length) edits of the item, both normalised; ends: where the best one ends in the normalised text.

    Null texts and empty items match nothing; equal items each give a row; rows of docs that repeat give repeated
    rows; no items or no documents give no rows. Items are held in blocks of bounded size, one pass for each.
    """
    kinds = docs.schema[id_col].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    key = benchmark.schema["item_id"].dataType

    def over(items: list[tuple]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_type

            matcher = Matcher(items, rate)
            for part in slices(batches):
                found = [(i, m) for i, text in enumerate(part["text"].to_pylist()) for m in matcher.matches(text)]
                yield pa.RecordBatch.from_arrays([part["id"].take(pa.array([i for i, _ in found], pa.int64())), pa.array([matcher.items[m[0]][0] for _, m in found], to_arrow_type(key)), pa.array([m[1] for _, m in found], pa.int32()), pa.array([m[2] for _, m in found], pa.int64())], ["id", "item_id", "distance", "ends"])

        return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kinds[0]}, item_id {kinds[1]}, distance int, ends long")

    parts = []
    for last, items in blocks(benchmark, chars):
        parts.append(over(items) if last and not parts else stored(over(items), "leaks"))  # of several blocks the driver has one at a time
    if not parts:
        parts = [docs.sparkSession.createDataFrame([], f"id {kinds[0]}, item_id {kinds[1]}, distance int, ends long")]
    return reduce(DataFrame.unionAll, parts).withColumnRenamed("id", id_col)


def without_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE, text_col: str = "text", chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows of docs that have no passage of an item, with the columns of docs. Rows with null or empty texts stay,
    repeated rows stay or go together; without items all rows stay."""
    for last, items in blocks(benchmark, chars):

        def leaks(parts, items=items):
            import pandas as pd

            matcher = Matcher(items, rate)
            for part in parts:
                yield pd.Series([bool(isinstance(x, str) and matcher.matches(x)) for x in part], dtype=bool)

        docs = docs.filter(~F.pandas_udf(leaks, "boolean", F.PandasUDFType.SCALAR_ITER)(text_col))
        docs = docs if last else stored(docs, "unleaked")
    return docs


def op5_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
