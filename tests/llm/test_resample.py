"""Importance resampling against a plain count of n-grams, and on odd rows."""

import hashlib
import math
import re
import zlib
from collections import Counter
from pathlib import Path

import pyarrow as pa
import pytest
from compare import assert_same

from barloom.llm import resample

FOLDER = "/root/testdata/sf0.001"


def plain(docs, target, longest=2, buckets=10_000, least=20, percent=25, seed=7):
    def grams(text):
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        runs = [" ".join(ws[i : i + k]) for k in range(1, longest + 1) for i in range(len(ws) - k + 1)]
        return len(ws), [zlib.crc32(x.encode()) % buckets for x in runs]

    of = [(i, *grams(x)) for i, x in docs]
    s, t = Counter(b for _, _, g in of for b in g), Counter(b for x in target for b in grams(x)[1])
    total, wanted = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (total + buckets) / ((s[b] + 1) * (wanted + buckets)))) for b in s}
    rows = []
    for i, n, g in of:
        weight = sum(map(gain.get, g)) // len(g) if g else 0
        h = int(hashlib.sha256(f"{seed}:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))])
    able = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0]))
    ranks = {id(r): k + 1 for k, r in enumerate(able[: len(able) * percent // 100])}
    return sorted((tuple([*r, ranks.get(id(r))]) for r in rows), key=str)


@pytest.mark.parametrize("longest, percent", [(1, 100), (2, 40), (4, 70)])
def test_equals_plain_counts(spark, longest, percent):
    texts = ["The cat_sat on the mat, THE mat.", None, "", "...", "a", "é ünï 12 é ünï 12 é", "x " * 900, "one two three " * 7, "ÀB cD\x7fe\x00f"]
    docs = [(i, texts[i % len(texts)]) for i in range(70)] + [(None, texts[0]), (3, texts[0]), (3, texts[0])]
    target = ["the mat", "é ünï", None]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    found = resample.resample(df.withColumn("weight", df.doc_id), spark.createDataFrame([(x,) for x in target], "text string"), percent=percent, least_words=2, longest=longest, buckets=50)
    assert sorted(map(tuple, found.collect()), key=str) == plain(docs, target, longest, 50, 2, percent)


def test_tuples_are_hashed_by_their_bytes():
    bucket, owner, n = resample.buckets_of(pa.array(["b a b a", "", None, "a b"]), 3, 1 << 32)
    want = [(0, x) for x in ["b", "a", "b", "a", "b a", "a b", "b a", "b a b", "a b a"]] + [(3, x) for x in ["a", "b", "a b"]]
    assert sorted(zip(owner.tolist(), bucket.tolist())) == sorted((i, zlib.crc32(x.encode())) for i, x in want)
    assert n.tolist() == [4, 0, 0, 2]


def test_ties_are_spread_and_ranked_once(spark):
    rows = spark.range(3000).selectExpr("5L AS score", "id % 3 AS doc_id")
    found = [(r.rank, r.doc_id) for r in resample.ranked(rows).collect()]
    assert sorted(found) == [(i + 1, i // 1000) for i in range(3000)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, "a b c " * 9)], "doc_id long, text string")
    assert resample.resample(none, one).count() == 0
    assert [tuple(r) for r in resample.resample(one, none, percent=100).select("doc_id", "n_features", "rank").collect()] == [(1, 53, 1)]


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the test tables")
def test_query_matches_sql(spark):
    found = assert_same(spark, resample.op11_importance_resample, resample.OP11_SQL, FOLDER)
    assert len(found) == 200 and found["rank"].notna().sum() > 20
