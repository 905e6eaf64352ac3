"""Periodic runs against a plain search, in one piece and dealt out by lags, and on odd rows."""

import random
import zlib
from pathlib import Path

import pytest
from compare import assert_same

from barloom.llm import periodic

FOLDER = "/root/testdata/sf0.001"


def plain(words, least=6, repeats=4):
    """Every stretch that can't be made longer, by its definition; the smallest period is found by trying all."""
    n, out = len(words), []
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, repeats * q) and not any(all(words[k] == words[k + p] for k in range(i, j + q - p)) for p in range(1, q)):
                out.append((i, j + q - i, q))
            i = j + 1
    gone = {k for a, length, q in out for k in range(a + q, a + length)}
    return sorted(out), " ".join(w for k, w in enumerate(words) if k not in gone)


def texts():
    rng, out = random.Random(5), [None, "", "  \t\n", "a", "a a a a a", "a a a a a a", "A a A a A a A a", "a b " * 40, "a a b " * 30 + "a a", "x " * 300]
    for size in range(400):
        ws = rng.choices("ab" if size % 3 else "abcde", k=rng.randrange(1, 60))
        for _ in range(rng.randrange(3)):
            ws += rng.choices("abcd", k=rng.randrange(1, 7)) * rng.randrange(2, 9)
        out.append(rng.choice([" ", "\n", "\t ", "\r\n"]).join(ws))
    return out + ["a b c d " * 20, "a b c d " * 20, "é ü ö é ü ö " * 4 + "é\x1cz"]


@pytest.mark.parametrize("lags, least, repeats", [(4096, 6, 4), (2, 6, 4), (5, 4, 2), (3, 9, 3)])
def test_equals_plain_search(spark, lags, least, repeats):
    docs = [(i, x, "kept") for i, x in enumerate(texts())]
    df = spark.createDataFrame(docs, "id long, text string, runs string").repartition(3)
    found = periodic.periodic_runs(df.withColumn("key", df.id), lags=lags, least=least, repeats=repeats)
    assert found.columns == ["id", "text", "key", "runs", "collapsed"]
    rows = {r.id: r for r in found.collect()}
    assert len(rows) == len(docs)
    for i, text, _ in docs:
        split = [x for x in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in text or "").split(" ") if x]
        runs, left = plain(split, least, repeats)
        assert [tuple(x) for x in rows[i].runs] == runs, (i, text)
        assert rows[i].collapsed == left


def test_long_texts_are_dealt_out_by_lags(spark):
    """Copies of a long text have one set of rows, repeated rows stay, and ranges of lags agree with one piece."""
    rng = random.Random(2)
    piece = " ".join(f"w{rng.randrange(400)}" for _ in range(700))
    text = f"{piece} " * 5 + "end " * 9
    df = spark.createDataFrame([(i % 3, text) for i in range(6)], "id long, text string")
    dealt, whole = (sorted(map(str, periodic.periodic_runs(df, lags=lags).collect())) for lags in (100, 4096))
    assert dealt == whole and len(dealt) == 6
    assert [tuple(x) for x in periodic.periodic_runs(df, lags=100).first().runs] == [(0, 3500, 700), (3500, 9, 1)]


def test_loops():
    """Word i >= a is word a + (i - a) % p."""
    for doc_id in range(300):
        h = zlib.crc32(str(doc_id).encode())
        ws = [f"w{i}" for i in range(doc_id % 70)]
        want = list(ws)
        if h % 10 == 0 and ws:
            a = h // 10 % len(ws)
            want[a:] = [ws[a + (i - a) % (1 + (len(ws) - a) // (3 + h // 10 % 8))] for i in range(a, len(ws))]
        assert periodic.loop(doc_id, " ".join(ws)) == " ".join(want)
    assert periodic.loop(1, None) is None


def test_empty_table(spark):
    assert periodic.periodic_runs(spark.createDataFrame([], "text string")).count() == 0


@pytest.mark.skipif(not Path(FOLDER).exists(), reason="needs the test tables")
def test_query_matches_sql(spark):
    found = assert_same(spark, periodic.op12_periodic_runs, periodic.OP12_SQL, FOLDER)
    assert (found["n_runs"] > 0).sum() > 5
