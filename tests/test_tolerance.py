"""The tolerance join against a two-pointer loop on dense, bursty and tied rows."""

import numpy as np
import pandas as pd
import pytest

from barloom.operators import align


def two_pointers(a, b, seconds, later):
    out = []
    for symbol in sorted({x[0] for x in a} & {x[0] for x in b}):
        p, q = sorted(x[1:] for x in a if x[0] == symbol), sorted(x[1:] for x in b if x[0] == symbol)
        if later:
            start = max(p[0][0], q[0][0])
            p, q = [x for x in p if x[0] >= start], [x for x in q if x[0] >= start]
        i = j = 0
        while i < len(p) and j < len(q):
            if abs(p[i][0] - q[j][0]) <= seconds:
                out.append((symbol, p[i][0], q[j][0]))
                i, j = i + 1, j + 1
            elif p[i][0] < q[j][0]:
                i += 1
            else:
                j += 1
    return sorted(out)


@pytest.mark.parametrize("later", [False, True])
@pytest.mark.parametrize("rows", [5, 100_000])
def test_equals_two_pointers(spark, rows, later):
    rng = np.random.default_rng(2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)  # pairs reach over batches
    try:
        def side(shift):
            gaps = rng.choice([0, 1, 7, 30, 61, 900], 600, p=[0.1, 0.3, 0.3, 0.2, 0.05, 0.05]).cumsum() + shift
            return [(str(s), int(t), k) for k, (s, t) in enumerate(zip(rng.choice(["x", "y"], 600), gaps))]

        a, b = side(0), [*side(200), ("only b", 5, 0)]
        frames = []
        for part in (a, b):
            f = pd.DataFrame(part, columns=["symbol", "t", "close"])
            f["timestamp"] = pd.to_datetime(f["t"], unit="s").astype("datetime64[us]")
            frames.append(spark.createDataFrame(f[["symbol", "timestamp", "close"]]))
        found = align.tolerance_join(*frames, 60, later, rows)
        assert found.columns == ["symbol", "timestamp", "close", "dataset1_unix_timestamp", "dataset2_close", "dataset2_unix_timestamp"]
        got = sorted((r.symbol, r.dataset1_unix_timestamp, r.dataset2_unix_timestamp) for r in found.collect())
        assert got == two_pointers(a, b, 60, later)
        each = found.select("symbol", "close").distinct().count()
        assert each == len(got)  # one to one
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_empty_and_null_rows(spark):
    a = spark.createDataFrame([("x", None, 1.0), (None, pd.Timestamp("2024-01-01").to_pydatetime(), 2.0)], "symbol string, timestamp timestamp_ntz, close double")
    assert align.tolerance_join(a, a).count() == 0 and align.tolerance_join(a.limit(0), a).count() == 0
