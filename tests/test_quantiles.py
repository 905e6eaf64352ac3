"""Exact quantiles against numpy: ties, hot values, nulls, single values, null keys, infinities and empty tables."""

import numpy as np
import pandas as pd
import pytest

from barloom.functions.quantiles import quantiles

SHARES = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]


@pytest.mark.parametrize("ranges", [2, 7, 64])
def test_equals_numpy(spark, ranges):
    rng, n = np.random.default_rng(3), 2000
    groups = {"wide": rng.standard_cauchy(n), "hot": np.where(rng.random(n) < 0.7, 5.0, rng.normal(0, 1, n)), "few": rng.integers(0, 3, n).astype(float), "one": np.array([4.0]), "two": np.array([1.0, 2.0]), "inf": np.array([-np.inf, 1.0, np.inf])}
    rows = [(k, float(x)) for k, v in groups.items() for x in v] + [("hot", None), ("void", None), (None, 1.0), (None, 3.0)]
    df = spark.createDataFrame(pd.DataFrame(rows, columns=["k", "x"]).astype({"x": object}).where(lambda f: f.notna(), None).values.tolist(), "k string, x double").repartition(6)
    found = {r.k: r for r in quantiles(df, ["k"], "x", SHARES, ranges).collect()}
    groups[None] = np.array([1.0, 3.0])
    assert set(found) == set(groups)
    for k, v in groups.items():
        assert found[k].n == len(v)
        if k != "inf":
            assert np.allclose(found[k].q, np.quantile(v, SHARES), rtol=1e-12), k
    assert found["inf"].q[3] == 1.0 and found["inf"].q[0] == -np.inf


def test_empty_table_and_no_keys(spark):
    none = spark.createDataFrame([], "k string, x double")
    assert quantiles(none, ["k"], "x", SHARES).count() == 0
    assert [r.q for r in quantiles(spark.range(5).selectExpr("double(id) AS x"), [], "x", [0.5]).collect()] == [[2.0]]
