"""Compares a query with its SQL in DuckDB, as sets of rows."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, float):
        v = float(f"{v:.9g}") + 0.0
        return int(v) if abs(v) < 1e9 and v == int(v) else v  # integers with nulls among them come as floats
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    return v if isinstance(v, (str, bool)) else int(v) if type(v).__name__.startswith("int") else str(v)


def rows_of(frame: pd.DataFrame, columns: list[str]) -> list:
    return sorted(tuple(map(str, map(_plain, r))) for r in frame[columns].astype(object).itertuples(index=False))


def assert_same(spark, query, sql: str, folder: str, tables: list[str] = TABLES) -> pd.DataFrame:
    ours = query(spark, folder).toPandas()
    db = duckdb.connect()
    for name in tables:
        db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    theirs = db.sql(sql).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    columns = sorted(ours.columns)
    assert rows_of(ours, columns) == rows_of(theirs, columns)
    return ours
