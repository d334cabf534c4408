"""A Spark result against DuckDB's over the same tables."""

import os

import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf):
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        if os.path.exists(path):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return c


def plain(df):
    df = df[sorted(df.columns)].copy()

    def cell(x):
        if x is None or x is pd.NA or x is pd.NaT or (isinstance(x, float) and x != x):
            return "NULL"
        if isinstance(x, (bool, str)):
            return str(x)
        if hasattr(x, "__len__"):
            return str(list(x))
        return str(float(x) + 0.0) if isinstance(x, float) else str(x)

    for k in df.columns:
        if pd.api.types.is_bool_dtype(df[k]):
            df[k] = df[k].astype(str)
        elif pd.api.types.is_numeric_dtype(df[k]):
            df[k] = df[k].astype(float).round(9)
        df[k] = df[k].map(cell)
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def same(got, want):
    assert sorted(got.columns) == sorted(want.columns)
    a, b = plain(got), plain(want)
    assert len(a) == len(b)
    pd.testing.assert_frame_equal(a, b)
