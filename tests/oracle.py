"""Comparison of a query with its SQL on the same tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{folder}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/*' if os.path.isdir(p) else p}')")
    return c


def rows(frame):
    import pandas as pd

    columns = sorted(frame.columns)
    text = lambda v: "NULL" if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v) else f"{v:.9g}" if isinstance(v, float) else str(v)
    return columns, sorted(tuple(text(v) for v in r) for r in frame[columns].astype(object).itertuples(index=False))
