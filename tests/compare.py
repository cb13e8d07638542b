"""Compares Spark results with DuckDB's on the same tables."""

import math
import os
from collections import Counter

import duckdb
import pandas as pd

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder=DATA):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, (list, tuple)) or type(v).__name__ == "ndarray":
        return tuple(plain(x) for x in v)
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float) and v == int(v) and abs(v) < 1e15:
        return int(v)
    return v if isinstance(v, (int, float, bool, str)) else str(v)


def rows(df, columns):
    return Counter(tuple(plain(v) for v in x) for x in df[columns].itertuples(index=False, name=None))


def differences(spark_df, duck_df):
    columns = sorted(spark_df.columns)
    assert columns == sorted(duck_df.columns)
    a, b = rows(spark_df, columns), rows(duck_df, columns)
    return list((a - b).items())[:3], list((b - a).items())[:3]
