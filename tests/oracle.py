"""Side-by-side comparison of a query with its SQL."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd


def plain(x):
    if pd.isna(x):
        return None
    return round(float(x), 4) + 0.0 if isinstance(x, (int, float, np.number)) else x


def rows(df):
    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False)), key=str)


def compare(spark, name, query, sql, sf_dir):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    want, got = con.execute(sql).df(), query(spark, sf_dir).toPandas()
    assert sorted(want.columns) == sorted(got.columns), name
    assert len(want) == len(got), (name, len(want), len(got))
    a, b = rows(want), rows(got)
    assert a == b, (name, [x for x in zip(a, b, strict=True) if x[0] != x[1]][:3])
