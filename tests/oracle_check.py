"""Spark and DuckDB side by side."""

import math
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(x):
    if x is None or x is pd.NA or x is pd.NaT:
        return "NULL"
    if isinstance(x, float):
        return "NULL" if math.isnan(x) else f"{x:.9g}"
    if hasattr(x, "__len__") and not isinstance(x, (str, bytes, dict)):
        return repr([plain(y) for y in x])
    return str(x)


def rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(tuple(plain(v) for v in r) for r in pdf[cols].itertuples(index=False, name=None))


def assert_same(spark, con, query, sql, sf_dir):
    a, b = rows(query(spark, sf_dir).toPandas()), rows(con.execute(sql).df())
    assert a[0] == b[0]
    assert len(a[1]) == len(b[1])
    assert a[1] == b[1]
