"""Holds a query's rows against its SQL in DuckDB."""

import math
import os

import duckdb
import pandas as pd


def connect(sf_dir):
    con = duckdb.connect()
    for t in os.listdir(sf_dir):
        p = f"{sf_dir}/{t}"
        con.sql(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 9)
    return int(v) if hasattr(v, "__int__") and not isinstance(v, (str, bool)) else str(v)


def rows(frame):
    cols = sorted(frame.columns)
    return sorted((tuple(map(plain, r)) for r in frame[cols].itertuples(index=False, name=None)), key=lambda r: [(x is not None, str(type(x)), x) for x in r])


def agree(spark, con, query, sql, sf_dir):
    mine, theirs = query(spark, sf_dir).toPandas(), con.sql(sql).df()
    assert sorted(mine.columns) == sorted(theirs.columns)
    assert rows(mine) == rows(theirs)
