"""Compares a query's rows with those of its SQL in DuckDB."""

import glob
import math
import os

import duckdb
import pandas as pd

DATA = "/root/testdata"


def plain(value):
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if value is None or value is pd.NA or value is pd.NaT or isinstance(value, float) and math.isnan(value):
        return None
    # A whole number is one, though a column with nulls made it a float.
    if isinstance(value, float) and value.is_integer() and abs(value) < 1 << 53:
        return str(int(value))
    return repr(value) if isinstance(value, float) else str(value)


def rows(frame, cols):
    return sorted((tuple(plain(v) for v in r) for r in frame[cols].astype(object).itertuples(index=False, name=None)), key=str)


def compare(spark, query, sql, sf="sf0.01"):
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    got = query(spark, f"{DATA}/{sf}").toPandas()
    want = con.execute(sql).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert rows(got, cols) == rows(want, cols)
    assert len(got) > 0
