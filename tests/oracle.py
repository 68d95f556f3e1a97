"""Compares a registered query with its SQL in DuckDB."""

import math
import numbers
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame, columns):
    def cell(x):
        if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and math.isnan(x)):
            return None
        return repr(float(x) + 0.0) if isinstance(x, numbers.Number) and not isinstance(x, bool) else str(x)

    return sorted((tuple(cell(x) for x in r) for r in frame[columns].itertuples(index=False)), key=str)


def connect(sf):
    db = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        if os.path.exists(path):
            db.sql(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return db


def compare(spark, name, query, sql, sf):
    ours, theirs = query(spark, sf).toPandas(), connect(sf).sql(sql).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns), name
    assert rows(ours, columns) == rows(theirs, columns), name
