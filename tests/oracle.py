"""Runs a query in Spark and its SQL in DuckDB and compares the rows."""

import glob
import math
import os

import duckdb


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or type(v).__name__ == "NaTType":
        return None
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        return round(float(v), 5) + 0.0
    return str(v)


def rows(df):
    df = df.reindex(sorted(df.columns), axis=1)
    return sorted((tuple(map(_cell, r)) for r in df.itertuples(index=False)), key=repr)


def duck(sf, sql):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con.sql(sql).df()


def check(spark, sf, query, sql):
    got, want = query(spark, sf).toPandas(), duck(sf, sql)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
