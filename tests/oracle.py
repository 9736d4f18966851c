"""Runs a query and its oracle SQL on one data set and compares the rows."""

import math
import os

import duckdb

DATA = "/root/testdata/sf0.001"


def connect():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM read_parquet('{DATA}/{file}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return "~" if value is None else str(value)


def rows_of_both(spark, con, query, sql):
    df = query(spark, DATA)
    cols = sorted(df.columns)
    mine = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    result = con.execute(sql)
    names = [c[0] for c in result.description]
    assert sorted(names) == cols
    return mine, sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in result.fetchall())
