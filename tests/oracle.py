"""Runs a query and its DuckDB equivalent on the same tables and compares the rows, in any order."""

import glob
import os

import duckdb

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def compare(spark, query, sql, sf=SF):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    df = query(spark, sf)
    columns = sorted(df.columns)
    mine = sorted(repr([plain(r[c]) for c in columns]) for r in df.collect())
    con.execute(sql)
    names = [d[0] for d in con.description]
    assert sorted(names) == columns
    theirs = sorted(repr([plain(r[names.index(c)]) for c in columns]) for r in con.fetchall())
    assert mine == theirs
