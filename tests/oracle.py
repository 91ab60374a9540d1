"""Compare queries with their SQL in DuckDB on the test tables; used by the tests of both halves of the library."""

import glob
import math
import os

import duckdb

from quern.runtime import scope


def connect(sf):
    con = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f if os.path.isfile(f) else f + '/*'}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if hasattr(v, "isoformat"):
        return str(v)[:19]
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    made = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(made, key=lambda r: tuple((v is None, type(v).__name__, str(v)) for v in r))


def same(spark, con, query, sql, sf):
    with scope():
        df = query(spark, sf)
        got = rows_of(df.columns, df.collect())
    answer = con.execute(sql)
    names = [d[0] for d in answer.description]
    assert sorted(df.columns) == sorted(names)
    assert got == rows_of(names, answer.fetchall())
