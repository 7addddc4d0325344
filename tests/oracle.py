"""Side-by-side comparison of a query with its SQL."""

import glob
import math
import os

import duckdb


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return repr(v)


def connection(data):
    con = duckdb.connect(config={"threads": 2})
    for f in glob.glob(f"{data}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def assert_same(spark, data, con, query, sql):
    df = query(spark, data)
    cols = sorted(df.columns)
    got = sorted(tuple(_norm(v) for v in r) for r in df.select(*cols).collect())
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    want = sorted(tuple(_norm(r[i]) for i in at) for r in res.fetchall())
    assert got == want
