"""Rows of a query against those of its SQL."""

import glob
import os

import duckdb


def connection(folder):
    c = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path)[:-8]
        c.execute(f"create view {name} as select * from read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else f"{v:.7g}"
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def same(df, sql, folder):
    r = connection(folder).execute(sql)
    names = [x[0] for x in r.description]
    assert set(names) == set(df.columns)
    order = [names.index(c) for c in df.columns]
    want = sorted((tuple(plain(row[i]) for i in order) for row in r.fetchall()), key=repr)
    got = sorted((tuple(plain(v) for v in row) for row in df.collect()), key=repr)
    assert got == want
