"""Compares a query with its SQL in DuckDB, as multisets of rows with the columns sorted by name."""

import math
import os
from collections import Counter

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(sf_dir=SF):
    c = duckdb.connect()
    for name in os.listdir(sf_dir):
        path = f"{sf_dir}/{name}"
        c.execute(f"create view {name.split('.')[0]} as select * from read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return c


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.10g}")
    return x


def differences(df, sql, connection):
    names = sorted(df.columns)
    ours = Counter(tuple(_plain(r[n]) for n in names) for r in df.collect())
    result = connection.execute(sql)
    at = [d[0] for d in result.description]
    assert sorted(at) == names, (names, sorted(at))
    theirs = Counter(tuple(_plain(r[at.index(n)]) for n in names) for r in result.fetchall())
    return list((ours - theirs).items())[:3], list((theirs - ours).items())[:3]
