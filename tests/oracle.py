"""Compares a Spark result with DuckDB over the same tables, as multisets of rows."""

import os
from collections import Counter

import duckdb

from millrace.sources.tables import TABLES


def plain(x):
    if isinstance(x, float):
        return None if x != x else repr(round(x, 9) + 0.0)
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    return str(x) if x is not None else None


def duck(sf_dir, sql):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    rel = con.execute(sql)
    names = [x[0] for x in rel.description]
    return names, rel.fetchall()


def same(df, sf_dir, sql):
    names, rows = duck(sf_dir, sql)
    assert sorted(df.columns) == sorted(names), (df.columns, names)
    order = sorted(names)
    mine = Counter(tuple(plain(r[c]) for c in order) for r in df.collect())
    theirs = Counter(tuple(plain(r[names.index(c)]) for c in order) for r in rows)
    assert mine == theirs, (len(mine), len(theirs), list((mine - theirs).items())[:3], list((theirs - mine).items())[:3])
    return sum(mine.values())
