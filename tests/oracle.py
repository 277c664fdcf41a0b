"""Holds a query against its SQL: same columns, same rows in any order."""

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else repr(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in data)


def sql_rows(sf_dir, sql):
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir) / f"{t}.parquet"
        if p.exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    q = con.execute(sql)
    names = [d[0] for d in q.description]
    return sorted(names), rows(names, q.fetchall())


def assert_same(df, sf_dir, sql):
    names, expected = sql_rows(sf_dir, sql)
    assert sorted(df.columns) == names
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    assert len(got) == len(expected)
    assert got == expected
