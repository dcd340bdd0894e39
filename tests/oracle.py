"""Holds registered queries against their SQL in DuckDB."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of_sql(sql: str, sf_dir: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, (bytes, bytearray)):
        return bytes(x)
    return x


def same(df, sql: str, sf_dir: str) -> None:
    names, want = rows_of_sql(sql, sf_dir)
    got = df.collect()
    assert sorted(df.columns) == sorted(names), (df.columns, names)
    order = sorted(names)
    a = sorted((tuple(plain(r[c]) for c in order) for r in got), key=repr)
    b = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in want), key=repr)
    assert len(a) == len(b), (len(a), len(b))
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    assert not bad, bad[:3]
