"""Compare a query's rows with what DuckDB makes of the same tables."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float) or type(v).__name__ == "Decimal":
        v = round(float(v), 5)
        return int(v) if v == int(v) else v
    if isinstance(v, list | tuple):
        return tuple(plain(x) for x in v)
    return v if isinstance(v, int | str | bytes) else str(v)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


def duck(sf_dir: str, sql: str):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return sorted(names), rows(names, cur.fetchall())


def same(df, sf_dir: str, sql: str) -> None:
    names, want = duck(sf_dir, sql)
    assert sorted(df.columns) == names
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == want
