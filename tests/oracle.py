"""Comparing a query's rows with its SQL's, column by column in order of name."""

from __future__ import annotations

import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        return round(float(x), 6)
    return x


def rows(columns, found) -> Counter:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return Counter(tuple(plain(r[k]) for k in order) for r in found)


def compare(spark, queries, oracle, sf_dir: str, name: str) -> str | None:
    """null if the rows are the same, else what differs."""
    df = queries[name](spark, sf_dir)
    got = rows(df.columns, df.collect())
    cur = connect(sf_dir).execute(oracle[name])
    names = [d[0] for d in cur.description]
    want = rows(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if got != want:
        return f"{sum(got.values())} and {sum(want.values())} rows; only here {list((got - want).items())[:3]}; only in SQL {list((want - got).items())[:3]}"
    return None
