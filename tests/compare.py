"""Run a query and its DuckDB counterpart on the same tables and compare the rows."""

from __future__ import annotations

import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return round(x, 6) + 0.0
    if x is None or isinstance(x, str | int):
        return x
    if isinstance(x, list | tuple):
        return tuple(map(plain, x))
    try:
        return plain(float(x))
    except (TypeError, ValueError):
        return str(x)


def oracle(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for t in TABLES:
        if os.path.exists(p := f"{sf_dir}/{t}.parquet"):
            db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return db


def difference(df, sql: str, db) -> str:
    """Empty where both sides agree; else what differs."""
    names = sorted(df.columns)
    own = Counter(tuple(plain(r[n]) for n in names) for r in df.collect())
    rel = db.sql(sql)
    if sorted(rel.columns) != names:
        return f"columns {names} and {sorted(rel.columns)}"
    at = [rel.columns.index(n) for n in names]
    other = Counter(tuple(plain(r[k]) for k in at) for r in rel.fetchall())
    if own == other:
        return ""
    return f"{sum(own.values())} and {sum(other.values())} rows; only here {list((own - other).items())[:3]}; only there {list((other - own).items())[:3]}"
