"""Runs a query and its SQL over the same tables and compares names and values, whatever the order."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(p := f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}'")
    return con


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    if isinstance(v, float):
        return f"{v:.6f}"
    return str(v)


def differences(df, con, sql: str, limit: int = 3) -> list[str]:
    names = sorted(df.columns)
    mine = sorted(tuple(_plain(r[n]) for n in names) for r in df.collect())
    out = con.execute(sql)
    cols = [c[0] for c in out.description]
    if sorted(cols) != names:
        return [f"columns {names} and {sorted(cols)}"]
    at = [cols.index(n) for n in names]
    theirs = sorted(tuple(_plain(r[i]) for i in at) for r in out.fetchall())
    if mine == theirs:
        return []
    a, b = set(mine), set(theirs)
    return [f"rows {len(mine)} and {len(theirs)}", *[f"mine   {str(x)[:300]}" for x in sorted(a - b)[:limit]], *[f"theirs {str(x)[:300]}" for x in sorted(b - a)[:limit]]]
