"""Runs a query and its SQL twin side by side and tells where they differ."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}{'/*.parquet' if p.is_dir() else ''}')")
    return con


def _plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.6g}"
    if hasattr(x, "is_integer") or isinstance(x, int):
        return f"{float(x):.6g}" if not isinstance(x, bool) and abs(x) < 1e15 else str(x)
    return str(x)


def difference(df, con, sql: str) -> str:
    """Empty if both return the same columns and rows, in any order."""
    names = sorted(df.columns)
    got = sorted(tuple(_plain(r[n]) for n in names) for r in df.collect())
    cur = con.execute(sql)
    theirs = [d[0] for d in cur.description]
    if sorted(theirs) != names:
        return f"columns {names} and {sorted(theirs)}"
    at = [theirs.index(n) for n in names]
    want = sorted(tuple(_plain(float(r[k]) if type(r[k]).__name__ == "Decimal" else r[k]) for k in at) for r in cur.fetchall())
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}"
    wrong = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    return f"{len(wrong)} rows differ: {wrong[:2]}" if wrong else ""
