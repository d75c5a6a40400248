"""Side-by-side run of a query and its SQL: same columns, same rows in any order."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, float):
        return f"{v:.6g}" if v != int(v) or abs(v) >= 1e15 else str(int(v)) + ".0"
    return f"{type(v).__name__}:{v}"


def differences(df, sql: str, connection) -> str:
    """Empty if equal."""
    found = connection.execute(sql)
    names = [x[0] for x in found.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} against {sorted(names)}"
    ours = sorted(tuple(_cell(r[n]) for n in sorted(names)) for r in df.collect())
    order = sorted(range(len(names)), key=lambda i: names[i])
    theirs = sorted(tuple(_cell(r[i]) for i in order) for r in found.fetchall())
    if len(ours) != len(theirs):
        return f"{len(ours)} rows against {len(theirs)}"
    bad = [(a, b) for a, b in zip(ours, theirs) if a != b]
    return f"{len(bad)} of {len(ours)} rows, such as {bad[0][0]} against {bad[0][1]}"[:600] if bad else ""
