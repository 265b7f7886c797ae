"""Compare registered queries with their SQL in DuckDB: columns, row count and sorted values."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.6f}"
    if isinstance(value, bool):
        return str(value).lower()
    if value is None:
        return "~null"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(norm(v) for v in value) + "]"
    if isinstance(value, dict):
        return "{" + ",".join(f"{k}:{norm(v)}" for k, v in sorted(value.items())) + "}"
    if hasattr(value, "asDict"):
        return norm(value.asDict(recursive=True))
    if type(value).__name__ == "Decimal":
        return norm(float(value))
    return str(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(norm(r[i]) for i in order) for r in rows)


def compare(df, con, sql) -> str | None:
    """None when equal, else what differs."""
    mine_cols, mine = df.columns, [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    their_cols, theirs = [d[0] for d in cur.description], cur.fetchall()
    if sorted(mine_cols) != sorted(their_cols):
        return f"columns {sorted(mine_cols)} vs {sorted(their_cols)}"
    if len(mine) != len(theirs):
        return f"rows {len(mine)} vs {len(theirs)}"
    a, b = rows_of(mine_cols, mine), rows_of(their_cols, theirs)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return f"{len(bad)}/{len(a)} rows differ, e.g. {bad[0]}"
    return None
