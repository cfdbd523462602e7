"""Holds a query's rows against its SQL twin in DuckDB."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        db.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return db


def _key(row: tuple) -> tuple:
    return tuple("" if v is None else f"{v:.6f}" if isinstance(v, float) else str(v) for v in row)


def same(spark_rows: list, columns: list[str], sql: str, db: duckdb.DuckDBPyConnection) -> str:
    """Empty if both agree, else what differs."""
    cur = db.execute(sql)
    theirs = [d[0] for d in cur.description]
    if sorted(columns) != sorted(theirs):
        return f"columns {sorted(columns)} and {sorted(theirs)}"
    order = sorted(columns)
    mine = sorted((tuple(r[c] for c in order) for r in spark_rows), key=_key)
    other = sorted((tuple(r[theirs.index(c)] for c in order) for r in cur.fetchall()), key=_key)
    if len(mine) != len(other):
        return f"{len(mine)} and {len(other)} rows"
    bad = [(a, b) for a, b in zip(mine, other, strict=True) if not all(x == y or (isinstance(x, float) and isinstance(y, float) and (math.isclose(x, y, abs_tol=2e-6) or x != x and y != y)) for x, y in zip(a, b, strict=True))]
    exact = sum(a != b for a, b in zip(mine, other, strict=True))
    return f"{len(bad)} rows differ, such as {bad[0]}" if bad else f"rounding of {exact} rows" if exact else ""
