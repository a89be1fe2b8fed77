"""Compares a DataFrame with the rows that DuckDB gets from the same tables."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def _plain(x):
    return round(x, 9) if isinstance(x, float) else str(x) if x is not None and not isinstance(x, (int, str, bool)) else x


def _rows(rows, names):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def compare(df, sql: str, sf_dir: str) -> str:
    """What differs; empty if nothing does."""
    got = connect(sf_dir).execute(sql)
    names = [c[0] for c in got.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    want, have = _rows(got.fetchall(), names), _rows([tuple(r) for r in df.collect()], df.columns)
    if len(want) != len(have):
        return f"{len(have)} rows, {len(want)} wanted"
    return next((f"{a} instead of {b}" for a, b in zip(have, want, strict=True) if a != b), "")
