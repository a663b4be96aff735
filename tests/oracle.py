"""Compares a Spark result with DuckDB's over the same tables."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(frame):
    shown = lambda v: "null" if v is None or v != v else repr(round(v, 6)) if isinstance(v, float) else str(v)
    frame = frame[sorted(frame.columns)].astype(object)
    frame = frame.where(frame.notna(), None)
    return sorted(tuple(shown(int(v) if isinstance(v, float) and v == int(v) else v) for v in r) for r in frame.itertuples(index=False))


def duck(sql: str, sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con.execute(sql).df()
