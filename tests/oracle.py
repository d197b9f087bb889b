"""Runs a query and its SQL, and compares rows as sorted text."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def _cell(v: object) -> str:
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(int(v)) if hasattr(v, "is_integer") else str(v)


def rows(frame: pd.DataFrame) -> list[tuple[str, ...]]:
    cols = sorted(frame.columns)
    return sorted(zip(*([_cell(v) for v in frame[c]] for c in cols), strict=True))
