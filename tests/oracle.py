"""Compares a query with its SQL over the same Parquet tables."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(folder: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def _plain(v):
    if isinstance(v, float):
        return str(v) if math.isnan(v) or math.isinf(v) else float(f"{v:.6g}")
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return _plain(float(v)) if type(v).__name__ == "Decimal" else v


def compare(frame, sql: str, con) -> None:
    columns = sorted(frame.columns)
    ours = sorted((tuple(map(_plain, r)) for r in frame.select(*columns).collect()), key=repr)
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    theirs = sorted((tuple(_plain(r[i]) for i in at) for r in got.fetchall()), key=repr)
    assert ours == theirs
