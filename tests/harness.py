"""Runs a query and its SQL form on the same tables, and compares rows without regard to order."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pandas as pd


def connect(folder: str):
    con = duckdb.connect()
    for p in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(x):
    if x is None or x is pd.NaT:
        return None
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, bool):
        return x
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, pd.Timestamp):
        return x.to_pydatetime().replace(tzinfo=None)
    if hasattr(x, "tzinfo") and x.tzinfo is not None:
        return x.replace(tzinfo=None)
    if hasattr(x, "as_integer_ratio") and not isinstance(x, int):
        return round(float(x), 6)
    return x


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in records), key=repr)


def compare(spark, con, query, sql: str, folder: str) -> None:
    df = query(spark, folder)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    got = con.execute(sql)
    names = [c[0] for c in got.description]
    theirs = rows(names, got.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert len(mine) == len(theirs), (len(mine), len(theirs))
    for a, b in zip(mine, theirs):
        assert a == b, (a, b)
