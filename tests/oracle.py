"""Compares a query with its SQL twin on DuckDB."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def cell(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, (float, decimal.Decimal)):
        return round(float(x), 5) + 0.0
    if isinstance(x, int):
        return x
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(cell(v) for v in x)
    return str(x)


def compare(spark, con, sf_dir: str, query, text: str) -> str | None:
    """What differs, None if nothing."""
    got = query(spark, sf_dir)
    columns = sorted(got.columns)
    mine = Counter(tuple(cell(v) for v in r) for r in got.select(*[f"`{c}`" for c in columns]).collect())
    cursor = con.execute(text)
    theirs_columns = [c[0] for c in cursor.description]
    if sorted(theirs_columns) != columns:
        return f"columns {columns} against {sorted(theirs_columns)}"
    order = [theirs_columns.index(c) for c in columns]
    rows = cursor.fetchall()
    theirs = Counter(tuple(cell(r[k]) for k in order) for r in rows)
    kinds = {type(v).__name__ for r in list(theirs)[:50] for v in r}
    if mine != theirs:
        return f"{sum(mine.values())} rows against {sum(theirs.values())}; only here {list((mine - theirs).items())[:2]}, only there {list((theirs - mine).items())[:2]} ({columns}, {kinds})"
    return None if mine else "no rows"
