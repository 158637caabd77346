"""Compare a Spark query with its DuckDB oracle: columns by name, rows as a multiset."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.9g}")
    if hasattr(x, "asDict"):
        return tuple(plain(v) for v in x.asDict().values())
    if isinstance(x, dict):
        return tuple(plain(v) for v in x.values())
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if isinstance(x, (bytes, bytearray)):
        return bytes(x)
    return int(x) if isinstance(x, bool) else x if isinstance(x, (int, str, type(None))) else str(x)


def rows(columns: list[str], data) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in data)


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if equal, else what differs first."""
    got = con.execute(sql)
    names, want = rows([d[0] for d in got.description], got.fetchall())
    mine, have = rows(df.columns, df.collect())
    if names != mine:
        return f"columns {mine} want {names}"
    if want != have:
        return f"rows {sum(have.values())} want {sum(want.values())}; extra {list((have - want).items())[:2]} missing {list((want - have).items())[:2]}"
    return "" if have else "no rows"
