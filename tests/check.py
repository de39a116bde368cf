"""Compare a query with its SQL on the same tables: same columns, same rows, same values."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(v):
    if v is None:
        return "null"
    if isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, float):
        return repr(v + 0.0)
    return str(v)


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_plain(r[i]) for i in order) for r in rows)


def differences(df, con, sql: str, show: int = 3) -> list[str]:
    ours = df.collect()
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    if sorted(df.columns) != sorted(names):
        return [f"columns {sorted(df.columns)} and {sorted(names)}"]
    a, b = _rows(df.columns, ours), _rows(names, theirs)
    if a == b:
        return []
    only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
    return [f"{len(a)} and {len(b)} rows, {len(only_a)} and {len(only_b)} differ", f"{only_a[:show]}", f"{only_b[:show]}"]
