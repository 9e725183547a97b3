"""Side-by-side run of a registered query and its SQL twin."""

from __future__ import annotations

import datetime as dt
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return con


def _plain(v):
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, dt.datetime):
        return v.isoformat()
    return v


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    kinds = [sorted({type(_plain(r[i])).__name__ for r in rows if r[i] is not None}) for i in order]
    body = sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)
    return [columns[i] for i in order], kinds, body


def spark_rows(df):
    return normal(df.columns, [tuple(r) for r in df.collect()])


def sql_rows(con, sql):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    return normal(names, cur.fetchall())


def difference(left, right, show=4):
    """None when equal, else a short text."""
    if left[0] != right[0]:
        return f"columns {left[0]} != {right[0]}"
    if left[1] != right[1]:
        return f"types {dict(zip(left[0], left[1]))} != {dict(zip(right[0], right[1]))}"
    if left[2] == right[2]:
        return None
    a, b = set(left[2]), set(right[2])
    return (
        f"{len(left[2])} vs {len(right[2])} rows; only spark {sorted(a - b, key=repr)[:show]}; "
        f"only sql {sorted(b - a, key=repr)[:show]}"
    )
