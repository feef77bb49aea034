"""Runs registered queries beside their SQL, as sets of rows with rounded numbers."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def cell(v):
    if isinstance(v, bool) or v is None:
        return v
    if hasattr(v, "as_tuple"):
        v = float(v)
    if isinstance(v, float):
        v = round(v, 5) + 0.0
        return int(v) if v == int(v) else v
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(cell(r[i]) for i in order) for r in data), key=repr)


def compare(spark, con, sf, query, sql):
    """None, or what differs."""
    df = query(spark, sf)
    got = rows(df.columns, df.collect())
    cur = con.execute(sql)
    want = rows([d[0] for d in cur.description], cur.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if len(got[1]) != len(want[1]):
        return f"{len(got[1])} and {len(want[1])} rows"
    return next((f"{g} and {w}" for g, w in zip(got[1], want[1], strict=True) if g != w), None)
