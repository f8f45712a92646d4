"""Compares a query's rows with those of its SQL, as a bag, with columns by name."""

from __future__ import annotations

import glob
import os

import duckdb


def duck(sf_dir: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"create view {os.path.basename(path)[:-8]} as select * from read_parquet('{path}')")
    return con


def plain(x):
    if isinstance(x, float):
        return round(x, 6)
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


def bag(columns: list[str], rows) -> tuple[list[str], list[str]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr([plain(r[i]) for i in order]) for r in rows)


def of_spark(df):
    return bag(df.columns, df.collect())


def of_sql(con, sql: str):
    found = con.execute(sql)
    return bag([d[0] for d in found.description], found.fetchall())
