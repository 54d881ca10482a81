"""Spark results against DuckDB's, order aside."""

from __future__ import annotations

import math

import duckdb

from quillmill.sources.tables import TABLES


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in data)


def same(df, con, sql: str) -> None:
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    con.execute(sql)
    names = [d[0] for d in con.description]
    want = rows(names, con.fetchall())
    assert sorted(df.columns) == sorted(names)
    assert len(got) == len(want)
    assert got == want
