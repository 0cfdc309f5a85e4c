"""Registered queries held against their SQL in DuckDB."""

from __future__ import annotations

import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(v) -> str:
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.6g}"
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(shown, v)) + "]"
    return str(v)


def rows_of(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(shown(r[i]) for i in order) for r in rows)


def same(spark, query, sql: str, data: str) -> None:
    with duckdb.connect() as con:
        for t in TABLES:
            con.sql(f"create view {t} as select * from '{data}/{t}.parquet'")
        want = con.sql(sql)
        got = query(spark, data)
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.fetchall())
