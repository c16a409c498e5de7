"""Compares a query with its SQL on the same tables, order aside."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    return v


def order(row: tuple) -> tuple:
    return tuple((v is not None, "" if isinstance(v, (int, float)) else str(type(v)), v if v is not None else 0) for v in row)


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    at = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in at) for r in rows), key=order)


def duck(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(sql)
    columns = [d[0] for d in found.description]
    return columns, found.fetchall()


def check(query, sql: str, spark, sf_dir: str) -> None:
    df = query(spark, sf_dir)
    columns, expected = duck(sf_dir, sql)
    assert sorted(columns) == sorted(df.columns)
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(columns, expected)
