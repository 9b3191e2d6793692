"""Compares a query with its SQL on the same Parquet files."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
from pyspark.sql import DataFrame


def views(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for p in sorted(Path(folder).glob("*.parquet")):
        where = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.sql(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{where}')")
    return con


def _plain(value: object) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 5) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(map(_plain, value))
    return value


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def difference(df: DataFrame, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """'' if both hold the same rows, else what differs first."""
    ours = rows_of(df.columns, [tuple(r) for r in df.collect()])
    result = con.sql(sql)
    theirs = rows_of(result.columns, result.fetchall())
    if sorted(df.columns) != sorted(result.columns):
        return f"columns {sorted(df.columns)} and {sorted(result.columns)}"
    if ours == theirs:
        return ""
    odd = [(a, b) for a, b in zip(ours, theirs) if a != b][:3]
    return f"{len(ours)} and {len(theirs)} rows; {odd}"
