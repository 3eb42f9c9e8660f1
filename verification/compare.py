"""Run a query on both engines and compare the values."""

from __future__ import annotations

import datetime
from typing import Any

import duckdb
from pyspark.sql import DataFrame

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def _plain(value: Any) -> tuple:
    """A sortable form in which both engines' types agree; numbers stay exact."""
    if value is None:
        return ("",)
    if isinstance(value, bool):
        return ("b", value)
    if isinstance(value, (int, float)):
        return ("n", float(value) + 0.0)
    if isinstance(value, datetime.datetime):
        return ("t", value.replace(tzinfo=None).isoformat())
    return ("s", str(value))


def _rows(table) -> list[tuple]:
    return sorted(tuple(map(_plain, row)) for row in zip(*[c.to_pylist() for c in table.columns]))


def difference(df: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if both results have the same columns and rows in any order."""
    columns = sorted(df.columns)
    ours = df.select(*[f"`{c}`" for c in columns]).toArrow()
    theirs = connection.sql(sql).to_arrow_table()
    if sorted(theirs.column_names) != columns:
        return f"columns differ: {set(columns) ^ set(theirs.column_names)}"
    a, b = _rows(ours), _rows(theirs.select(columns))
    if a == b:
        return ""
    only_a, only_b = [r for r in a if r not in set(b)][:2], [r for r in b if r not in set(a)][:2]
    return f"{len(a)} and {len(b)} rows; {columns}: only Spark {only_a}, only SQL {only_b}"
