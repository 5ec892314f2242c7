"""Run a registered query and its SQL side by side."""

from __future__ import annotations

import math
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


TIMES: dict[str, float] = {}


def run_sql(statement: str, folder: str) -> tuple[list[str], list[tuple]]:
    with duckdb.connect() as connection:
        for table in TABLES:
            connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{Path(folder) / table}.parquet'")
        result = connection.execute(statement)
        return [c[0] for c in result.description], result.fetchall()


def normal(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def in_order(names: list[str], rows) -> list[tuple]:
    places = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(normal(row[i]) for i in places) for row in rows), key=repr)


def difference(spark, query, statement: str, folder: str) -> str | None:
    """None when both sides give the same columns and the same bag of rows."""
    started = time.time()
    table = query(spark, folder)
    found = in_order(table.columns, table.collect())
    TIMES[statement] = time.time() - started
    names, rows = run_sql(statement, folder)
    wanted = in_order(names, rows)
    if sorted(table.columns) != sorted(names):
        return f"columns {sorted(table.columns)} / {sorted(names)}"
    if found != wanted:
        extra = [r for r in found if r not in set(wanted)][:3]
        missing = [r for r in wanted if r not in set(found)][:3]
        return f"{len(found)} / {len(wanted)} rows; only Spark {extra}; only SQL {missing}"
    return None
