"""Every SQL statement must end in time when it is asked for a bounded number of rows, too."""

import pathlib
import threading

import duckdb
import pytest
from oracle import TABLES

from __spark_entry__ import oracle_sql

FOLDER = pathlib.Path("/root/testdata/sf0.001")
SECONDS = 60
SQL = oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_ends_under_a_limit(name):
    with duckdb.connect() as connection:
        for table in TABLES:
            connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER / table}.parquet'")
        watch = threading.Timer(SECONDS, connection.interrupt)
        watch.start()
        try:
            rows = connection.execute(f"SELECT * FROM ({SQL[name].rstrip().rstrip(';')}) LIMIT 1000001").fetchall()
        finally:
            watch.cancel()
    assert rows
