"""Every registered query against its SQL, over the whole smallest tables; the others must return rows."""

import pytest
from oracle import difference

from __spark_entry__ import entry, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"
QUERIES, SQL = queries(), oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    assert difference(spark, QUERIES[name], SQL[name], FOLDER) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_returns_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).limit(1).count() == 1


def test_entry(spark):
    table = entry(spark)
    assert table.columns == ["event_id", "Ranking_count"]
    assert table.count() == 1000
