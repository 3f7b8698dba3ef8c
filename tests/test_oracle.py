"""Every query with an SQL equivalent gives the same rows as DuckDB."""

import pytest
from compare import difference

import __spark_entry__ as entry


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, con, folder, name):
    assert difference(spark, con, name, folder) is None


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    row = entry.entry(spark).collect()[0]
    assert row["n_total"] == row["skip_count"] + row["pending_count"] > 0
