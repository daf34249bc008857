"""Every registered query of the library: equal to its SQL where there is one, else it runs and has rows."""

from __future__ import annotations

import pytest
from oracle import connect, spark_rows, sql_rows

from martlens.plans.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, sf, con, name):
    assert spark_rows(QUERIES[name](spark, sf)) == sql_rows(con, ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs_without_sql(spark, sf, name):
    columns, rows = spark_rows(QUERIES[name](spark, sf))
    assert columns and rows


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
