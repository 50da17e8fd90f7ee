"""Every plan query against its DuckDB oracle; those without one must give rows."""

import pytest
from conftest import same_as_sql

from tensorloom.plans import oracles, queries

ALL = queries.queries()
SQL = oracles.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_oracle(spark, data, duck, name):
    same_as_sql(ALL[name](spark, data), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(ALL) - set(SQL)))
def test_rows(spark, data, name):
    assert ALL[name](spark, data).count() > 0


def test_entry_imports(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
