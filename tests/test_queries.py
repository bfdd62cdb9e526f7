"""Every registered query against its SQL on the smallest test tables."""

import compare
import pytest
from shared import SF

from spendlens.plans import oracle, queries

STATEMENTS = oracle.statements()


@pytest.fixture(scope="module")
def con():
    return compare.database(SF)


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(STATEMENTS)


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query_equals_sql(spark, con, name):
    assert compare.differences(queries.run(name, spark, SF), con, STATEMENTS[name]) == []


def test_entry_module(spark):
    import __spark_entry__ as entry_module

    assert set(queries.QUERIES) <= set(entry_module.queries())
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    result = entry_module.entry(spark)
    assert result.columns[:3] == ["usage_date", "service_type", "daily_unique_users"]
    assert result.count() > 0
