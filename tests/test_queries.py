import pytest
from conftest import same_as_sql

from inkwell.plans import catalog

QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_what_sql_gives(spark, small, name):
    same_as_sql(spark, small, QUERIES[name], ORACLES[name])


def test_every_query_is_registered_once():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_gives_candidates(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.columns and df.count() > 0


def test_only_the_last_shuffle_sees_the_pool(spark, small):
    plan = QUERIES["weighted_candidates"](spark, small)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "CartesianProduct" not in plan
