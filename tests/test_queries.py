"""Every registered query beside its SQL."""

import pytest
from ostra.plans import catalog

import compare
from compare import SMALL



@pytest.fixture(scope="module")
def con():
    return compare.connect(SMALL)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows_as_sql(spark, con, name):
    assert not compare.differences(catalog.QUERIES[name](spark, SMALL), con, catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs_without_sql(spark, name):
    assert catalog.QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__

    df = __spark_entry__.entry(spark)
    assert df.columns == ["rank", "doc_id", "score"] and df.count() == 10
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_positions_are_not_read_for_plain_terms(spark):
    df = catalog.QUERIES["boolean_nested"](spark, SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "positions" not in plan and "PushedFilters: [In(token" in plan
