"""Every registered query against its SQL check, in values and types."""

import pytest

import __spark_entry__ as driver
from compare import connect, duck_rows, kinds, plan, spark_rows
from holdfast.oracle.statements import statements
from holdfast.plans.catalog import QUERIES

# The corpus operators, where present, have tests of their own.
CHECKS = statements()
# Run by the tests of their own module; here they would only repeat the fits.
FITTED = {"cox_ratios", "train_gbt", "train_lr", "calibrate", "select_model", "train_run"}


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_check_has_its_query():
    assert set(CHECKS) | FITTED == set(QUERIES)
    assert set(QUERIES) <= set(driver.queries()) and set(CHECKS) <= set(driver.oracle_sql())
    assert set(driver.oracle_sql()) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_matches_sql(spark, sf, con, name):
    df = QUERIES[name](spark, sf)
    assert spark_rows(df) == duck_rows(con, CHECKS[name])
    ours, theirs = kinds(con, df, CHECKS[name])
    assert ours == theirs
    text = plan(df)
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_entry(spark):
    assert driver.entry(spark).count() == 3
