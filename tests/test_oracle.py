"""Every registered query against its SQL twin."""

import pytest
from compare import assert_same, oracle_connection

import __spark_entry__ as driver
from clickloom.plans.oracle import ORACLE
from clickloom.plans.registered import QUERIES

SF_DIR = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF_DIR)


def test_every_query_has_a_twin():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(driver.queries()) and set(driver.oracle_sql()) <= set(driver.queries())


def test_entry_runs(spark):
    assert driver.entry(spark).count() == 1


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows(spark, con, name):
    assert_same(QUERIES[name](spark, SF_DIR), con, ORACLE[name])


# Golden numbers of the 30-day and 24-hour windows, computed apart from this code.
def test_golden_overview(spark):
    row = driver.queries()["overview_30d"](spark, SF_DIR).first()
    assert (row.total_events, row.views, row.clicks, row.carts, row.purchases) == (10000, 1982, 2006, 0, 1981)
    assert (row.unique_users, row.total_revenue) == (150, 95455.77)
    row = driver.queries()["overview_24h"](spark, SF_DIR).first()
    assert (row.total_events, row.purchases, row.unique_users, row.total_revenue) == (329, 61, 133, 2625.93)
