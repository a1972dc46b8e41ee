"""Every registered query against its oracle on the smallest tables."""

import os

import pytest

import __spark_entry__ as driver
from compare import differences, oracle_connection

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not present")


@pytest.fixture(scope="module")
def con():
    return oracle_connection(SF)


@pytest.mark.parametrize("name", sorted(driver.oracle_sql()))
def test_query_equals_oracle(spark, con, name):
    assert differences(spark, con, driver.queries()[name], driver.oracle_sql()[name], SF) is None


def test_registry_is_consistent():
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert set(driver.QUERIES) <= set(driver.oracle_sql())


def test_entry_runs(spark):
    assert driver.entry(spark).take(1)
