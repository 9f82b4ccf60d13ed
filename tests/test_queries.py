"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as driver
from tests.compare import TESTDATA, duck, duck_rows, spark_rows
from vaultferry.plans.oracles import oracle_statements
from vaultferry.plans.registry import QUERIES

SF_DIR = str(TESTDATA / "sf0.001")
pytestmark = pytest.mark.skipif(not TESTDATA.exists(), reason="needs the test tables")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_every_query_has_sql():
    assert set(QUERIES) == set(oracle_statements())
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_entry(spark):
    assert driver.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = spark_rows(driver.queries()[name](spark, SF_DIR))
    want = duck_rows(con, driver.oracle_sql()[name])
    assert got == want
