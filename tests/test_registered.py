import os

import pytest

import __spark_entry__ as driver
import oracle
from jsonloom.plans import queries as registry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def db():
    return oracle.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(spark, db, name):
    sql = driver.oracle_sql()[name]
    ok, message = oracle.compare(spark, db, SF_DIR, driver.queries()[name], sql)
    assert ok, message


def test_entry(spark):
    assert driver.entry(spark).columns == ["line_number", "k"]
