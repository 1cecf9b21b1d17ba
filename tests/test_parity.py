"""Every registered query against its SQL."""

import os

import pytest

import __spark_entry__ as driver
import parity
from entitylake.plans.oracles import ORACLES
from entitylake.plans.queries import QUERIES

SF_DIR = os.environ.get("PARITY_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def connection():
    return parity.connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, connection, name):
    found = parity.difference(QUERIES[name](spark, SF_DIR), connection, ORACLES[name])
    assert found is None, found


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(driver.queries()) and set(ORACLES) <= set(driver.oracle_sql())


def test_entry_is_wide(spark):
    df = driver.entry(spark)
    assert "custom_Status_10" in df.columns and not df.isEmpty()
