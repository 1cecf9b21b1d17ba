"""Queries of this package that have SQL, against it."""

import os

import pytest

import parity
from entitylake.llm.oracles import ORACLES
from entitylake.llm.queries import QUERIES

SF_DIR = os.environ.get("PARITY_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    found = parity.difference(QUERIES[name](spark, SF_DIR), parity.connect(SF_DIR), ORACLES[name])
    assert found is None, found
