"""Every registered query against its DuckDB statement."""

import os

import pytest
from oracle import compare, connect

from leadlake.catalog import ORACLES, QUERIES

DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")
LARGER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return connect(DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    if name not in ORACLES:
        assert QUERIES[name](spark, DIR).count() > 0
        return
    found = compare(spark, con, QUERIES[name], ORACLES[name], DIR)
    if found == "both empty":  # the smallest tables hold no such row
        found = compare(spark, connect(LARGER), QUERIES[name], ORACLES[name], LARGER)
    assert found is None


def test_bounds_of_jitter(spark):
    low, high = QUERIES["send_jitter"](spark, DIR).selectExpr("min(delay_seconds)", "max(delay_seconds)").first()
    assert 60 <= low <= high <= 600
