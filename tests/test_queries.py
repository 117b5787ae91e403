"""Every registered query with an oracle equals DuckDB on the smallest tables."""

import os

import pytest

from tessera.plans import registry
from tests.oracle import connect, differences

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, con, name):
    assert differences(registry.queries()[name](spark, SF), con, registry.oracle_sql()[name]) is None
