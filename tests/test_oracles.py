"""Every registered query on the smallest tables, against its SQL oracle where it has one."""

import pytest
from oracle import compare, connect

from threadloom.plans import load_all

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = load_all()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query(spark, con, key):
    _, problem = compare(spark, con, SF, QUERIES[key], ORACLES.get(key))
    assert problem is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
