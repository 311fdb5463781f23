"""Every registered query against its SQL twin, over the whole small tables."""

import pytest
from parity import compare, duck

from callscope.plans import oracles, queries

QUERIES, ORACLES = queries(), oracles()


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equal_to_sql(spark, con, sf_dir, name):
    assert compare(spark, con, sf_dir, name, QUERIES[name], ORACLES[name]) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
