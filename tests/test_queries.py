"""Every registered query against its oracle."""

import os

import pytest

from workload import ORACLES, QUERIES
from workload.compare import compare, oracle

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return oracle(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_oracle(spark, con, name):
    _, n, problem = compare(spark, SF_DIR, name, QUERIES[name], ORACLES.get(name), con)
    assert problem is None
    assert n > 0


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
