"""Every registered query against its SQL at the smallest scale."""

import os

import pytest

from __spark_entry__ import entry
from suite.base import ORACLES, QUERIES
from suite.compare import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, SF, QUERIES[name], ORACLES[name]) == ""


def test_entry(spark):
    out = entry(spark)
    assert out.columns[-1] == "sma20" and out.count() > 0
