import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from suite.session import local_session


@pytest.fixture(scope="session")
def spark():
    return local_session("4")


@pytest.fixture
def candles(spark):
    """Builds candles of one symbol from (open_time, open, high, low, close, volume[, is_closed]) rows."""

    def build(rows, symbol="BTCUSDT"):
        ddl = "symbol string, open_time bigint, open double, high double, low double, close double, volume double"
        if rows and len(rows[0]) == 7:
            ddl += ", is_closed boolean"
        return spark.createDataFrame(
            [(symbol, r[0], *[float(x) for x in r[1:6]], *r[6:]) for r in rows], ddl
        )

    return build
