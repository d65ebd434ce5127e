"""Every registered query against its SQL twin on the smallest tables."""

import pytest

from fringeframe.plans.all import ORACLES, QUERIES
from tests.oracle import DATA, differences, duck


@pytest.fixture(scope="module")
def con():
    return duck(DATA / "sf0.001")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, str(DATA / "sf0.001"))
    if name in ORACLES:
        assert differences(df, con, ORACLES[name]) == []
    else:
        assert df.count() > 0
