"""Every query of the library against its SQL oracle in DuckDB."""

from __future__ import annotations

import pytest

from lectern.plans import load

from .compare import connect, differences

DATA = "/root/testdata/sf0.01"
QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, DATA)
    if name in ORACLES:
        assert differences(df, con, ORACLES[name]) == ""
    else:
        assert df.count() > 0
