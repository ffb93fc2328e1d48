import pytest
from oracle import compare, connect

from replimerge.plans import stream_queries  # noqa: F401
from replimerge.plans.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, con):
    df = QUERIES[name](spark, sf)
    if name in ORACLES:
        compare(con, df, ORACLES[name])
    else:
        assert df.count() > 0
