import os

import pytest

from flowskein.llm import queries
from tests.oracle import DATA, connect, rows_of_both


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no data")
@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_equals_oracle(spark, con, name):
    if name not in queries.ORACLES:
        assert queries.QUERIES[name](spark, DATA).count() > 0
        return
    mine, want = rows_of_both(spark, con, queries.QUERIES[name], queries.ORACLES[name])
    assert mine == want
