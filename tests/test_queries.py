import os

import pytest

import __spark_entry__
from flowskein.plans import analysis, dealt, graph, inventory, links
from tests.oracle import DATA, connect, rows_of_both

QUERIES = {n: q for m in (dealt, graph, analysis, inventory, links) for n, q in m.QUERIES.items()}
ORACLES = {n: s for m in (dealt, graph, analysis, inventory, links) for n, s in m.ORACLES.items()}


@pytest.fixture(scope="module")
def con():
    return connect()


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no data")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_oracle(spark, con, name):
    if name not in ORACLES:
        assert QUERIES[name](spark, DATA).columns
        return
    mine, want = rows_of_both(spark, con, QUERIES[name], ORACLES[name])
    assert mine == want


def test_entry_lists_everything():
    assert set(QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no data")
def test_flagship(spark):
    assert __spark_entry__.entry(spark).count() > 0
