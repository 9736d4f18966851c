"""Queries of HTTP calls bring only the sightings of these together, not those of all edges."""

import os
from datetime import datetime

import pytest

import __spark_entry__
from flowskein import session
from flowskein.operators import graph_store

SF = "/root/testdata/sf0.001"
EDGES = "id string, src string, dst string, type string, label string, confidence string, http_method string, http_path string, sources array<string>, verification_state string, verified_granularity string, indexed_at timestamp"


def test_current_edges_that_pass(spark):
    row = lambda i, kind, day, path="/a": (i, "s", "d", kind, "get /a", None, None, path, None, None, None, datetime(2026, 1, day))
    rows = [row("now", "calls", 1), row("now", "http_call", 2), row("once", "http_call", 1), row("once", "calls", 2), row("lost", "http_call", 1), row("lost", "http_call", 2, None)]
    rows += [row("both", "http_call", 1), row("both", "http_call", 1), row(None, "http_call", 1), row("never", "calls", 1), row("untyped", None, 1)]
    edges = spark.createDataFrame(rows, EDGES)
    kept = "type = 'http_call' AND http_path <> ''"
    got = graph_store.current_edges_where(edges, kept)
    assert sorted(map(str, got.collect())) == sorted(map(str, graph_store.current_edges(edges).filter(kept).collect()))
    assert {r["id"] for r in got.collect()} == {"now", "both"}
    assert graph_store.current_edges_where(edges, "type = 'none'").count() == 0


@pytest.mark.parametrize("name", ["contract_unknown_edges", "contract_targets", "contract_unmatched", "contract_other_services"])
def test_no_other_edges_are_stored(spark, tmp_path, name):
    for t in ("nodes", "shared_nodes", "edges"):
        os.symlink(f"{SF}/{t}.parquet", tmp_path / f"{t}.parquet")
    query = __spark_entry__.queries()[name]
    assert sorted(query(spark, str(tmp_path)).collect()) == sorted(query(spark, SF).collect())
    assert [key[1] for key in session._STORED if key[1] == "current-edges" and str(tmp_path) in key[2]] == []
