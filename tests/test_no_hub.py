"""Queries that start from the hub, on a graph that has none."""

import pytest

from flowskein.plans import graph, inventory


@pytest.fixture(scope="module")
def hubless(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("hubless")
    node = "id string, type string, label string, service string, file string, line int, end_line int, lang string, meta map<string,string>, indexed_at timestamp"
    edge = "id string, src string, dst string, type string, label string, confidence string, http_method string, http_path string, sources array<struct<provider:string>>, verification_state string, verified_granularity string, indexed_at timestamp"
    nodes = spark.createDataFrame([(i, "function", i, "s", "a.go", 1, 2, "go", {}, None) for i in "abc"], node)
    edges = spark.createDataFrame([(f"calls:{a}->{b}", a, b, "calls", "", "static", "", "", [], "verified", "", None) for a, b in ("ab", "bc")], edge)
    assert graph.HUB not in "abc"
    for name, rows in (("nodes", nodes), ("shared_nodes", nodes.limit(0)), ("edges", edges)):
        rows.write.parquet(f"{root}/{name}.parquet")
    return str(root)


def test_waypoint_route_is_empty(spark, hubless):
    assert inventory.waypoint_route(spark, hubless).collect() == []


def test_flows_through_node_is_empty(spark, hubless):
    assert inventory.flows_through_node(spark, hubless).collect() == []
