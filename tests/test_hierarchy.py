import random

import numpy as np
import pytest

from flowskein.operators import hierarchy


def brute(pairs):
    parent = {(t, c): p for t, p, c in pairs}
    nodes = {(t, x) for t, p, c in pairs for x in (p, c)}
    out = {}
    for t, node in nodes:
        at, depth, seen = node, 0, set()
        while (t, at) in parent and at not in seen:
            seen.add(at)
            at, depth = parent[t, at], depth + 1
        out[t, node] = ("", -1) if at in seen else (at, depth)
    return out


def forest(n, seed, chain=0.5):
    r = random.Random(seed)
    pairs = [("a", f"n{i - 1}" if r.random() < chain else f"n{r.randrange(i)}", f"n{i}") for i in range(1, n) if r.random() < 0.97]
    pairs += [("b", p, c) for _, p, c in pairs[: n // 3]]
    pairs += [("a", "s", "s"), ("a", "s", "below"), ("a", "x", "y"), ("a", "y", "z"), ("a", "z", "x"), ("a", "z", "hang"), ("a", "hang", "lower")]
    return pairs


@pytest.mark.parametrize("core", [0, 20, 100_000])
def test_equals_brute_force(spark, core):
    pairs = forest(150, core) + forest(150, core)[:5]
    df = spark.createDataFrame([(*p, 1) for p in pairs], "type string, parent string, child string, depth int")
    got = {(r["type"], r["node_id"]): (r["root_id"], r["depth"]) for r in hierarchy.hierarchy(df, core).collect()}
    assert got == brute(pairs)


def test_long_chain_and_paths(spark):
    pairs = [("a", f"n{i}", f"n{i + 1}") for i in range(120)] + [("a", "l", "l"), ("a", "l", "m")]
    df = spark.createDataFrame(pairs, "type string, parent string, child string")
    paths = hierarchy.hierarchy_paths(df, 10)
    by = {r["node_id"]: r for r in paths.collect()}
    assert by["n120"]["path"] == [f"n{i}" for i in range(121)] and by["n0"]["path"] == ["n0"]
    assert by["m"]["path"] is None and by["m"]["depth"] == -1
    below = hierarchy.descendants(paths).filter("node_id = 'n100'").collect()
    assert {(r["descendant_id"], r["distance"]) for r in below} == {(f"n{100 + i}", i) for i in range(1, 21)}


def test_nulls_and_empty(spark):
    schema = "type string, parent string, child string"
    df = spark.createDataFrame([("a", None, "c"), ("a", "p", None), (None, "x", "y"), ("a", "", "e")], schema)
    got = {(r["node_id"], r["root_id"], r["depth"]) for r in hierarchy.hierarchy(df).collect()}
    assert got == {("c", "c", 0), ("p", "p", 0), ("", "", 0), ("e", "", 1)}
    assert hierarchy.hierarchy(spark.createDataFrame([], schema)).count() == 0


def test_contraction_in_memory():
    rng = np.random.default_rng(3)
    n = 5_000
    parent = np.array([rng.integers(0, i) if rng.random() < 0.3 else i - 1 for i in range(1, n)])
    root, depth = hierarchy.contract_core(np.arange(1, n), parent, np.ones(n - 1, dtype=np.int64), n)
    want = np.zeros(n, dtype=int)
    for i in range(1, n):
        want[i] = want[parent[i - 1]] + 1
    assert (root == 0).all() and (depth == want).all()


def test_hub_parents_in_the_play_back(spark, monkeypatch):
    """A parent with most of the children, split by load on the way back; the same answer as without."""
    monkeypatch.setattr(hierarchy, "HUB_ROWS", 10)
    pairs = [("a", "hub", f"n{i}") for i in range(400)] + [("a", f"n{i}", f"m{i}") for i in range(0, 400, 7)] + [("a", "top", "hub"), ("a", "s", "s"), ("a", "s", "t")]
    df = spark.createDataFrame(pairs, "type string, parent string, child string")
    got = {(r["type"], r["node_id"]): (r["root_id"], r["depth"]) for r in hierarchy.hierarchy(df, 5).collect()}
    assert got == brute(pairs)
    deep = {r["node_id"]: r["path"] for r in hierarchy.hierarchy_paths(df, 5).collect()}
    assert deep["m7"] == ["top", "hub", "n7", "m7"] and deep["t"] is None


def test_several_parents_are_reported(spark):
    df = spark.createDataFrame([("a", "p", "c"), ("a", "q", "c"), ("a", "p", "c"), ("b", "p", "c"), ("a", None, "c"), ("a", "p", "d")], "type string, parent string, child string")
    (row,) = hierarchy.several_parents(df).collect()
    assert (row["type"], row["node_id"], row["n_parents"]) == ("a", "c", 2)
    assert {(r["node_id"], r["root_id"]) for r in hierarchy.hierarchy(df).collect() if r["type"] == "a"} >= {("c", row["kept_parent"])}
