from datetime import datetime, timedelta

from flowskein.operators import references

T0 = datetime(2025, 4, 30, 23)


def at(hours):
    return None if hours is None else T0 + timedelta(hours=hours)


def orphans(spark, edges, nodes):
    e = spark.createDataFrame([(i, s, d, at(t), "clash") for i, s, d, t in edges], "id string, src string, dst string, indexed_at timestamp, reason string")
    n = spark.createDataFrame([(i, at(a), at(b)) for i, a, b in nodes], "id string, indexed_at timestamp, removed_at timestamp")
    return sorted((r["edge_id"], r["side"], r["reason"], r["period"]) for r in references.orphan_references(e, n).collect())


def test_reasons_sides_and_periods(spark):
    nodes = [("n", 0, 10), ("n", 5, 12), ("n", 20, None), ("late", 50, None), ("gone", 0, 3), ("empty", 4, 4), ("never", None, None), (None, 0, None)]
    edges = [("e1", "n", "n", 11), ("e2", "n", "late", 12), ("e3", "gone", "n", 2), ("e4", "gone", "n", 3), ("e5", "x", "empty", 25), ("e6", "never", "n", 25)]
    assert orphans(spark, edges, nodes) == [
        ("e2", "dst", "late", "2025-05"), ("e2", "src", "removed", "2025-05"), ("e4", "src", "removed", "2025-05"),
        ("e5", "dst", "removed", "2025-05"), ("e5", "src", "missing", "2025-05"), ("e6", "src", "removed", "2025-05"),
    ]


def test_sentinels_repeats_and_nulls(spark):
    edges = [("e", None, " ", 0), ("e", "unresolved", "unresolved:x", 0), ("r", "q", "q", 0), ("r", "q", "q", 0), ("t", "q", "n", None)]
    got = orphans(spark, edges, [("n", -1, None)])
    assert got[:4] == [("r", "dst", "missing", "2025-04")] * 2 + [("r", "src", "missing", "2025-04")] * 2
    assert [(g[1], g[2], g[3]) for g in got[4:]] == [("dst", "removed", None), ("src", "missing", None)]


def test_empty_tables(spark):
    assert orphans(spark, [], [("n", 0, None)]) == []
    assert orphans(spark, [("e", "a", "b", 0)], []) == [("e", "dst", "missing", "2025-04"), ("e", "src", "missing", "2025-04")]


def test_plain_integer_keys_become_runs(spark):
    from pyspark.sql import functions as F

    keys = spark.createDataFrame([(k,) for k in (1, 2, 3, 5, 6, 6, 9)], "k bigint").select(F.lit(0).cast("bigint").alias("__h1"), F.lit(0).cast("bigint").alias("__h2"), F.col("k").alias("start"), (F.col("k") + 1).alias("end"))
    runs = {(r["start"], r["end"]) for r in references.key_runs(keys).collect()}
    assert runs == {(1, 4), (5, 7), (9, 10)}


def test_hot_identity_over_many_spans_equals_brute_force(spark, monkeypatch):
    """Thousands of references to one node, stays of all lengths, spans of the axis far shorter than the stays."""
    import random

    r = random.Random(5)
    monkeypatch.setattr(references, "CHUNK", 3 * 3_600 * 1_000_000)
    nodes = []
    for name in ("hot", "cold", "rare"):
        for _ in range(60 if name == "hot" else 8):
            start = r.randrange(0, 900)
            nodes.append((name, start, r.choice([None] + [start + r.randrange(-1, 30)] * 9) if name != "hot" else start + r.randrange(-1, 12)))
    edges = [(f"e{i}", r.choice(["hot", "hot", "hot", "cold", "rare", "gone"]), "unresolved", r.randrange(-20, 950)) for i in range(3_000)]
    want = []
    for ident, src, _, t in edges:
        own = [(a, b) for n, a, b in nodes if n == src]
        if any(a <= t and (b is None or b > t) for a, b in own):
            continue
        reason = "missing" if not own else "late" if all(a > t for a, _ in own) else "removed"
        want.append((ident, "src", reason, at(t).strftime("%Y-%m")))
    assert orphans(spark, edges, nodes) == sorted(want)
    plan = references.load_plan
    monkeypatch.setattr(references, "load_plan", lambda df, keys, tasks=None: plan(df, keys, 400))  # every identity is hot
    assert orphans(spark, edges, nodes) == sorted(want)
    monkeypatch.setattr(references, "load_plan", lambda df, keys, tasks=None: plan(df, keys, 1, fraction=2.0))  # none is
    assert orphans(spark, edges, nodes) == sorted(want)
