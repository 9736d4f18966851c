import math

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowskein.llm import sketches


def rank_error(values, value, pct):
    """How far the value's ranks are from the percentile's, as a share of the count."""
    v = np.sort(values)
    target = max(1, math.ceil(round(pct * len(v) / 100, 9)))
    low, high = np.searchsorted(v, value, "left") + 1, np.searchsorted(v, value, "right")
    return max(0, low - target, target - high) / len(v)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 40) | st.integers(0, 10**9), min_size=1, max_size=300), min_size=1, max_size=9), st.sampled_from([0.01, 0.05, 0.2]))
def test_merged_summaries_keep_their_bounds(parts, error):
    level = [sketches.compress(sketches.exact_summary(np.array(p)), sketches.permitted(error, 0)) for p in parts]
    depth = 1
    while len(level) > 1:
        level = [sketches.compress(sketches.merge(level[i : i + 3]), sketches.permitted(error, depth)) for i in range(0, len(level), 3)]
        depth += 1
    everything = np.sort(np.concatenate([np.array(p) for p in parts]))
    n, reached, v, lo, hi, below = level[0]
    assert n == len(everything)
    assert (lo <= np.searchsorted(everything, v, "right")).all() and (np.searchsorted(everything, v, "right") <= hi).all()
    assert (np.searchsorted(everything, v, "left") <= below).all()
    for pct in (1, 25, 50, 90, 99, 100):
        assert rank_error(everything, sketches.percentile(level[0], pct), pct) <= error + 1e-9


def test_distributed_percentiles(spark):
    rng = np.random.default_rng(1)
    data = [("hot", float(x)) for x in rng.lognormal(5, 2, 30_000).round()] + [("few", 1.0), ("few", 9.0), ("none", None), (None, 4.0)]
    df = spark.createDataFrame(data, "tool string, value double").repartition(7)
    made = sketches.summaries(df, ["tool"], "value", 0.01)
    rows = {(r["tool"], r["pct"]): r for r in sketches.percentiles(made, ["tool"], [50.0, 99.0]).collect()}
    assert set(rows) == {(t, p) for t in ("hot", "few", None) for p in (50.0, 99.0)}
    hot = np.array([v for t, v in data if t == "hot"])
    for pct in (50.0, 99.0):
        assert rows["hot", pct]["rank_error"] <= 0.01 and rank_error(hot, rows["hot", pct]["value"], pct) <= 0.01
    assert rows["few", 50.0]["value"] == 1.0 and rows["few", 99.0]["value"] == 9.0 and rows["hot", 50.0]["n"] == 30_000
    assert max(r["k"] for r in made.select(F.size("v").alias("k")).collect()) < 1_000


def test_calls_count_once_and_limits(spark):
    calls = spark.createDataFrame(
        [(1, None, " Search ", 10, 5), (1, None, "search", 10, 5), (2, None, "SEARCH", 30, -1), (3, None, "search", None, 7), (None, None, "search", 50, 7), (None, None, "search", 50, 7), (4, None, None, 1, 1)],
        "id bigint, ts timestamp, tool string, duration_ms bigint, result_bytes bigint",
    )
    measures = sketches.tool_measures(calls)
    assert sorted(r["value"] for r in measures.filter("measure = 'duration_ms'").collect()) == [10, 30, 50]
    limits = spark.createDataFrame([("search", "duration_ms", 50, 29), ("search", "duration_ms", 50, 30), ("other", "duration_ms", 50, 0)], "tool string, measure string, pct int, limit_value bigint")
    over = sketches.over_limit(sketches.summaries(measures, ["tool", "measure"], "value"), limits)
    assert [(r["limit_value"], r["value"]) for r in over.collect()] == [(29, 30.0)]
    assert sketches.summaries(measures.limit(0), ["tool", "measure"], "value").count() == 0


def test_two_levels_of_tasks_and_of_days(spark):
    """Forty tasks' summaries are merged in two levels, ninety days' in as many as they ask for, within the error stated."""
    rng = np.random.default_rng(2)
    data = [(int(i) % 90, "hot", float(x)) for i, x in enumerate(rng.lognormal(5, 2, 60_000))]
    df = spark.createDataFrame(data, "day int, tool string, value double").repartition(40)
    values = np.array([v for _, _, v in data])
    error = 0.01
    made = sketches.summaries(df, ["tool"], "value", error)
    days = sketches.merged(sketches.summaries(df, ["day", "tool"], "value", error), ["tool"], 2 * error)
    for found, allowed in ((made, error), (days, 2 * error)):
        for row in sketches.percentiles(found, ["tool"], [1.0, 50.0, 99.0]).collect():
            assert row["rank_error"] <= allowed and row["n"] == 60_000
            assert rank_error(values, row["value"], row["pct"]) <= row["rank_error"] + 1e-9
    checked = sketches.rank_check(df, sketches.percentiles(made, ["tool"], [50.0]), ["tool"]).collect()
    assert [(r["n_exact"], r["within"]) for r in checked] == [(60_000, True)]


@settings(max_examples=20, deadline=None)
@given(st.integers(1, 600), st.integers(0, 1_000))
def test_merging_many_at_once_compresses_between(n, seed):
    rng = np.random.default_rng(seed)
    arrays = [rng.integers(0, 10**6, 50) for _ in range(n)]
    parts = [sketches.compress(sketches.exact_summary(a), 0.05) for a in arrays]
    whole = sketches._merge_all(iter(parts), 0.05, 0.1)
    everything = np.sort(np.concatenate(arrays))
    assert whole[0] == len(everything) and whole[1] <= 0.1
    for pct in (10, 50, 95):
        assert rank_error(everything, sketches.percentile(whole, pct), pct) <= 0.1 + 1e-9
