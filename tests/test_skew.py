import random
from collections import defaultdict

from flowskein.operators import skew


def rows(n=20_000, seed=1):
    r = random.Random(seed)
    return [(("hot" if r.random() < 0.4 else f"k{r.randrange(500)}"), "t", f"i{r.randrange(4000)}") for _ in range(n)]


def test_counts_equal_brute_force_with_hot_and_null_keys(spark):
    data = [*rows(), (None, "t", "x"), (None, "t", "x"), ("a", None, "y"), (None, None, None)]
    want, items = defaultdict(int), defaultdict(set)
    for s, t, i in data:
        want[s, t] += 1
        items[s, t] |= {i} - {None}
    df = spark.createDataFrame(data, "src string, type string, id string")
    got = {(r["src"], r["type"]): (r["n_items"], r["n_rows"]) for r in skew.balanced_distinct(df, ["src", "type"], "id").collect()}
    assert got == {k: (len(items[k]), n) for k, n in want.items()}


def test_plan_spreads_the_hot_key(spark):
    df = spark.createDataFrame(rows(), "src string, type string, id string")
    plan = skew.load_plan(df, ["src"], tasks=8)
    assert len(plan.heavy) == 1 and len(plan.heavy[0][3]) >= 4
    share = plan.total / plan.tasks
    assert max(plan.bin_load) < 1.5 * share and plan.total == 20_000
    placed = plan.bins(df).withColumn("b", skew.F.element_at("__bins", (skew.F.pmod(skew.F.xxhash64("id"), skew.F.size("__bins")) + 1).cast("int")))
    assert max(r["count"] for r in placed.groupBy("b").count().collect()) < 2 * share


def test_replicated_join_keeps_every_row_once(spark):
    left = spark.createDataFrame([*rows(5_000), (None, "t", "n")], "src string, type string, id string")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("k1", 3), (None, 4)], "src string, v int")
    want = left.join(right, "src", "left").groupBy("src", "v").count()
    got = skew.fragment_replicate_join(left, right, ["src"], spread="id").groupBy("src", "v").count()
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert skew.fragment_replicate_join(left, right, ["src"], spread="id", how="inner").count() == left.join(right, "src").count()


def test_empty_input(spark):
    df = spark.createDataFrame([], "src string, type string, id string")
    assert skew.balanced_distinct(df, ["src", "type"], "id").count() == 0


def test_an_item_repeated_very_often_is_spread_and_counted_once(spark):
    data = [*rows(6_000), *[("hot", "t", "same")] * 5_000, *[("hot", "t", None)] * 3_000]
    want, items = defaultdict(int), defaultdict(set)
    for s, t, i in data:
        want[s, t] += 1
        items[s, t] |= {i} - {None}
    df = spark.createDataFrame(data, "src string, type string, id string").repartition(12)
    plan = skew.load_plan(df, ["src", "type"], tasks=6)
    hashes = [skew.key_hash(["src", "type"], i).alias(f"__h{i}") for i in (1, 2)]
    ids = [skew.F.xxhash64(skew.F.lit(i), skew.F.col("id")).alias(f"__i{i - 2}") for i in (3, 4)]
    often = skew.heavy_items(df.select("src", "type", *hashes, *ids), plan, ["__h1", "__h2"], ["__i1", "__i2"])
    assert often.count() == 2  # the item and the null
    got = {(r["src"], r["type"]): (r["n_items"], r["n_rows"]) for r in skew.balanced_distinct(df, ["src", "type"], "id", plan).collect()}
    assert got == {k: (len(items[k]), n) for k, n in want.items()}


def test_join_lies_where_the_plan_put_it(spark):
    """Both sides meet in the planned task, and no task has much more than its share."""
    left = spark.createDataFrame(rows(20_000), "src string, type string, id string")
    right = spark.createDataFrame([("hot", 1), *((f"k{i}", i) for i in range(500))], "src string, v int")
    plan = skew.load_plan(left.select("src"), ["src"], tasks=8)
    joined = skew.fragment_replicate_join(left, right, ["src"], spread="id", plan=plan)
    loads = {r["p"]: r["count"] for r in joined.groupBy(skew.F.spark_partition_id().alias("p")).count().collect()}
    assert joined.count() == left.join(right, "src", "left").count()
    assert len(loads) >= 2
    text = joined._jdf.queryExecution().executedPlan().toString()
    assert text.count("shufflepartitionidpassthrough") == 2 and text.count("hashpartitioning") == 0


def test_empty_sides_of_a_join(spark):
    left = spark.createDataFrame([], "src string, id string")
    right = spark.createDataFrame([("a", 1)], "src string, v int")
    assert skew.fragment_replicate_join(left, right, ["src"], spread="id").count() == 0
    assert skew.fragment_replicate_join(right.selectExpr("src", "'x' AS id"), left.selectExpr("src", "1 AS v"), ["src"], spread="id").count() == 1
