import math

from pyspark.sql import functions as F

from flowskein.operators import diff

FIELDS = [diff.Field("recall", 1e-6), diff.Field("silent")]
SCHEMA = "id bigint, recall double, silent double, diff string"


def differences(spark, left, right):
    a = spark.createDataFrame([(*r, "clash") for r in left], SCHEMA)
    b = spark.createDataFrame([(*r, "clash") for r in right], SCHEMA)
    return {(r["id"], r["diff"]) for r in diff.differences(a, b, ["id"], FIELDS, "a", "b").collect()}


def test_every_kind_of_difference(spark):
    nan, inf = math.nan, math.inf
    left = [(1, 0.5, 1.0), (2, None, 1.0), (3, nan, 1.0), (4, nan, 1.0), (5, inf, None), (6, 0.5, 2.0), (7, 0.5, 1.0), (9, inf, 1.0), (None, 1.0, 1.0)]
    right = [(1, 0.5 + 1e-9, 1.0), (2, None, 1.0), (3, nan, 1.0), (4, 0.1, 1.0), (5, inf, 0.0), (6, 0.5 + 2e-6, 2.0), (8, 0.5, 1.0), (9, -inf, 1.0), (None, 1.0, 1.0)]
    assert differences(spark, left, right) == {(4, "recall"), (5, "silent"), (6, "recall"), (7, "only_a"), (8, "only_b"), (9, "recall")}


def test_repeats_and_empty_sides(spark):
    assert differences(spark, [(1, 0.5, 1.0)] * 3, [(1, 0.5, 1.0)] * 2) == set()
    assert differences(spark, [], [(1, 0.5, 1.0)]) == {(1, "only_b")}
    assert differences(spark, [], []) == set()


def test_number_texts(spark):
    texts = ["3", " +03 ", "3.0", "", "\t", None, "x"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(diff.number_text(F.col("t")).alias("n")).collect()
    assert [r["n"] for r in rows[:6]] == [3.0, 3.0, 3.0, None, None, None] and math.isnan(rows[6]["n"])


def test_conflicts_inside_one_copy(spark):
    left = spark.createDataFrame([(1, 0.5, 1.0, ""), (1, 0.5 + 1e-9, 1.0, ""), (2, 0.5, 1.0, ""), (2, 0.5, 2.0, ""), (3, None, 1.0, ""), (3, 0.5, 1.0, "")], SCHEMA)
    right = spark.createDataFrame([(1, 0.1, 1.0, ""), (1, 0.9, 2.0, ""), (4, 1.0, None, "")], SCHEMA)
    got = {(r["id"], r["side"], r["field"]) for r in diff.conflicts(left, right, ["id"], FIELDS, "a", "b").collect()}
    assert got == {(2, "a", "silent"), (3, "a", "recall"), (1, "b", "recall")}
    assert diff.conflicts(left.limit(0), right.limit(0), ["id"], FIELDS, "a", "b").count() == 0
