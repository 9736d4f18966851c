"""Scores of answers against ground truth, gates, and pairings of trials."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowskein.functions.scalars import normal_fact
from flowskein.session import materialize


def case_scores(expected: DataFrame, returned: DataFrame, ledger: DataFrame, must: DataFrame | None = None, forbidden: DataFrame | None = None, exhaustive: DataFrame | None = None) -> DataFrame:
    """Recall of each case, and its misses: honest if the ledger names them, silent if not.

    Inputs: ``case_id``, ``item`` (sets). A hard fail is a must-item neither
    returned nor in the ledger, or a forbidden one returned. Precision only for
    ``exhaustive`` cases (``case_id``). A case without expectations has recall 1.
    """
    def flag(df: DataFrame | None, name: str) -> DataFrame:
        base = df if df is not None else expected.limit(0)
        return base.select("case_id", "item").distinct().withColumn(name, F.lit(True))

    rows = flag(expected, "e")
    for df, name in ((returned, "r"), (ledger, "l"), (must, "m"), (forbidden, "f")):
        rows = rows.join(flag(df, name), ["case_id", "item"], "full")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(False)) for c in "erlmf"})
    n = lambda cond: F.count_if(F.expr(cond))
    out = rows.groupBy("case_id").agg(
        n("e").alias("n_expected"), n("e AND r").alias("n_hits"), n("r").alias("n_returned"), n("e AND NOT r AND l").alias("honest_misses"),
        n("e AND NOT r AND NOT l").alias("silent_misses"), n("f AND r").alias("forbidden_hits"), (n("m AND NOT r AND NOT l") + n("f AND r") > 0).alias("hard_fail"),
    )
    out = out.withColumn("recall", F.when(F.col("n_expected") == 0, 1.0).otherwise(F.col("n_hits") / F.col("n_expected")))
    whole = exhaustive.select("case_id").distinct().withColumn("__x", F.lit(True)) if exhaustive is not None else out.select("case_id").limit(0).withColumn("__x", F.lit(True))
    precision = F.when(F.col("__x") & (F.col("n_returned") > 0), F.col("n_hits") / F.col("n_returned"))
    return out.join(whole, "case_id", "left").withColumn("precision", precision).drop("__x")


def corpus_report(results: DataFrame, by: list[str]) -> DataFrame:
    """Macro averages over cases; NaN and null scores are no scores.

    Scores are summed as whole millionths and means are cut to them, so that the
    result does not hang on the order of addition.
    """
    micro = lambda c: F.when(~F.isnan(c), F.round(F.col(c) * 1e6).cast("bigint"))
    mean = lambda c: F.floor(F.sum(micro(c)) / F.count(micro(c))) / 1e6
    return results.groupBy(*by).agg(
        F.count("*").alias("n_cases"), mean("recall").alias("recall"), mean("precision_score").alias("precision_mean"),
        F.sum("honest_misses").alias("honest_misses"), F.sum("silent_misses").alias("silent_misses"), F.count_if("hard_fail").alias("hard_fails"),
    )


def regression_gate(current: DataFrame, baseline: DataFrame, keys: list[str]) -> DataFrame:
    """Cases that got worse, with the first reason that holds: one full outer join."""
    cols = ("recall", "precision_score", "silent_misses", "hard_fail")
    a = current.select(*keys, *(F.col(c).alias(f"c_{c}") for c in cols), F.lit(True).alias("__c"))
    b = baseline.select(*keys, *(F.col(c).alias(f"b_{c}") for c in cols), F.lit(True).alias("__b"))
    real = lambda c: F.when(~F.isnan(c), F.col(c))
    both = b.join(a, keys, "full")
    reason = (
        F.when(F.col("__c").isNull(), "missing_case")
        .when(F.col("__b").isNull(), F.lit(None))
        .when(F.col("c_hard_fail") & ~F.col("b_hard_fail"), "new_hard_fail")
        .when(real("c_recall") < real("b_recall") - 1e-9, "recall_drop")
        .when(F.col("c_silent_misses") > F.col("b_silent_misses"), "silent_miss_rise")
        .when(real("c_precision_score") < real("b_precision_score") - 1e-9, "precision_drop")
    )
    return both.select(*keys, reason.alias("reason")).filter("reason IS NOT NULL")


def arm_summary(trials: DataFrame, arm: str, value: str, error: str) -> DataFrame:
    """Averages per arm over measured trials; errors are counted apart."""
    ok = F.col(error).isNull() | (F.col(error) == "")
    return trials.groupBy(arm).agg(F.count("*").alias("n_trials"), F.count_if(~ok).alias("n_errors"), (F.floor(10_000 * F.sum(F.when(ok, F.col(value))) / F.count(F.when(ok, F.col(value)))) / 10_000).alias("mean_value"))


def pairing(trials: DataFrame, keys: list[str], arm: str, value: str, a: str, b: str) -> DataFrame:
    """Median reduction in percent from arm ``a`` to ``b`` over keys that have both."""
    side = lambda name: F.avg(F.when(F.col(arm) == name, F.col(value)))
    paired = trials.groupBy(*keys).agg(side(a).alias("a"), side(b).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL AND a > 0")
    cut = paired.select((100.0 * (F.col("a") - F.col("b")) / F.col("a")).alias("cut"))
    return exact_median(cut, "cut", slice_=0.001)


def exact_median(values: DataFrame, column: str, slice_: float) -> DataFrame:
    """``n_pairs`` and the exact ``median_reduction`` of a column, without gathering it.

    Two approximate percentiles, off by a tenth of ``slice_`` at most, bound the
    median; values below are counted, and only the slice between is sorted,
    equal values as one. An even count takes the mean of the middle two; no
    values give 0 and null.
    """
    spark = values.sparkSession
    kept, _ = materialize(values.select(F.col(column).cast("double").alias("v")).filter("v IS NOT NULL"), "median")
    ends = F.percentile_approx("v", F.array(F.lit(0.5 - slice_), F.lit(0.5 + slice_)), math.ceil(10 / slice_))
    n, bounds = kept.agg(F.count("*"), ends).first()
    if not n:
        return spark.createDataFrame([(0, None)], "n_pairs bigint, median_reduction double")
    low, high = bounds
    below = kept.filter(F.col("v") < low).count()
    near = kept.filter(F.col("v").between(low, high)).groupBy("v").count()
    order = W.partitionBy(F.lit(1)).orderBy("v")
    ranked = near.withColumn("to", F.sum("count").over(order) + below).withColumn("from", F.col("to") - F.col("count"))
    middle = [(n - 1) // 2 + 1, n // 2 + 1]
    at = [F.max(F.when((F.col("from") < m) & (F.col("to") >= m), F.col("v"))) for m in middle]
    return ranked.agg(F.round((at[0] + at[1]) / 2, 6).alias("median_reduction")).select(F.lit(n).cast("bigint").alias("n_pairs"), "median_reduction")


def flow_gate(pairs: DataFrame, correctness: float) -> DataFrame:
    """Median reduction of 80 % and correctness of 0.95."""
    return pairs.withColumn("pass", (F.col("median_reduction") >= 80) & F.lit(correctness >= 0.95))


def facts_matched(answers: DataFrame, facts: DataFrame) -> DataFrame:
    """Answers that hold every required fact and no forbidden one.

    ``answers``: ``case_id``, ``answer``; ``facts``: ``case_id``, ``fact``, ``required``.
    """
    met = answers.join(facts, "case_id").withColumn("hit", normal_fact(F.col("answer")).contains(normal_fact(F.col("fact"))))
    return met.groupBy("case_id").agg(
        F.count_if(F.col("required") & ~F.col("hit")).alias("n_missing"), F.count_if(~F.col("required") & F.col("hit")).alias("n_forbidden")
    ).withColumn("correct", (F.col("n_missing") == 0) & (F.col("n_forbidden") == 0))


def promoted_gaps(edges: DataFrame, cases: DataFrame) -> DataFrame:
    """New cases for observed gaps that no case (``case_id``) covers yet."""
    case_id = F.concat(F.lit("gap-"), F.substring(F.sha2(F.concat_ws("\u0001", "src", "dst", "type"), 256), 1, 12))
    gaps = edges.filter("verification_state = 'observed_only_gap'").select(case_id.alias("case_id"), "src", "dst", "type").distinct()
    return gaps.join(cases.select("case_id"), "case_id", "left_anti")


def set_diff(expected: DataFrame, produced: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of either side that the other lacks, with multiplicity."""
    a, b = expected.select(*keys), produced.select(*keys)
    return a.exceptAll(b).withColumn("side", F.lit("missing")).unionByName(b.exceptAll(a).withColumn("side", F.lit("extra")))


CASE_FIELDS = {"expected": ("expected_impacted", "expect_any_of"), "must": ("must_not_miss",), "forbidden": ("must_not_include",)}


def manifest_cases(manifests: DataFrame) -> DataFrame:
    """Cases of evaluation manifests (``repo``, ``text`` in YAML or JSON): ``repo``, ``case_id``, ``kind``, ``target``, ``exhaustive`` and the lists ``expected``, ``must``, ``forbidden``.

    A case without id gets one of its kind and target. A manifest that cannot be
    read is a row of kind 'invalid' whose target is the problem.
    """
    schema = "repo string, case_id string, kind string, target string, exhaustive boolean, " + ", ".join(f"{n} array<string>" for n in CASE_FIELDS)

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import yaml  # JSON is YAML, too

        for frame in frames:
            rows = []
            for repo, text in zip(frame["repo"], frame["text"]):
                try:
                    for case in (yaml.safe_load(text or "") or {}).get("cases") or []:
                        kind, target = str(case.get("kind") or ""), str(case.get("target") or case.get("query") or "")
                        lists = [[str(x) for f in fields for x in case.get(f) or []] for fields in CASE_FIELDS.values()]
                        rows.append((repo, str(case.get("id") or f"{kind}-{target}"), kind, target, bool(case.get("exhaustive")), *lists))
                except (yaml.YAMLError, AttributeError, TypeError) as e:
                    rows.append((repo, "", "invalid", f"{type(e).__name__}"[:200], False, *([[]] * len(CASE_FIELDS))))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])

    return manifests.select("repo", "text").mapInPandas(read, schema)


def case_items(cases: DataFrame, name: str) -> DataFrame:
    """One of the lists of ``manifest_cases`` as the sets that ``case_scores`` takes: ``case_id``, ``item``."""
    return cases.select("case_id", F.explode(name).alias("item")).distinct()
