"""Histories, trends, budgets and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowskein.session import Levels, materialize


def run_counts(rows: DataFrame, by: list[str], run: str = "run_at") -> DataFrame:
    """Count of each group at each run."""
    return rows.groupBy(run, *by).agg(F.count("*").alias("count"))


def trend(history: DataFrame, by: list[str], n_back: int) -> DataFrame:
    """Latest count of each group against the one ``n_back`` runs before (or the oldest).

    A run counts once in a group; ``runs`` is how many there are.
    """
    once = history.groupBy(*by, "run_at").agg(F.max("count").alias("count"))
    order = W.partitionBy(*by).orderBy(F.col("run_at").desc())
    ranked = once.withColumn("rn", F.row_number().over(order)).withColumn("runs", F.count("*").over(W.partitionBy(*by)))
    pick = lambda cond: F.max(F.when(cond, F.col("count")))
    out = ranked.groupBy(*by).agg(
        pick(F.col("rn") == 1).alias("latest"), pick(F.col("rn") == F.least(F.lit(n_back), F.col("runs"))).alias("baseline"), F.max("runs").alias("runs")
    )
    return out.withColumn("delta", F.col("latest") - F.col("baseline"))


def growth(history: DataFrame, by: list[str], runs: int = 3) -> DataFrame:
    """Groups whose newest ``runs`` counts rise strictly with time."""
    order = W.partitionBy(*by).orderBy(F.col("run_at").desc(), F.col("count").desc())
    ranked = history.withColumn("rn", F.row_number().over(order)).withColumn("older", F.lead("count").over(order))
    newest = ranked.filter(F.col("rn") <= runs - 1)
    flags = newest.groupBy(*by).agg(F.count("*").alias("n"), F.min((F.col("count") > F.col("older")).cast("int")).alias("up"), F.count("older").alias("known"))
    return flags.filter((F.col("n") == runs - 1) & (F.col("known") == runs - 1) & (F.col("up") == 1)).select(*by)


def budget_prefix(items: DataFrame, by: list[str], order: list[str], cost: str, most: int | Column, salts: int = 64) -> DataFrame:
    """The longest prefix of each group whose cost stays within the budget, at least one item.

    What is beyond the budget in a salted part of a group is beyond it in the
    group, so parts are cut first and the last window sees little of a large
    group. The item that takes a part over the budget stays until then, for it
    is that item's cost that ends the group. Costs are not negative. ``most``
    may be a column that is the same for all rows of a group.
    """
    def over(keys: list[str]):
        return W.partitionBy(*keys).orderBy(*order)

    budget = most if isinstance(most, Column) else F.lit(most)
    salted = items.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(salts)))
    before = F.coalesce(F.sum(cost).over(over([*by, "__salt"]).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = salted.withColumn("__before", before).filter(F.col("__before") <= F.greatest(budget, F.lit(0))).drop("__before")
    run = parts.withColumn("used", F.sum(cost).over(over(by).rowsBetween(W.unboundedPreceding, 0))).withColumn("__n", F.row_number().over(over(by)))
    return run.filter((F.col("used") <= budget) | (F.col("__n") == 1)).drop("__n", "__salt")


def backfill(items: DataFrame, by: str, order: str, cost: str, most: int) -> DataFrame:
    """Prefix of the budget, then, in order, every later item that still fits.

    In rounds: of the items after the last one taken, those that cost more than
    what is left can never fit and are dropped; the prefix of the rest that fits
    is taken. Each round takes at least one item of every group that has any
    left, and what is left of a budget soon rules out nearly all. Groups are cut
    in salted parts, so none is one task. Costs are not negative, orders differ
    within a group; the first item is taken whatever it costs.
    """
    rows, _ = materialize(items.withColumn("__cost", F.coalesce(F.col(cost), F.lit(0))), "items")
    taken = Levels("backfill")
    level = budget_prefix(rows, [by], [order], "__cost", most)
    while taken.add(level.select(*rows.columns)):
        done = taken.all().groupBy(F.col(by).alias("__by")).agg((F.lit(most) - F.sum("__cost")).alias("__left"), F.max(order).alias("__last"))
        after = rows.join(done, rows[by].eqNullSafe(done["__by"])).filter((F.col(order) > F.col("__last")) & (F.col("__cost") <= F.col("__left")))
        level = budget_prefix(after, [by], [order], "__cost", F.col("__left"))
    return taken.all().drop("__cost")


def per_file_cap(rows: DataFrame, by: str, order: list[Column], most: int) -> DataFrame:
    """Groups with what is shown of them and what is dropped."""
    sized = rows.withColumn("__r", F.row_number().over(W.partitionBy(by).orderBy(*order)))
    return sized.groupBy(by).agg(F.count_if(F.col("__r") <= most).alias("n_shown"), F.count_if(F.col("__r") > most).alias("n_dropped"))


def asof_previous(rows: DataFrame, by: str, at: str, tie: str, is_left: Column, is_right: Column, payload: str) -> DataFrame:
    """For each left row the payload of the last right row at or before it in its group."""
    w = W.partitionBy(by).orderBy(at, tie).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("previous", F.last(F.when(is_right, F.col(payload)), ignorenulls=True).over(w)).filter(is_left)
