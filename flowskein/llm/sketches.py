"""Percentiles with bounded rank error from mergeable, deterministic summaries.

A summary keeps some of the values of a group with intervals that are known to
hold their ranks: for each kept value the least and greatest count of values up
to it, and the greatest count of values below it. A value that was dropped lies
between two kept ones, so its rank is uncertain by no more than the gap between
their intervals; compression drops values only while that gap stays within a
permitted share of the count. Merging adds intervals, and with them the
uncertainty, so each level of merging is permitted a little more than the one
before and the sum never exceeds ``error``. No sampling, no randomness.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowskein.session import materialize

#: Rank error of a finished summary, as a share of the count.
ERROR = 0.001
#: Summaries merged by one task at a time.
FAN_IN = 16
#: Values of all groups that one task holds before it compresses them.
BUFFER = 1_000_000

_ARRAYS = "n bigint, error double, v array<double>, lo array<bigint>, hi array<bigint>, below array<bigint>"
Summary = tuple[int, float, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def permitted(error: float, level: int) -> float:
    """Uncertainty at a level of merging: 1/2, 3/4, 7/8, ... of ``error``."""
    return error * (1 - 0.5 ** (level + 1))


def exact_summary(values: np.ndarray) -> Summary:
    """All distinct values with their exact ranks."""
    v, n = np.unique(values, return_counts=True)
    rank = np.cumsum(n)
    return int(rank[-1]), 0.0, v.astype(np.float64), rank.astype(np.int64), rank.astype(np.int64), (rank - n).astype(np.int64)


def merge(parts: list[Summary]) -> Summary:
    """Summary of the union: counts and uncertainties add up."""
    if len(parts) == 1:
        return parts[0]
    v = np.unique(np.concatenate([p[2] for p in parts]))
    lo, hi, below = (np.zeros(len(v), dtype=np.int64) for _ in range(3))
    for n, _, pv, plo, phi, pbelow in parts:
        at = np.searchsorted(pv, v, side="right") - 1
        same = (at >= 0) & (pv[np.maximum(at, 0)] == v)
        after = np.where(at + 1 < len(pv), np.append(pbelow, n)[at + 1], n)
        lo += np.where(at >= 0, plo[np.maximum(at, 0)], 0)
        hi += np.where(same, phi[np.maximum(at, 0)], after)
        below += np.where(same, pbelow[np.maximum(at, 0)], after)
    n = sum(p[0] for p in parts)
    return n, sum(p[0] * p[1] for p in parts) / n, v, lo, hi, below


def compress(s: Summary, error: float) -> Summary:
    """Drops values whose ranks stay certain to ``error`` of the count; ends stay."""
    n, _, v, lo, hi, below = s
    room = error * n
    keep, i = [0], 0
    while i < len(v) - 1:
        # the farthest next value such that all between are certain enough; below[] ascends
        j = int(np.searchsorted(below, lo[i] + room, side="right")) - 1
        i = min(max(j, i + 1), len(v) - 1)
        keep.append(i)
    gap = float(np.max((below[keep[1:]] - lo[keep[:-1]]) / n, initial=0.0))
    width = float(np.max((hi[keep] - lo[keep]) / n, initial=0.0))
    return n, max(gap, width, 0.0), v[keep], lo[keep], hi[keep], below[keep]


def percentile(s: Summary, pct: float) -> float:
    """Value whose rank is within the summary's error of the ``pct``-th percentile.

    Exact would be: the smallest value that at least ``pct`` % do not exceed.
    """
    n, _, v, lo, hi, _ = s
    target = max(1, math.ceil(round(pct * n / 100, 9)))
    return float(v[min(int(np.searchsorted((lo + hi) / 2, target, side="left")), len(v) - 1)])


def _row(s: Summary) -> dict:
    return dict(zip(("n", "error", "v", "lo", "hi", "below"), s))


def _read(row) -> Summary:
    return int(row.n), float(row.error), np.asarray(row.v), np.asarray(row.lo), np.asarray(row.hi), np.asarray(row.below)


def _merge_all(parts: Iterable[Summary], before: float, error: float) -> Summary:
    """Merges any number of summaries, never more than ``FAN_IN`` at once, with compression between.

    ``before`` is the uncertainty that the parts may have. What ``error`` permits
    beyond it is given out by inner level: a half, three quarters, and so on.
    """
    levels: list[list[Summary]] = [[]]
    for part in parts:
        levels[0].append(part)
        k = 0
        while len(levels[k]) == FAN_IN:
            whole = compress(merge(levels[k]), before + permitted(error - before, k))
            levels[k] = []
            k += 1
            if k == len(levels):
                levels.append([])
            levels[k].append(whole)
    return compress(merge([p for level in levels for p in level]), error)


def summaries(values: DataFrame, groups: list[str], value: str, error: float = ERROR) -> DataFrame:
    """One summary for each group: the groups, ``n``, ``error`` and the arrays.

    Each task summarises what it holds, then summaries are merged ``FAN_IN`` at
    a time, level by level, as many levels as the number of tasks asks for: no
    task sees a group whole, whatever its share of the rows. The tasks' own
    summaries are written before, so their number is known and none is made
    twice. Null and NaN values are left out; a group without values has no
    row. Null groups are groups. ``error`` of a row is the rank error reached.
    """
    leaf_error = permitted(error, 0)
    kinds = dict(values.dtypes)
    keyed = ", ".join(f"`{g}` {kinds[g]}" for g in groups)

    def leaf(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, list] = {}
        made: dict[tuple, list[Summary]] = {}
        count = 0

        def settle() -> None:
            for key, arrays in held.items():
                part = exact_summary(np.concatenate(arrays))
                made.setdefault(key, []).append(compress(part, leaf_error / 2))
            held.clear()

        for frame in frames:
            frame = frame[frame["__v"].notna()]
            for key, part in frame.groupby(groups, dropna=False, sort=False)["__v"]:
                key = tuple(None if pd.isna(k) else k for k in key)
                held.setdefault(key, []).append(part.to_numpy(np.float64))
                count += len(part)
            if count >= BUFFER:
                settle()
                count = 0
        settle()
        rows = [dict(zip(groups, key)) | _row(_merge_all(parts, leaf_error / 2, leaf_error)) for key, parts in made.items()]
        if rows:
            yield pd.DataFrame(rows)

    out = values.select(*groups, F.col(value).cast("double").alias("__v")).mapInPandas(leaf, f"{keyed}, {_ARRAYS}")
    made, _ = materialize(out.withColumn("__slot", F.spark_partition_id()), "summaries")
    return merged(made, groups, error, 1)


def _joiner(keys: list[str], before: float, allowed: float):
    def join(frame: pd.DataFrame) -> pd.DataFrame:
        whole = _merge_all((_read(r) for r in frame.itertuples(index=False)), before, allowed)
        return pd.DataFrame([{k: frame[k].iat[0] for k in keys} | _row(whole)])

    return join


def merged(parts: DataFrame, groups: list[str], error: float = ERROR, level: int = 1) -> DataFrame:
    """Summaries of ``groups`` from summaries of finer groups, partitions or days.

    ``parts`` has the columns of ``summaries``; ``__slot``, if there, numbers
    those of one group, else they are spread by hash over as many slots as the
    largest group asks for. ``error`` must be above that of the parts.
    """
    kinds = dict(parts.dtypes)
    keyed = ", ".join(f"`{g}` {kinds[g]}" for g in groups)
    if "__slot" in parts.columns:
        spread = (parts.agg(F.max("__slot")).first()[0] or 0) + 1
    else:
        parts, _ = materialize(parts, "parts")
        most = parts.groupBy(*groups).count().agg(F.max("count")).first()[0] or 1
        # half as many as a slot takes: few slots get more than FAN_IN, which are then merged in turn
        spread = FAN_IN * math.ceil(2 * most / FAN_IN)
        parts = parts.withColumn("__slot", F.pmod(F.xxhash64("n", "v", "hi"), F.lit(spread)).cast("int"))
    parts = parts.select(*groups, "__slot", "n", "error", "v", "lo", "hi", "below")
    while True:
        spread = math.ceil(spread / FAN_IN)
        join = _joiner([*groups, "__slot"], permitted(error, level - 1), permitted(error, level))
        slotted = parts.withColumn("__slot", F.expr(f"__slot div {FAN_IN}").cast("int"))
        parts = slotted.groupBy(*groups, "__slot").applyInPandas(join, f"{keyed}, __slot int, {_ARRAYS}")
        level += 1
        if spread <= 1:
            return parts.drop("__slot")


def percentiles(summaries: DataFrame, groups: list[str], pcts: list[float]) -> DataFrame:
    """One row for each summary and percentile: groups, ``pct``, ``value``, ``n``, ``rank_error``.

    All inside the JVM: the first kept value whose middle rank reaches the target.
    """
    target = F.greatest(F.lit(1), F.ceil(F.round(F.col("pct") * F.col("n") / 100, 9)))
    ranks = F.arrays_zip("v", "lo", "hi")
    reached = F.filter(ranks, lambda r: (r["lo"] + r["hi"]) / 2 >= F.col("__t"))
    value = F.coalesce(F.try_element_at(reached, F.lit(1))["v"], F.element_at("v", -1))
    each = summaries.withColumn("pct", F.explode(F.array(*(F.lit(float(p)) for p in pcts)))).withColumn("__t", target)
    return each.select(*groups, "pct", value.alias("value"), "n", F.col("error").alias("rank_error"))


def tool_measures(calls: DataFrame) -> DataFrame:
    """Usable measures of tool calls: ``tool``, ``day``, ``measure``, ``value``.

    Input: ``id``, ``ts``, ``tool``, ``duration_ms``, ``result_bytes``. Tools
    compare trimmed and in lower case. An id counts once; should its rows
    differ, the lowest (tool, ts, duration, size) counts. Rows without id count
    once each distinct row. Null and negative values are left out, null tools too.
    """
    tool = F.lower(F.btrim("tool", F.lit(" \t\r\n")))
    own = F.when(F.col("id").isNull(), F.xxhash64("tool", "ts", "duration_ms", "result_bytes"))
    rows = calls.select("id", own.alias("__own"), F.struct(tool.alias("tool"), F.to_date("ts").alias("day"), "duration_ms", "result_bytes").alias("c"))
    once = rows.groupBy("id", "__own").agg(F.min("c").alias("c")).select("c.*").filter(F.col("tool").isNotNull())

    def measure(name: str) -> Column:
        return F.struct(F.lit(name).alias("measure"), F.col(name).cast("bigint").alias("value"))

    each = once.select("tool", "day", F.explode(F.array(measure("duration_ms"), measure("result_bytes"))).alias("m"))
    return each.select("tool", "day", "m.measure", "m.value").filter(F.col("value") >= 0)


def over_limit(summaries: DataFrame, limits: DataFrame) -> DataFrame:
    """``limits`` rows (``tool``, ``measure``, ``pct``, ``limit_value``) whose percentile is above.

    A limit without summary is met.
    """
    target = F.greatest(F.lit(1), F.ceil(F.round(F.col("pct") * F.col("n") / 100, 9)))
    asked = limits.select(F.lower(F.btrim("tool", F.lit(" \t\r\n"))).alias("tool"), "measure", "pct", "limit_value")
    at = asked.join(summaries, ["tool", "measure"]).withColumn("__t", target)
    reached = F.filter(F.arrays_zip("v", "lo", "hi"), lambda r: (r["lo"] + r["hi"]) / 2 >= F.col("__t"))
    value = F.coalesce(F.try_element_at(reached, F.lit(1))["v"], F.element_at("v", -1))
    return at.withColumn("value", value).filter(F.col("value") > F.col("limit_value")).select("tool", "measure", "pct", "limit_value", "value")


def rank_check(values: DataFrame, found: DataFrame, groups: list[str]) -> DataFrame:
    """Whether each percentile of ``found`` (as of ``percentiles``) has a rank within its stated error, by counting all values.

    Adds nothing but ``n_exact``, the count of the group's values, and ``within``.
    """
    named = found.withColumnsRenamed({g: f"__{g}" for g in groups})
    usable = values.filter(F.col("value").isNotNull())
    met = usable.groupBy(*groups, F.col("value").alias("__x")).agg(F.count("*").alias("__c")).alias("u")
    on = [F.col(f"u.{g}").eqNullSafe(F.col(f"f.__{g}")) for g in groups]
    pairs = met.join(named.withColumnRenamed("value", "__v").alias("f"), on)
    counted = pairs.groupBy(*(F.col(f"u.{g}").alias(g) for g in groups), "pct", "__v", "n", "rank_error").agg(
        F.sum("__c").alias("n_exact"), F.sum(F.when(F.col("__x") <= F.col("__v"), F.col("__c")).otherwise(0)).alias("__le"), F.sum(F.when(F.col("__x") < F.col("__v"), F.col("__c")).otherwise(0)).alias("__lt")
    )
    target = F.greatest(F.lit(1), F.ceil(F.round(F.col("pct") * F.col("n_exact") / 100, 9)))
    room = F.col("rank_error") * F.col("n_exact") + 1
    within = (F.col("n") == F.col("n_exact")) & (F.col("__le") >= target - room) & (F.col("__lt") < target + room)
    return counted.select(*groups, "pct", "n_exact", within.alias("within"))
