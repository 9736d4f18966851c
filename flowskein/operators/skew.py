"""Even work over uneven keys: fragment and replicate by estimated load.

``load_plan`` estimates the load of every key from the whole input in two
passes of bounded result: exact row counts of hash buckets, then exact counts
of the keys inside the few buckets that outweigh a task's share. Keys above a
fraction of the share are split into shards in proportion to their load; the
shards and the rest of the buckets are packed to tasks, heaviest first. What
the driver sees is bounded by the number of tasks, not by the data.
"""

from __future__ import annotations

import heapq
import json
import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowskein.session import task_count


def key_hash(names: list[str], seed: int) -> Column:
    """64 bits of a key; nulls count as values of their own."""
    parts: list[Column] = [F.lit(seed)]
    for name in names:
        parts += [F.col(name), F.col(name).isNull()]
    return F.xxhash64(*parts)


@dataclass
class LoadPlan:
    keys: list[str]
    tasks: int
    buckets: int
    total: int
    bucket_bin: list[int]
    #: (first hash, second hash, load, bin of each shard)
    heavy: list[tuple[int, int, int, list[int]]] = field(default_factory=list)
    bin_load: list[float] = field(default_factory=list)

    def bucket(self) -> Column:
        return F.pmod(key_hash(self.keys, 1), F.lit(self.buckets)).cast("int")

    def bins(self, df: DataFrame) -> DataFrame:
        """``df`` with ``__bins``, the tasks that hold shards of its key, and ``__split``."""
        plain = F.array(F.element_at(F.from_json(F.lit(json.dumps(self.bucket_bin)), "array<int>"), self.bucket() + 1))
        if not self.heavy:
            return df.withColumn("__bins", plain).withColumn("__split", F.lit(False))
        known = df.sparkSession.createDataFrame(
            [(a, b, bins) for a, b, _, bins in self.heavy], "__k1 bigint, __k2 bigint, __hb array<int>"
        )
        # at most two rows for each task: a proven bound
        return (
            df.withColumn("__k1", key_hash(self.keys, 1))
            .withColumn("__k2", key_hash(self.keys, 2))
            .join(F.broadcast(known), ["__k1", "__k2"], "left")
            .withColumn("__bins", F.coalesce("__hb", plain))
            .withColumn("__split", F.coalesce(F.size("__hb") > 1, F.lit(False)))
            .drop("__k1", "__k2", "__hb")
        )


def load_plan(df: DataFrame, keys: list[str], tasks: int | None = None, buckets_per_task: int = 32, fraction: float = 0.5) -> LoadPlan:
    """Assignment of keys to ``tasks``; no shard is above ``fraction`` of a task's share.

    An empty input gives a plan without heavy keys. Null keys are keys.
    """
    tasks = tasks or task_count(df.sparkSession)
    plan = LoadPlan(keys, tasks, tasks * buckets_per_task, 0, [])
    loads = [0] * plan.buckets
    for row in df.groupBy(plan.bucket().alias("b")).count().collect():  # at most `buckets` rows
        loads[row["b"]] = row["count"]
    plan.total = sum(loads)
    limit = max(1.0, fraction * plan.total / tasks)
    heavy_buckets = [b for b, n in enumerate(loads) if n > limit]  # fewer than tasks / fraction
    rest = [float(n) for n in loads]
    found = []
    if heavy_buckets:
        found = (
            df.filter(plan.bucket().isin(heavy_buckets))
            .groupBy(plan.bucket().alias("b"), key_hash(keys, 1).alias("k1"), key_hash(keys, 2).alias("k2"))
            .count()
            .filter(F.col("count") > limit)
            .collect()  # fewer than tasks / fraction rows
        )
    items: list[tuple[float, int, int]] = []
    shards: list[list[int]] = []
    for h, row in enumerate(found):
        n = min(tasks, math.ceil(row["count"] / limit))
        rest[row["b"]] -= row["count"]
        items += [(row["count"] / n, h, s) for s in range(n)]
        shards.append([0] * n)
    items += [(n, -1, b) for b, n in enumerate(rest)]
    bins = [(0.0, t) for t in range(tasks)]
    plan.bucket_bin = [0] * plan.buckets
    for load, h, s in sorted(items, key=lambda x: (-x[0], x[1], x[2])):
        least, t = heapq.heappop(bins)
        heapq.heappush(bins, (least + load, t))
        if h < 0:
            plan.bucket_bin[s] = t
        else:
            shards[h][s] = t
    plan.bin_load = [load for load, _ in sorted(bins, key=lambda x: x[1])]
    plan.heavy = [(row["k1"], row["k2"], row["count"], shards[h]) for h, row in enumerate(found)]
    return plan


def heavy_items(work: DataFrame, plan: LoadPlan, key_columns: list[str], item_columns: list[str], buckets_per_task: int = 32) -> DataFrame | None:
    """Items that alone outweigh a shard, among the rows of split keys: a row each, or none.

    Looked for as heavy keys are: hash buckets first, then the items of the
    heavy buckets. At most two rows a task come back.
    """
    split = [(a, b) for a, b, _, bins in plan.heavy if len(set(bins)) > 1]
    if not split:
        return None
    spark = work.sparkSession
    limit = max(1.0, plan.total / plan.tasks)
    known = spark.createDataFrame(split, "__k1 bigint, __k2 bigint")  # at most two rows a task
    hashed = work.withColumn("__k1", key_hash(plan.keys, 1)).withColumn("__k2", key_hash(plan.keys, 2)).join(F.broadcast(known), ["__k1", "__k2"], "left_semi")
    bucket = F.pmod(F.xxhash64(F.lit(6), *key_columns, *item_columns), F.lit(plan.tasks * buckets_per_task)).cast("int")
    heavy = [r["b"] for r in hashed.groupBy(bucket.alias("b")).count().filter(F.col("count") > limit).collect()]
    if not heavy:
        return None
    found = hashed.filter(bucket.isin(heavy)).groupBy(*key_columns, *item_columns).count().filter(F.col("count") > limit).drop("count").collect()
    return spark.createDataFrame(found, hashed.select(*key_columns, *item_columns).schema) if found else None


def balanced_distinct(df: DataFrame, keys: list[str], item: str, plan: LoadPlan | None = None) -> DataFrame:
    """Distinct ``item`` values and rows of every key, with even tasks.

    Returns the keys, ``n_items`` and ``n_rows``. Rows of a split key go to its
    shards by item hash, so shards share no item and their counts add up. An
    item so often repeated that it outweighs a shard goes to all shards of its
    key instead, by the task its rows were read in, and is counted once over
    them. Items are compared by 128 hash bits. A null item is no item, but
    counts as a row; null keys are keys; an empty input gives an empty result.
    """
    work = df.select(*keys, F.xxhash64(F.lit(3), F.col(item)).alias("__i1"), F.xxhash64(F.lit(4), F.col(item)).alias("__i2"), F.col(item).isNotNull().alias("__is"))
    plan = plan or load_plan(df.select(*keys), keys)
    hashes = [key_hash(keys, 1).alias("__h1"), key_hash(keys, 2).alias("__h2")]
    repeated = heavy_items(work.select(*keys, *hashes, "__i1", "__i2"), plan, ["__h1", "__h2"], ["__i1", "__i2"])
    often = F.lit(False)
    if repeated is not None:
        work = work.select("*", *hashes).join(F.broadcast(repeated.withColumn("__often", F.lit(True))), ["__h1", "__h2", "__i1", "__i2"], "left").drop("__h1", "__h2")
        often = F.coalesce("__often", F.lit(False))
    by = F.when(often, F.spark_partition_id().cast("bigint")).otherwise(F.col("__i1"))
    placed = plan.bins(work.withColumn("__by", by).withColumn("__often", often))
    shard = F.element_at("__bins", (F.pmod(F.col("__by"), F.size("__bins")) + 1).cast("int"))
    placed = placed.withColumn("__bin", shard).drop("__bins", "__by").repartitionById(plan.tasks, F.col("__bin"))
    once = placed.groupBy("__bin", *keys, "__split", "__often", "__i1", "__i2", "__is").agg(F.count("*").alias("__n"))
    part = once.groupBy("__bin", *keys, "__split", "__often").agg(F.sum(F.when(~F.col("__often"), F.col("__is").cast("bigint")).otherwise(0)).alias("n_items"), F.sum("__n").alias("n_rows"))
    whole = part.filter(~F.col("__split")).select(*keys, "n_items", "n_rows")
    if not plan.heavy:
        return whole
    shards = part.filter("__split").select(*keys, "n_items", "n_rows")
    if repeated is not None:  # a row for each shard and repeated item, at most
        shards = shards.unionByName(once.filter("__often").select(*keys, "__i1", "__i2", "__is").distinct().select(*keys, F.col("__is").cast("bigint").alias("n_items"), F.lit(0).cast("bigint").alias("n_rows")))
    joined = shards.groupBy(*keys).agg(F.sum("n_items").alias("n_items"), F.sum("n_rows").alias("n_rows"))
    return whole.unionByName(joined)


def fragment_replicate_join(left: DataFrame, right: DataFrame, keys: list[str], spread: str, how: str = "left", plan: LoadPlan | None = None) -> DataFrame:
    """Equi-join whose left side has hot keys.

    A split key's left rows go to its shards by the hash of ``spread``; the
    matching right rows are replicated to those shards only, never to others.
    Both sides are placed by the plan's bins and joined where they lie, so a
    task's load is what the plan gave it. ``spread`` must tell rows of one key
    apart: rows that agree in it stay together. ``how`` is ``inner`` or ``left``. Null keys match nothing, but a left row is
    kept under ``left``. Columns other than the keys must differ between sides.
    """
    if how not in ("inner", "left"):
        raise ValueError(f"how must be inner or left, not {how!r}")
    plan = plan or load_plan(left.select(*keys), keys)
    shard = F.element_at("__bins", (F.pmod(F.xxhash64(F.lit(5), F.col(spread)), F.size("__bins")) + 1).cast("int"))
    one = plan.bins(left).withColumn("__bin", shard).drop("__bins", "__split").repartitionById(plan.tasks, F.col("__bin"))
    many = plan.bins(right).withColumn("__bin", F.explode(F.array_distinct("__bins"))).drop("__bins", "__split").repartitionById(plan.tasks, F.col("__bin"))
    return one.join(many.hint("merge"), ["__bin", *keys], how).drop("__bin")
