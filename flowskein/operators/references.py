"""References to records that do not exist (yet, or any more).

The parents' integer keys (here: the microseconds at which a record stands) are
compressed into contiguous runs for each identity; a reference is matched as of
its own key to the run that starts at or before it and is an orphan beyond that
run's end. Runs and references are united and sorted, and run ends are carried
forward, so no pairs of the two are made. An identity of very many references or
runs is worked on in spans of the key axis, each of which begins with what the
spans before it hand over, so it is many tasks. Identities travel as
128 hash bits. References are first reduced to distinct (identity, key) pairs,
so a hot identity shrinks before the shuffle; the rows behind the few orphan
pairs are fetched by a second pass that a bitmap of bounded size has thinned
out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowskein.operators.skew import key_hash, load_plan
from flowskein.session import materialize

LEAST, MOST = -(2**63), 2**63 - 1
#: Bits of the largest bitmap: a broadcast of at most 2**21 words.
BITMAP_BITS = 2**27
#: Span of the axis that is worked on at a time: a day of microseconds, or more if the axis is longer than ``MOST_CHUNKS`` of them.
CHUNK, MOST_CHUNKS = 86_400_000_000, 4_096


def identity(value: Column) -> list[Column]:
    return [F.xxhash64(F.lit(1), value).alias("__h1"), F.xxhash64(F.lit(2), value).alias("__h2")]


def _chunk(key: str, size: int) -> Column:
    return F.expr(f"{key} div {size}")


def key_runs(parents: DataFrame, chunk_size: int = CHUNK) -> DataFrame:
    """Contiguous runs [``start``, ``end``) of each identity (``__h1``, ``__h2``) that start in one span of the axis.

    Input: one row for each stay, ``start`` and ``end`` bigint, end exclusive and
    null for open. A single integer key k is the stay [k, k + 1). Overlapping and
    touching stays join. A stay that ends at or before its start, or has no
    start, is kept as an empty run: it proves the identity, but holds nothing.
    Exact repeats collapse on the map side.
    """
    start = F.coalesce("start", F.lit(LEAST))
    stays = parents.select("__h1", "__h2", start.alias("start"), F.greatest(start, F.when(F.col("start").isNull(), start).otherwise(F.coalesce("end", F.lit(MOST)))).alias("end"))
    stays = stays.groupBy("__h1", "__h2", "start").agg(F.max("end").alias("end")).withColumn("__chunk", _chunk("start", chunk_size))
    by = ["__h1", "__h2", "__chunk"]
    line = W.partitionBy(*by).orderBy("start")
    before = F.max("end").over(line.rowsBetween(W.unboundedPreceding, -1))
    opened = stays.withColumn("__new", F.when(before >= F.col("start"), 0).otherwise(1))
    numbered = opened.withColumn("__run", F.sum("__new").over(line.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "__run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("__run")


def orphan_keys(references: DataFrame, runs: DataFrame, chunk_size: int = CHUNK, tasks: int | None = None) -> DataFrame:
    """Distinct orphan pairs (``__h1``, ``__h2``, ``__key``) with their ``reason``.

    ``runs`` as of ``key_runs``. ``missing``: the identity has no run; ``late``:
    none that starts at or before the key; ``removed``: the key lies beyond the
    ends of all that do. A null key lies nowhere: its reason is ``missing`` or
    else ``removed``. Identities that outweigh a task's share (``load_plan``)
    are worked on in spans of the axis, all others whole.
    """
    none = F.lit(None).cast("bigint")
    asked = references.select("__h1", "__h2", "__key").distinct()
    events = asked.select("__h1", "__h2", F.coalesce("__key", F.lit(LEAST)).alias("__at"), F.lit(2).alias("__o"), none.alias("end"), "__key").unionByName(
        runs.select("__h1", "__h2", F.col("start").alias("__at"), F.lit(1).alias("__o"), "end", none.alias("__key"))
    )
    events, _ = materialize(events, "events")
    plan = load_plan(events, ["__h1", "__h2"], tasks)
    by_id, spans = ["__h1", "__h2"], ["__h1", "__h2", "__chunk"]
    line = events.withColumn("__chunk", F.lit(0).cast("bigint")).withColumn("__is", F.lit(None).cast("boolean"))
    if plan.heavy:
        hot = events.sparkSession.createDataFrame([(a, b) for a, b, _, _ in plan.heavy], "__k1 bigint, __k2 bigint")  # at most two rows a task
        keyed = line.withColumn("__k1", key_hash(by_id, 1)).withColumn("__k2", key_hash(by_id, 2))
        marked = keyed.join(F.broadcast(hot.withColumn("__hot", F.lit(True))), ["__k1", "__k2"], "left").drop("__k1", "__k2")
        line = marked.withColumn("__chunk", F.when(F.col("__hot"), _chunk("__at", chunk_size)).otherwise(0))
        # what each span hands over to the later ones: at most one row for each span of a hot identity
        held = line.filter("__hot").groupBy(*spans).agg(F.max("end").alias("__end"), F.max(F.col("__o") == 2).alias("__asked"))
        own = W.partitionBy(*by_id)
        before = F.max("__end").over(own.orderBy("__chunk").rowsBetween(W.unboundedPreceding, -1))
        handed = held.withColumn("end", before).withColumn("__is", F.max("__end").over(own).isNotNull()).filter("__asked")
        line = line.drop("__hot").unionByName(handed.select(*spans, F.lit(LEAST).alias("__at"), F.lit(0).alias("__o"), "end", none.alias("__key"), "__is"))
    whole = W.partitionBy(*spans)
    carried = whole.orderBy((F.col("__o") > 0).cast("int"), "__at", "__o").rowsBetween(W.unboundedPreceding, 0)
    any_run = F.coalesce(F.max("__is").over(whole), F.max(F.col("__o") == 1).over(whole))
    met = line.withColumn("__reach", F.max("end").over(carried)).withColumn("__known", any_run).filter("__o = 2")
    reason = (
        F.when(~F.col("__known"), "missing").when(F.col("__key").isNull(), "removed").when(F.col("__reach").isNull(), "late")
        .when(F.col("__reach") > F.col("__at"), "held").otherwise("removed")
    )
    return met.select("__h1", "__h2", "__key", reason.alias("reason")).filter(F.col("reason") != "held")


def thinned(rows: DataFrame, wanted: DataFrame, n_wanted: int, on: list[str]) -> DataFrame:
    """``rows`` that may match ``wanted`` on the columns ``on``: all that do, few others.

    A bitmap of 16 bits for each wanted row, at most ``BITMAP_BITS``, goes to the
    tasks as (word, bits) rows. Beyond the size it is made for it lets more rows
    through, never fewer.
    """
    size = 2**16
    while size < min(16 * n_wanted, BITMAP_BITS):
        size *= 2
    place = F.pmod(F.xxhash64(F.lit(7), *(F.coalesce(F.col(c), F.lit(LEAST)) for c in on)), F.lit(size))
    bit = lambda: F.expr("shiftleft(1L, cast(__place & 63 as int))")
    words = (
        wanted.select(place.alias("__place"))
        .select(F.expr("__place div 64").alias("__word"), bit().alias("__bit"))
        .groupBy("__word")
        .agg(F.bit_or("__bit").alias("__bits"))
    )
    marked = rows.withColumn("__place", place).withColumn("__word", F.expr("__place div 64")).withColumn("__bit", bit())
    return (
        marked.join(F.broadcast(words), "__word")  # at most 2**21 rows
        .filter(F.col("__bits").bitwiseAND(F.col("__bit")) != 0)
        .drop("__place", "__word", "__bit", "__bits")
    )


def no_reference(value: Column) -> Column:
    """Ends that name nothing: null, blank, or the ``unresolved`` sentinel."""
    text = F.btrim(value, F.lit(" \t\r\n"))
    return value.isNull() | (text == "") | (value == "unresolved") | value.startswith("unresolved:")


def orphan_references(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Orphan ends of edge rows: ``edge_id``, ``side``, ``reason``, ``period``.

    ``edges``: ``id``, ``src``, ``dst``, ``indexed_at``; ``nodes``: ``id``,
    ``indexed_at``, ``removed_at`` (all tables of nodes united); other columns
    are ignored. Every edge row counts, repeats too. Ends that are null, blank
    or ``unresolved`` are no references; nodes without id are left out. Without
    nodes every reference is ``missing``; without edges the result is empty. A
    null edge time gives a null period.
    """
    ends = edges.select(
        F.col("id").alias("edge_id"),
        F.unix_micros(F.col("indexed_at").cast("timestamp")).alias("__key"),
        F.explode(F.array(*(F.struct(F.lit(side).alias("side"), F.col(side).alias("ref")) for side in ("src", "dst")))).alias("__e"),
    ).select("edge_id", "__key", "__e.side", "__e.ref")
    ends = ends.filter(~no_reference(F.col("ref"))).select("edge_id", "__key", "side", *identity(F.col("ref")))
    stays = nodes.filter(F.col("id").isNotNull()).select(
        *identity(F.col("id")),
        F.unix_micros(F.col("indexed_at").cast("timestamp")).alias("start"),
        F.unix_micros(F.col("removed_at").cast("timestamp")).alias("end"),
    )
    ends_of = edges.agg(*(F.unix_micros(f(F.col("indexed_at")).cast("timestamp")) for f in (F.min, F.max))).first()
    chunk = max(CHUNK, ((ends_of[1] or 0) - (ends_of[0] or 0)) // MOST_CHUNKS + 1)
    orphans, _ = materialize(orphan_keys(ends, key_runs(stays, chunk), chunk), "orphans")
    few = thinned(ends, orphans, orphans.count(), ["__h1", "__h2", "__key"])
    left, right = few.alias("l"), orphans.alias("r")
    same = (F.col("l.__h1") == F.col("r.__h1")) & (F.col("l.__h2") == F.col("r.__h2")) & F.col("l.__key").eqNullSafe(F.col("r.__key"))
    period = F.date_format(F.timestamp_micros(F.col("l.__key")), "yyyy-MM")
    return left.join(right, same).select("edge_id", "side", "reason", period.alias("period"))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans counted by side, reason and period."""
    return orphans.groupBy("side", "reason", "period").agg(F.count("*").alias("n_refs"), F.countDistinct("edge_id").alias("n_edges"))
