"""Sources mixed to target weights by Pfair scheduling.

A source's tokens are cut into blocks; its k-th block of a cycle is released at
slot floor(k Q / q) and due by ceil((k + 1) Q / q), for q of the Q slots of a
cycle. Earliest deadline first then keeps every source within one block of its
share at any point of the mixture. A cycle is long enough for the least weight
to have some slots in it. One cycle's slots are laid out on the driver and
repeat; documents find their slot by their source's running token count.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowskein.llm.packing import COPIES, byte_tokens

#: Least and most slots of a cycle (more only where there are more sources); slots of the least weight; tokens of a block, about.
SLOTS, MOST_SLOTS, LEAST_QUOTA, BLOCK_TOKENS = 1_000, 200_000, 2, 262_144
#: Rows of a schedule or of a table of sources up to which it is broadcast, else joined by shuffle.
BROADCAST_ROWS = 200_000
#: Documents of a source that are ordered at a time.
BUCKET_DOCS = 20_000


def edf_slots(quotas: list[int]) -> list[list[int]]:
    """Slots of each source's blocks in one cycle of ``sum(quotas)`` slots.

    Blocks are run in their windows, earliest deadline first, ties by source.
    """
    total = sum(quotas)
    slots: list[list[int]] = [[] for _ in quotas]
    waiting = [(0, i) for i, q in enumerate(quotas) if q]
    heapq.heapify(waiting)
    ready: list[tuple[int, int]] = []
    for slot in range(total):
        while waiting and waiting[0][0] <= slot:
            _, i = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(len(slots[i]) + 1) * total // quotas[i]), i))
        _, i = heapq.heappop(ready)
        slots[i].append(slot)
        if len(slots[i]) < quotas[i]:
            heapq.heappush(waiting, (len(slots[i]) * total // quotas[i], i))
    return slots


def cycle_slots(weights: list[float]) -> int:
    """Slots of a cycle in which the least weight has ``LEAST_QUOTA``, between ``SLOTS`` and ``MOST_SLOTS``, and at least two a source."""
    least = math.ceil(LEAST_QUOTA * sum(weights) / min(weights))
    return max(min(max(SLOTS, least), MOST_SLOTS), 2 * len(weights))


def quotas(weights: list[float], slots: int) -> list[int]:
    """Whole slots by largest remainder, at least one for a positive weight; their sum is ``slots``.

    What the weights below one slot take too much is taken off the largest
    quotas in proportion. There must be a slot for every positive weight.
    """
    if slots < sum(w > 0 for w in weights):
        raise ValueError(f"{slots} slots are too few for {len(weights)} sources")
    out = [0] * len(weights)
    todo = [i for i, w in enumerate(weights) if w > 0]
    left, rest = slots, float(sum(weights))
    while small := [i for i in todo if weights[i] * left < rest]:
        # one slot each; the others share what remains, which can make more of them small
        for i in small:
            out[i] = 1
        left -= len(small)
        rest -= sum(weights[i] for i in small)
        todo = [i for i in todo if not out[i]]
    exact = {i: weights[i] / rest * left for i in todo}
    for i, x in exact.items():
        out[i] = max(1, int(x))
    by_remainder = sorted(todo, key=lambda i: (out[i] - exact[i], i))
    for k in range(slots - sum(out)):
        out[by_remainder[k % len(by_remainder)]] += 1
    return out


def normal_source(source: Column) -> Column:
    """Sources compare trimmed and in lower case; blank is none."""
    name = F.lower(F.btrim(source, F.lit(" \t\r\n")))
    return F.when(name != "", name)


@dataclass(frozen=True)
class Share:
    source: str
    target: float
    max_repeats: int
    tokens: int
    docs: int
    #: Tokens that the mixture takes: the target's, or all that the repeats allow.
    wanted: float
    taken: float

    @property
    def short(self) -> bool:
        return self.tokens * self.max_repeats < self.wanted


def shares(documents: DataFrame, targets: DataFrame) -> list[Share]:
    """What each target source has and gives, for a mixture as large as all documents with a source.

    ``targets`` (``source``, ``target_share``, ``max_repeats``) is configuration:
    the driver holds one row of it a source, and nothing of other sources.
    Repeated sources: shares add up, the largest cap counts. Null sources,
    shares or caps there count as none, 0 and 1.
    """
    asked = targets.groupBy(normal_source(F.col("source")).alias("source")).agg(
        F.sum(F.coalesce("target_share", F.lit(0.0))).alias("share"), F.max(F.coalesce("max_repeats", F.lit(1))).alias("cap")
    )
    asked = asked.filter(F.col("source").isNotNull())
    sized = documents.select(normal_source(F.col("source")).alias("source"), byte_tokens(F.col("text")).alias("tokens")).filter(F.col("source").isNotNull())
    held = sized.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("docs")).join(asked, "source", "full")
    # one row for each target, and one for all other sources
    named = F.when(F.col("cap").isNotNull(), F.col("source"))
    rows = held.groupBy(named.alias("source")).agg(F.max("share").alias("share"), F.max("cap").alias("cap"), F.sum("tokens").alias("tokens"), F.sum("docs").alias("docs")).collect()
    total = sum(r["tokens"] or 0 for r in rows)
    out = []
    for r in sorted((r for r in rows if r["source"] is not None), key=lambda r: r["source"]):
        tokens, wanted = r["tokens"] or 0, r["share"] * total
        out.append(Share(r["source"], r["share"], r["cap"], tokens, r["docs"] or 0, wanted, min(wanted, float(tokens * r["cap"]))))
    return out


def mixture(documents: DataFrame, plan: list[Share], seed: int = 0) -> DataFrame:
    """Documents in mixed order: ``position`` (block), ``doc_id``, ``source``, ``epoch``, ``n_tokens``.

    Within a source documents come in an order hashed from id and ``seed``; an
    epoch is one pass over the source. A document belongs to the block in which
    it starts and is never cut. Up to the end of any block every source is less
    than one of its blocks, and the document that overlaps, from its share of
    the blocks so far. Documents of no source, or of one without target, are
    left out; null texts have no tokens. Null and repeated ids are documents
    like others. Nothing is gathered: running counts are taken within hash
    buckets of bounded size and shifted by the buckets before.
    """
    live = [s for s in plan if s.taken > 0]
    rows = documents.select(normal_source(F.col("source")).alias("source"), "doc_id", byte_tokens(F.col("text")).alias("n_tokens"), F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text")).alias("__h"))
    empty = "position bigint, doc_id bigint, source string, epoch int, n_tokens bigint"
    spark = documents.sparkSession
    if not live:
        return spark.createDataFrame([], empty)
    taken = sum(s.taken for s in live)
    slots = cycle_slots([s.taken for s in live])
    slot_quota = quotas([s.taken for s in live], slots)
    cycles = max(1, math.ceil(taken / (slots * BLOCK_TOKENS)))
    laid = [(s.source, k, slot) for s, own in zip(live, edf_slots(slot_quota)) for k, slot in enumerate(own)]
    bits = min(16, max(0, math.ceil(math.log2(max(s.docs for s in live) / BUCKET_DOCS + 1e-9))))
    sized = lambda df, n: F.broadcast(df) if n <= BROADCAST_ROWS else df
    known = spark.createDataFrame(
        [(s.source, s.taken, s.tokens, q, s.taken / (q * cycles)) for s, q in zip(live, slot_quota)],
        "source string, __taken double, __all bigint, __quota int, __block double",
    )
    schedule = spark.createDataFrame(laid, "source string, __turn int, __slot int")
    rows = rows.join(sized(known.select("source"), len(live)), "source").withColumn("__b", F.shiftrightunsigned("__h", 48).bitwiseAND(2**bits - 1))
    # repeated rows are one row with a number until they have their places
    rows = rows.groupBy("source", "doc_id", "n_tokens", "__h", "__b").agg(F.count("*").alias("__m"))
    weight = F.col("n_tokens") * F.col("__m")
    by_bucket = W.partitionBy("source").orderBy("__b").rowsBetween(W.unboundedPreceding, -1)  # at most 2**16 rows a source
    base = rows.groupBy("source", "__b").agg(F.sum(weight).alias("__n")).withColumn("__base", F.coalesce(F.sum("__n").over(by_bucket), F.lit(0)))
    inside = W.partitionBy("source", "__b").orderBy("__h", "doc_id", "n_tokens").rowsBetween(W.unboundedPreceding, -1)
    # the window has brought the rows to where this join wants them
    placed = rows.withColumn("__in", F.coalesce(F.sum(weight).over(inside), F.lit(0))).join(base.select("source", "__b", "__base"), ["source", "__b"])
    placed = placed.withColumn("__i", F.explode(F.expr(f"sequence(0L, (__m - 1) div {COPIES})")))
    placed = placed.withColumn("__i", F.explode(F.expr(f"sequence(__i * {COPIES}, least(__m, (__i + 1) * {COPIES}) - 1)"))).withColumn("__in", F.col("__in") + F.col("__i") * F.col("n_tokens"))
    placed = placed.join(sized(known, len(live)), "source").withColumn("__at", F.col("__base") + F.col("__in"))
    times = F.ceil((F.col("__taken") - F.col("__at")) / F.greatest(F.col("__all"), F.lit(1))).cast("int")
    copies = placed.filter(F.col("__at") < F.col("__taken")).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.greatest(times, F.lit(1)) - 1)))
    start = F.col("__at") + F.col("epoch").cast("bigint") * F.col("__all")
    block = F.least(F.floor(start / F.col("__block")), F.col("__quota").cast("bigint") * cycles - 1)
    turned = copies.withColumn("__k", block).withColumn("__turn", F.pmod("__k", F.col("__quota")).cast("int")).join(sized(schedule, len(laid)), ["source", "__turn"])
    position = F.expr("__k div __quota") * slots + F.col("__slot")
    return turned.select(position.cast("bigint").alias("position"), "doc_id", "source", "epoch", "n_tokens")


def share_report(mixed: DataFrame, plan: list[Share]) -> DataFrame:
    """Target and actual share of every target source, counted from the mixture.

    ``is_short``: the mixture holds fewer tokens of the source than its target
    asks for, since all its repeats are used up. Documents are never cut, so a
    source that can reach its target is never below it.
    """
    spark = mixed.sparkSession
    known = spark.createDataFrame(
        [(s.source, float(s.target), s.max_repeats, s.tokens, float(s.wanted)) for s in plan],
        "source string, target_share double, max_repeats int, available_tokens bigint, wanted_tokens double",
    )
    got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("mixed_tokens"), (F.max("epoch") + 1).alias("epochs"))
    whole = W.partitionBy()
    return (
        known.join(got, "source", "left")
        .withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0).cast("bigint")))
        .withColumn("epochs", F.coalesce("epochs", F.lit(0)))
        .withColumn("is_short", F.col("mixed_tokens") < F.col("wanted_tokens"))
        .withColumn("actual_share", F.col("mixed_tokens") / F.greatest(F.sum("mixed_tokens").over(whole), F.lit(1)))  # one row a source
    )


def share_bounds(mixed: DataFrame, documents: DataFrame, plan: list[Share]) -> DataFrame:
    """Whether every source of the mixture keeps what was promised.

    ``reaches``: it holds at least its wanted tokens, or all that its repeats
    allow. ``within``: no more than that, by more than the largest document of
    the source. ``capped``: no document comes more often than the cap allows.
    """
    largest = documents.groupBy(normal_source(F.col("source")).alias("source")).agg(F.max(byte_tokens(F.col("text"))).alias("__most"))
    known = mixed.sparkSession.createDataFrame([(s.source, s.taken, s.max_repeats, s.tokens) for s in plan], "source string, __taken double, max_repeats int, available_tokens bigint")
    got = mixed.groupBy("source").agg(F.sum("n_tokens").alias("__n"), (F.max("epoch") + 1).alias("__epochs"))
    rows = known.join(got, "source", "left").join(largest, "source", "left")
    n = F.coalesce("__n", F.lit(0))
    return rows.select(
        "source", "max_repeats", "available_tokens", (n + 1e-6 >= F.col("__taken")).alias("reaches"), (n <= F.col("__taken") + F.coalesce("__most", F.lit(0))).alias("within"),
        (F.coalesce("__epochs", F.lit(0)) <= F.col("max_repeats")).alias("capped"),
    )
