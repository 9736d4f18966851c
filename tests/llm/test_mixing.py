import random

import pytest

from flowskein.llm import mixing


@pytest.mark.parametrize("weights", [[1], [5, 3, 2], [0.22, 0.15, 0.12, 0.08, 0.1, 0.13, 0.1, 0.06, 0.03, 0.01], [997, 1, 1, 1], [0.9] + 400 * [0.00025], [0.5, 1e-9, 0.3]])
def test_schedule_deviates_less_than_a_block(weights):
    quotas = mixing.quotas(weights, 1_000)
    assert sum(quotas) == 1_000
    slots = mixing.edf_slots(quotas)
    assert sorted(s for own in slots for s in own) == list(range(sum(quotas)))
    for q, own in zip(quotas, slots):
        for k, slot in enumerate(own):
            assert k * sum(quotas) // q <= slot < -(-(k + 1) * sum(quotas) // q)


def test_mixture_meets_shares_and_caps(spark):
    r = random.Random(2)
    docs = [(i, "x" * r.randrange(1, 60), r.choice(["Big ", "big", "big", "small", None, " "])) for i in range(3_000)]
    documents = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("big", 0.5, 1), ("small", 0.4, 3), ("absent", 0.1, 2)], "source string, target_share double, max_repeats int")
    plan = mixing.shares(documents, targets)
    mixed = mixing.mixture(documents, plan)
    report = {x["source"]: x for x in mixing.share_report(mixed, plan).collect()}
    total = sum(len(t) for _, t, s in docs if s and s.strip())
    small = sum(len(t) for _, t, s in docs if s == "small")
    assert report["absent"]["is_short"] and report["absent"]["mixed_tokens"] == 0 and not report["big"]["is_short"]
    assert {s.source: s.short for s in plan} == {name: row["is_short"] for name, row in report.items()}
    assert abs(report["big"]["mixed_tokens"] - 0.5 * total) <= 60
    assert abs(report["small"]["mixed_tokens"] - min(0.4 * total, 3 * small)) <= 60
    copies = mixed.groupBy("doc_id", "source").count().collect()
    assert max(c["count"] for c in copies if c["source"] == "small") <= 3 and max(c["count"] for c in copies if c["source"] == "big") == 1
    assert all(x["reaches"] and x["within"] and x["capped"] for x in mixing.share_bounds(mixed, documents, plan).collect())


def test_empty(spark):
    documents = spark.createDataFrame([], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("big", 1.0, 1)], "source string, target_share double, max_repeats int")
    plan = mixing.shares(documents, targets)
    assert mixing.mixture(documents, plan).count() == 0 and not plan[0].short
    assert mixing.shares(documents, targets.limit(0)) == []


def deviations(spark, docs, targets, monkeypatch, block):
    """Largest distance, in blocks, of a source's tokens from its share of the slots so far, over all prefixes of the mixture."""
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", block)
    documents = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    plan = mixing.shares(documents, spark.createDataFrame(targets, "source string, target_share double, max_repeats int"))
    live = [s for s in plan if s.taken > 0]
    slots = mixing.cycle_slots([s.taken for s in live])
    quota = dict(zip((s.source for s in live), mixing.quotas([s.taken for s in live], slots)))
    taken = sum(s.taken for s in live)
    cycles = max(1, -(-taken // (slots * block)))
    rows = [tuple(r) for r in mixing.mixture(documents, plan).select("source", "position", "n_tokens").collect()]
    last = max(p for _, p, _ in rows)
    assert last < slots * cycles
    worst = 0.0
    for s in live:
        own = s.taken / (quota[s.source] * cycles)
        got = [0] * (last + 1)
        for name, p, n in rows:
            got[p] += n * (name == s.source)
        total = 0
        most = max(n for name, _, n in rows if name == s.source)
        for p, n in enumerate(got):
            total += n
            worst = max(worst, (abs(total - (p + 1) * quota[s.source] / slots * own) - most) / own)
    return worst, len(live)


def test_mixture_stays_within_a_block(spark, monkeypatch):
    r = random.Random(3)
    names = ["a"] * 6 + ["b"] * 3 + ["c"]
    docs = [(i, "x" * r.randrange(1, 40), r.choice(names)) for i in range(6_000)]
    worst, _ = deviations(spark, docs, [("a", 0.6, 2), ("b", 0.31, 2), ("c", 0.09, 2)], monkeypatch, 100)
    assert worst < 1.0
    assert mixing.cycle_slots([0.6, 0.31, 0.09]) == 1_000


def test_many_small_sources(spark, monkeypatch):
    """More sources than slots of an ordinary cycle, each far below a slot: none is refused, none overlaps the next cycle."""
    r = random.Random(4)
    docs = [(i, "x" * r.randrange(1, 30), "big" if i % 2 else f"s{i % 1_201}") for i in range(12_000)]
    targets = [("big", 0.7, 3), *((f"s{k}", 0.3 / 1_201, 4) for k in range(1_201))]
    worst, live = deviations(spark, docs, targets, monkeypatch, 50)
    assert live == 1_202 and worst < 1.0


def test_repeated_rows_have_places_of_their_own(spark, monkeypatch):
    docs = [(1, "x" * 10, "a")] * 900 + [(i, "y" * 10, "a") for i in range(2, 102)] + [(i, "z" * 10, "b") for i in range(200, 1_200)]
    worst, live = deviations(spark, docs, [("a", 0.5, 1), ("b", 0.5, 1)], monkeypatch, 10)
    assert live == 2 and worst < 1.0
    documents = spark.createDataFrame(docs, "doc_id bigint, text string, source string")
    plan = mixing.shares(documents, spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], "source string, target_share double, max_repeats int"))
    mixed = mixing.mixture(documents, plan)
    assert mixed.filter("doc_id = 1").count() == 900 and mixed.filter("doc_id = 1").select("position").distinct().count() == 900
