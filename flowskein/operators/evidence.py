"""Evidence of several providers fused onto edges, and what is reported of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowskein.functions.predicates import given, is_resolution, is_runtime_verifiable
from flowskein.functions.scalars import merged_sources, verification_state, verified_granularity
from flowskein.operators.rollups import listed


def recomputed(edges: DataFrame) -> DataFrame:
    """States of all edges from all their sources, never incrementally.

    A gap whose channel (type and label) also has a verified edge is conflicting.
    """
    state = verification_state(F.col("sources"), F.col("confidence"))
    stated = edges.withColumn("sources", merged_sources(F.col("sources"))).withColumn("state", state)
    verified = stated.filter("state = 'verified' AND label <> ''").select("type", "label").distinct().withColumn("__v", F.lit(True))
    joined = stated.join(verified, ["type", "label"], "left")
    final = F.when((F.col("state") == "observed_only_gap") & F.coalesce("__v", F.lit(False)), "conflicting").otherwise(F.col("state"))
    out = joined.withColumn("state", final)
    return out.withColumn("granularity", verified_granularity(F.col("state"), F.col("sources"))).drop("__v")


def fused(static: DataFrame, evidence: DataFrame) -> DataFrame:
    """Static edges with the evidence on their channel, and gap edges for what matches none.

    ``static``: ``id``, ``src``, ``dst``, ``type``, ``label``, ``confidence``,
    ``sources``; ``evidence``: ``src``, ``dst``, ``type``, ``label``, ``source``.
    The channel is (type, label), or (type, src, dst) without label.
    """
    def channel(df: DataFrame) -> DataFrame:
        tail = F.when(given(F.col("label")) != "", F.concat(F.lit("l:"), "label")).otherwise(F.concat_ws("\u0001", F.lit("e:"), "src", "dst"))
        return df.withColumn("__ch", F.concat_ws("\u0001", "type", tail))

    rows, facts = channel(static), channel(evidence)
    # a channel that is observed very often comes down to its distinct sources before they are gathered
    once = facts.groupBy("__ch", F.col("source.provider").alias("__p"), F.col("source.ref").alias("__f")).agg(F.min("source").alias("source"))
    added = once.groupBy("__ch").agg(F.array_sort(F.collect_list("source")).alias("__add"))
    known = rows.join(added, "__ch", "left").withColumn("sources", merged_sources(F.concat("sources", F.coalesce("__add", F.expr("slice(sources, 1, 0)"))))).drop("__add", "__ch")
    loose = facts.join(rows.select("__ch").distinct(), "__ch", "left_anti")
    gap_id = F.concat(F.lit("gap:"), "type", F.lit(":"), given(F.col("label")), F.lit(":"), "src", F.lit("->"), "dst")
    ends = ["src", "dst", "type", "label"]
    single = loose.groupBy(*ends, F.col("source.provider").alias("__p"), F.col("source.ref").alias("__f")).agg(F.min("source").alias("source"))
    gaps = single.groupBy(*ends).agg(F.array_sort(F.collect_list("source")).alias("sources")).withColumn("id", gap_id).withColumn("confidence", F.lit(""))
    return known.select("id", "src", "dst", "type", "label", "confidence", "sources").unionByName(gaps.select("id", "src", "dst", "type", "label", "confidence", "sources"))


def reconcile_report(edges: DataFrame) -> DataFrame:
    """By type: edges in each state, share verified of verified and candidate, providers met."""
    n = lambda s: F.count_if(F.col("state") == s)
    providers = F.flatten(F.collect_set(F.array_distinct(F.transform("sources", lambda s: s["provider"]))))
    pct = F.round(100.0 * F.col("n_verified") / (F.col("n_verified") + F.col("n_candidate")), 4)
    grouped = edges.groupBy("type").agg(n("verified").alias("n_verified"), n("candidate").alias("n_candidate"), n("observed_only_gap").alias("n_gap"), n("conflicting").alias("n_conflicting"), providers.alias("__p"))
    return grouped.withColumn("pct_verified", F.coalesce(F.when(F.col("n_verified") + F.col("n_candidate") > 0, pct), F.lit(0.0))).withColumn(
        "providers", F.array_join(F.array_sort(F.array_distinct("__p")), ",")
    ).drop("__p")


def runtime_coverage(edges: DataFrame) -> DataFrame:
    """Edges that spans can confirm, by type: how many are, as stored."""
    kept = edges.filter(is_runtime_verifiable(F.col("type")))
    runtime = F.exists(F.coalesce("sources", F.array()), lambda s: s["provider"] == "runtime")
    return kept.groupBy("type").agg(F.count("*").alias("n_edges"), F.count_if(F.col("verification_state") == "verified").alias("n_verified"), F.count_if(runtime).alias("n_observed"))


def session_coverage(edges: DataFrame, flows: DataFrame) -> DataFrame:
    """Coverage by one session: edges whose (type, label) its flows show."""
    seen = flows.select("type", "label").distinct().withColumn("__seen", F.lit(True))
    kept = edges.filter(is_runtime_verifiable(F.col("type"))).join(seen, ["type", "label"], "left")
    return kept.groupBy("type").agg(F.count("*").alias("n_edges"), F.count_if(F.col("__seen")).alias("n_seen"))


def provider_pairs(edges: DataFrame) -> DataFrame:
    """How often each set of providers stands behind an edge."""
    providers = F.array_join(F.array_sort(F.array_distinct(F.transform(F.coalesce("sources", F.array()), lambda s: s["provider"]))), "+")
    return edges.groupBy(providers.alias("providers")).agg(F.count("*").alias("n"))


def yield_scorecard(edges: DataFrame, nodes: DataFrame, ledger: DataFrame) -> DataFrame:
    """Resolution by edge class and scope: static, runtime, external, unresolved.

    ``ledger``: ``class``, ``scope``, ``reason`` of references without edge.
    """
    for side in ("src", "dst"):
        edges = edges.join(nodes.select(F.col("id").alias(side), F.col("service").alias(f"{side}_service"), F.col("type").alias(f"{side}_type")), side)
    kept = edges.filter(is_resolution(F.col("type")))
    scope = F.when((F.col("src_service") != "") & (F.col("src_service") == F.col("dst_service")), "internal").otherwise("cross")
    kind = F.when(F.col("dst_type") == "external_service", "external").when(F.col("verification_state").isin("verified", "observed_only_gap"), "runtime").otherwise("static")
    rows = kept.select(F.col("type").alias("class"), scope.alias("scope"), kind.alias("kind")).unionByName(ledger.select("class", "scope", F.lit("unresolved").alias("kind")))
    n = lambda k: F.count_if(F.col("kind") == k)
    done = rows.groupBy("class", "scope").agg(n("static").alias("n_static"), n("runtime").alias("n_runtime"), n("external").alias("n_external"), n("unresolved").alias("n_unresolved"), F.count("*").alias("n_resolvable"))
    return done.withColumn("yield", F.round((F.col("n_resolvable") - F.col("n_unresolved")) / F.col("n_resolvable"), 6))


def yield_gate(scorecard: DataFrame) -> DataFrame:
    """Internal yield must be 1, cross-service static yield 0.95; nothing to resolve passes."""
    whole = scorecard.groupBy("scope").agg(F.sum("n_resolvable").alias("n"), F.sum(F.col("n_static") + F.col("n_external")).alias("s"), F.sum("n_runtime").alias("r"))
    reached = F.when(F.col("n") == 0, 1.0).otherwise(F.when(F.col("scope") == "internal", F.col("s") + F.col("r")).otherwise(F.col("s")) / F.col("n"))
    need = F.when(F.col("scope") == "internal", 1.0).otherwise(0.95)
    return whole.select("scope", F.round(reached, 6).alias("reached"), (reached >= need - 1e-9).alias("pass"))


def cleared(ledger: DataFrame, claims: DataFrame, keys: tuple[str, ...] = ("service", "file", "line", "name")) -> DataFrame:
    """Ledger rows that no provider claims."""
    return ledger.join(claims.select(*keys).distinct(), list(keys), "left_anti")


def retracted(ledger: DataFrame, edges: DataFrame, nodes: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Ledger rows less those of retractable kinds that an edge bears out.

    ``kinds`` maps a ledger kind to the edge type that settles it: from the
    ledger's service and file to a node of the ledger's name.
    """
    a = nodes.select(F.col("id").alias("src"), F.col("service").alias("service"), F.col("file").alias("file"))
    b = nodes.select(F.col("id").alias("dst"), F.col("label").alias("name"))
    kind = F.create_map(*(F.lit(x) for pair in ((t, k) for k, t in kinds.items()) for x in pair))
    seen = edges.join(a, "src").join(b, "dst").withColumn("kind", F.element_at(kind, F.col("type"))).filter("kind IS NOT NULL").select("service", "file", "name", "kind").distinct()
    return ledger.join(seen, ["service", "file", "name", "kind"], "left_anti")


def proposals(edges: DataFrame) -> DataFrame:
    """Gaps by type and channel: a rule to write for each, with its ends."""
    gaps = edges.filter("state IN ('observed_only_gap', 'conflicting') AND label <> ''")
    return gaps.groupBy("type", "label").agg(F.countDistinct("src").alias("n_from"), F.countDistinct("dst").alias("n_to"), F.count("*").alias("n_edges"))


def verdict(n_unresolved: Column, dynamic: Column, n_candidate: Column, n_stale: Column, n_gap: Column, n_conflicting: Column) -> Column:
    """Causes that make an answer a lower bound, sorted and joined; '' for an exact one."""
    causes = F.array_compact(F.array(
        F.when(n_unresolved > 0, F.lit("unresolved_refs")), F.when(dynamic, F.lit("dynamic_dispatch")), F.when(n_candidate > 0, F.lit("candidate_edges")),
        F.when(n_stale > 0, F.lit("stale_evidence")), F.when(n_gap > 0, F.lit("observed_gaps")), F.when(n_conflicting > 0, F.lit("conflicting_evidence")),
    ))
    return F.array_join(F.array_sort(causes), ",")


def per_type_top(rows: DataFrame, group: str | list[str], order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= k)


def edge_sources(edges: DataFrame) -> DataFrame:
    """One row for each source of each edge."""
    return edges.select(F.col("id").alias("edge_id"), "type", F.explode("sources").alias("s")).select("edge_id", "type", "s.*")


def provider_files(edges: DataFrame) -> DataFrame:
    """Files that each provider's sources name, and how many edges they back."""
    rows = edge_sources(edges).withColumn("file", F.regexp_replace(given(F.col("ref")), r":[0-9]+$", ""))
    return rows.filter("file <> ''").groupBy("provider", "file").agg(F.countDistinct("edge_id").alias("n_edges"), listed("type").alias("types"))


#: A provider of evidence: what it makes of the session's inputs, as ``src``, ``dst``, ``type``, ``label``, ``source``.
Provider = Callable[[dict[str, DataFrame]], DataFrame]
PROVIDERS = ("runtime", "contract", "config")


def collected(providers: dict[str, Provider], inputs: dict[str, DataFrame]) -> tuple[DataFrame | None, DataFrame | None, dict[str, str]]:
    """Evidence of all providers as one table, their claims on ledger rows, and what went wrong by provider.

    A provider is a function of the named input tables that gives evidence, or
    evidence and claims (``service``, ``file``, ``line``, ``name``). One that
    fails while it builds its plan is reported and does not stop the others;
    names must be among ``PROVIDERS``; their sources must bear their name.
    """
    evidence, claims, problems = None, None, {}
    for name, provide in sorted(providers.items()):
        if name not in PROVIDERS:
            raise ValueError(f"unknown provider {name!r}")
        try:
            made = provide(inputs)
        except Exception as e:  # one provider must not end the others' work
            problems[name] = f"{type(e).__name__}: {e}"[:200]
            continue
        own, claimed = made if isinstance(made, tuple) else (made, None)
        own = own.select("src", "dst", "type", "label", "source").filter(F.col("source.provider") == name)
        evidence = own if evidence is None else evidence.unionByName(own)
        if claimed is not None:
            rows = claimed.select("service", "file", "line", "name")
            claims = rows if claims is None else claims.unionByName(rows)
    return evidence, claims, problems
