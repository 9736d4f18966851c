"""The graph as tables: current state, lookups, upserts, deletes and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowskein.functions.predicates import given, test_rank_penalty
from flowskein.operators.references import no_reference, thinned
from flowskein.session import materialize


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Upsert semantics, last write wins: the row of each key that is greatest in ``order``.

    One partial aggregation, no sort. Rows that tie in the whole order must be
    repeats; null keys group together.
    """
    rest = [c for c in rows.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("__r"))
    return best.select(*keys, *(F.col(f"__r.`{c}`").alias(c) for c in rest))


def current_nodes(*tables: DataFrame) -> DataFrame:
    """One row for each node id: its latest sighting, with '' for absent text."""
    cols = ("id", "type", "label", "service", "file", "line", "end_line", "lang", "meta", "indexed_at")
    rows = tables[0].select(*cols)
    for more in tables[1:]:
        rows = rows.unionByName(more.select(*cols))
    rows = rows.filter(F.col("id").isNotNull()).withColumns({c: given(F.col(c)) for c in ("type", "label", "service", "file", "lang")})
    rows = rows.withColumn("__class", given(F.try_element_at("meta", F.lit("class"))))
    return latest(rows, ["id"], ["indexed_at", "type", "label", "service", "file", "line", "__class"]).drop("__class")


def _edge_rows(edges: DataFrame) -> DataFrame:
    """Edge rows with both ends named, '' for absent text."""
    rows = edges.filter(F.col("id").isNotNull() & ~no_reference(F.col("src")) & ~no_reference(F.col("dst")))
    text = ("type", "label", "confidence", "http_method", "http_path", "verification_state", "verified_granularity")
    return rows.withColumns({c: given(F.col(c)) for c in text})


def _last_seen(rows: DataFrame) -> DataFrame:
    return latest(rows, ["id"], ["indexed_at", "confidence", "http_method", "verification_state", "verified_granularity", "sources"])


def current_edges(edges: DataFrame) -> DataFrame:
    """One row for each edge id with both ends named, '' for absent text."""
    return _last_seen(_edge_rows(edges))


def current_edges_where(edges: DataFrame, kept: str) -> DataFrame:
    """``current_edges`` that pass ``kept``, a row predicate in SQL.

    An id none of whose sightings passes has no current row that does, so only
    rows of the other ids (and few more: ``thinned``) are brought together.
    """
    rows = _edge_rows(edges).withColumn("__h", F.xxhash64("id"))
    wanted, _ = materialize(rows.filter(kept).select("__h").distinct(), "wanted-edges")
    return _last_seen(thinned(rows, wanted, wanted.count(), ["__h"]).drop("__h")).filter(kept)


def by_id(rows: DataFrame, key: str) -> DataFrame:
    """Point lookup: equality that reaches the scan."""
    return rows.filter(F.col("id") == key)


def edges_of(edges: DataFrame, node: str, direction: str) -> DataFrame:
    return edges.filter(F.col("src" if direction == "out" else "dst") == node)


def nodes_of_type(nodes: DataFrame, node_type: str, service: str = "", limit: int = 100) -> DataFrame:
    """Nodes of a type, production files first, then by label and id."""
    kept = nodes.filter(F.col("type") == node_type)
    kept = kept.filter(F.col("service") == service) if service else kept
    return kept.orderBy(test_rank_penalty(F.col("file")), "label", "id").limit(limit)


def replaced(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Replace-all sink: one row for each key."""
    return rows.dropDuplicates(keys)


def without_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete nodes (column ``id`` of ``gone``) and every edge that touches one."""
    left = edges.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti")
    return nodes.join(gone.select("id"), "id", "left_anti"), left.select(*edges.columns)


def page(nodes: DataFrame, edges: DataFrame, number: int, size: int = 500) -> tuple[DataFrame, DataFrame]:
    """A page of nodes by id, at most 2,000, and all edges that leave it."""
    size = min(size, 2_000)
    shown = nodes.orderBy("id").offset((number - 1) * size).limit(size)
    return shown, edges.join(F.broadcast(shown.select(F.col("id").alias("src"))), "src", "left_semi")


def kept_runs(history: DataFrame, runs: int, run: str = "run_at") -> DataFrame:
    """Rows of the newest ``runs`` distinct runs: the runs are few, the rows are not."""
    newest = history.select(run).distinct().orderBy(F.col(run).desc()).limit(runs)
    return history.join(F.broadcast(newest), run, "left_semi")


def kept_newest(rows: DataFrame, by: list[str], order: str, keep: int) -> DataFrame:
    """The newest ``keep`` rows of each group; the group's rank window, not a sort of all."""
    rank = F.row_number().over(W.partitionBy(*by).orderBy(F.col(order).desc()))
    return rows.withColumn("__rank", rank).filter(F.col("__rank") <= keep).drop("__rank")


def audit_page(calls: DataFrame, source: str = "", tool: str = "", status: str = "", offset: int = 0, limit: int = 50) -> DataFrame:
    """Log rows that match, newest first."""
    for column, value in (("source", source), ("tool", tool), ("status", status)):
        if value:
            calls = calls.filter(F.lower(F.trim(column)) == value)
    return calls.orderBy(F.col("id").desc()).offset(offset).limit(limit)


def edge_union(*parts: DataFrame) -> DataFrame:
    """Edges of several passes, one for each id: the first part that has it counts."""
    tagged = [p.withColumn("__part", F.lit(-i)) for i, p in enumerate(parts)]
    both = tagged[0]
    for part in tagged[1:]:
        both = both.unionByName(part)
    return latest(both, ["id"], ["__part", "src", "dst"]).drop("__part")
