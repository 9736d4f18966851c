"""Aggregates over the graph: stacks, files, channels, outlines and views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowskein.functions.predicates import base_name, entrypoint_kind, is_flow, is_structural, meta, skipped_root_kind, verification_rank, worst_first_rank
from flowskein.functions.scalars import is_stale

#: Seed files up to which they are broadcast.
SEED_ROWS = 50_000
STATE_OF_RANK = ("verified", "observed_only_gap", "candidate", "conflicting", "")


def state_of_rank(rank: Column) -> Column:
    return F.element_at(F.array(*(F.lit(s) for s in STATE_OF_RANK)), rank + 1)


def listed(column: str | Column) -> Column:
    """Distinct values as one sorted, comma-separated text."""
    return F.array_join(F.array_sort(F.collect_set(column)), ",")


def _sided(edges: DataFrame, nodes: DataFrame, *fields: str) -> DataFrame:
    """Edges with fields of both end nodes as ``src_<field>`` and ``dst_<field>``; ends must exist.

    Inner joins whose hot side is the edges: a hub's partition is split by
    adaptive execution, as nothing downstream asks for its partitioning.
    """
    for side in ("src", "dst"):
        edges = edges.join(nodes.select(F.col("id").alias(side), *(F.col(f).alias(f"{side}_{f}") for f in fields)), side)
    return edges


def stack_profile(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Per service: nodes, edges by source service, files, and majority language (ties to the first by name)."""
    per_lang = nodes.filter("lang <> ''").groupBy("service", "lang").agg(F.count("*").alias("n"))
    lang = per_lang.groupBy("service").agg(F.min(F.struct((-F.col("n")).alias("n"), "lang"))["lang"].alias("language"))
    own = nodes.groupBy("service").agg(F.count("*").alias("n_nodes"), F.countDistinct(F.when(F.col("file") != "", F.col("file"))).alias("n_files"), F.countDistinct("type").alias("n_types"))
    out = edges.join(nodes.select(F.col("id").alias("src"), "service"), "src").groupBy("service").agg(F.count("*").alias("n_edges"))
    joined = own.join(lang, "service", "left").join(out, "service", "left")
    return joined.select("service", "n_nodes", "n_files", "n_types", F.coalesce("language", F.lit("")).alias("language"), F.coalesce("n_edges", F.lit(0)).cast("bigint").alias("n_edges"))


def type_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Rows by service and type: of nodes, and of edges by the service they leave."""
    left = nodes.groupBy("service", "type").agg(F.count("*").alias("n")).withColumn("what", F.lit("node"))
    right = edges.join(nodes.select(F.col("id").alias("src"), "service"), "src").groupBy("service", "type").agg(F.count("*").alias("n"))
    return left.unionByName(right.withColumn("what", F.lit("edge")))


def files(nodes: DataFrame, q: str = "") -> DataFrame:
    """Files with their nodes and the types in them."""
    kept = nodes.filter(F.col("file") != "")
    kept = kept.filter(F.lower("file").contains(q.lower())) if q else kept
    return kept.groupBy("service", "file").agg(F.count("*").alias("n_nodes"), listed("type").alias("types"))


def file_impact(hits: DataFrame, nodes: DataFrame, seed_files: DataFrame | None = None) -> DataFrame:
    """Traversal hits per file: nodes, least depth, edge types; seed files do not count."""
    named = hits.join(nodes.select(F.col("id").alias("node_id"), "service", "file"), "node_id").filter("file <> ''")
    if seed_files is not None:
        named = named.join(seed_files, ["service", "file"], "left_anti")
    return named.groupBy("service", "file").agg(
        F.countDistinct("node_id").alias("n_nodes"), F.min("depth").cast("bigint").alias("min_depth"), F.min(F.col("structural").cast("int")).cast("bigint").alias("only_structural")
    )


def related_files(edges: DataFrame, nodes: DataFrame, seed_files: DataFrame) -> DataFrame:
    """Files that share edges with the seed files, in either direction, with the best state met."""
    both = _sided(edges, nodes, "service", "file")
    out = both.select("id", "type", "verification_state", F.struct(F.col("src_service").alias("service"), F.col("src_file").alias("file")).alias("a"), F.struct(F.col("dst_service").alias("service"), F.col("dst_file").alias("file")).alias("b"))
    pairs = out.select("id", "type", "verification_state", F.explode(F.array(F.struct(F.col("a").alias("s"), F.col("b").alias("o")), F.struct(F.col("b").alias("s"), F.col("a").alias("o")))).alias("p"))
    flat = pairs.select("id", "type", "verification_state", F.col("p.s.service").alias("service"), F.col("p.s.file").alias("file"), F.col("p.o.service").alias("other_service"), F.col("p.o.file").alias("other_file"))
    seeds = seed_files.select("service", "file").distinct()
    sized = F.broadcast if seeds.limit(SEED_ROWS + 1).count() <= SEED_ROWS else (lambda df: df)
    near = flat.join(sized(seeds), ["service", "file"], "left_semi").filter("other_file <> ''")
    apart = near.join(sized(seeds.withColumnsRenamed({"service": "other_service", "file": "other_file"})), ["other_service", "other_file"], "left_anti")
    return apart.groupBy(F.col("other_service").alias("service"), F.col("other_file").alias("file")).agg(
        F.countDistinct("id").alias("n_refs"), listed("type").alias("edge_types"), state_of_rank(F.min(verification_rank(F.col("verification_state")))).alias("best_state")
    )


def entry_points_hit(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """Hits that no edge enters."""
    return hits.join(edges.select(F.col("dst").alias("node_id")), "node_id", "left_anti")


def verification_summary(edges: DataFrame, now: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """Edges by state, and stale ones, as of ``now`` (unix seconds)."""
    state = F.col("verification_state")
    count = lambda c: F.count_if(c)
    return edges.groupBy(*by).agg(
        count(state == "verified").alias("n_verified"), count(state == "candidate").alias("n_candidate"), count(state == "observed_only_gap").alias("n_gap"),
        count(state == "conflicting").alias("n_conflicting"), count(is_stale(state, F.col("sources"), now)).alias("n_stale"),
    )


def service_channels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Channels between services: by pair, type and identity (label, else the edge itself)."""
    both = _sided(edges, nodes, "service").filter("src_service <> dst_service AND src_service <> '' AND dst_service <> ''").filter(~is_structural(F.col("type")))
    identity = F.when(F.col("label") != "", F.col("label")).otherwise(F.col("dst"))
    worst = F.element_at(F.array(*(F.lit(s) for s in ("observed_only_gap", "conflicting", "candidate", "verified"))), F.min(worst_first_rank(F.col("verification_state"))) + 1)
    return both.groupBy("src_service", "dst_service", "type", identity.alias("channel")).agg(
        F.min("id").alias("edge_id"), worst.alias("worst_state"), F.countDistinct("src").alias("n_producers"), F.countDistinct("dst").alias("n_consumers"), F.count("*").alias("n_edges")
    )


def service_view(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row for each unordered pair of services: edges, types, forward and backward counts."""
    both = _sided(edges, nodes, "service").filter("src_service <> dst_service AND src_service <> '' AND dst_service <> ''")
    a, b = F.least("src_service", "dst_service"), F.greatest("src_service", "dst_service")
    return both.groupBy(a.alias("service_a"), b.alias("service_b")).agg(
        F.count("*").alias("n_edges"), listed("type").alias("types"), F.count_if(F.col("src_service") == a).alias("n_forward"), F.count_if(F.col("src_service") == b).alias("n_backward")
    )


def folded_files(edges: DataFrame, nodes: DataFrame, folded: DataFrame) -> DataFrame:
    """Edges after the files of ``folded`` (``service``, ``file``) became one node each: no inner ones, none twice."""
    into = nodes.join(folded, ["service", "file"], "left_semi").select("id", F.concat("service", F.lit(":"), "file", F.lit(":group")).alias("__to"))
    for side in ("src", "dst"):
        edges = edges.join(into.withColumnsRenamed({"id": side, "__to": f"__{side}"}), side, "left").withColumn(side, F.coalesce(f"__{side}", side)).drop(f"__{side}")
    return edges.filter("src <> dst").select("src", "dst", "type").distinct()


def contract_coverage(edges: DataFrame) -> DataFrame:
    """Channel edges by type: matched, and unresolved (confidence unknown)."""
    return edges.filter("label <> ''").groupBy("type").agg(F.count_if(F.col("confidence") != "unknown").alias("n_matched"), F.count_if(F.col("confidence") == "unknown").alias("n_unresolved"))


def cross_links(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges in all and across services, by type."""
    both = _sided(edges, nodes, "service")
    return both.groupBy("type").agg(F.count("*").alias("total"), F.count_if(F.col("src_service") != F.col("dst_service")).alias("across"))


def entrypoints(nodes: DataFrame) -> DataFrame:
    """Entry points with their kind."""
    kind = entrypoint_kind(F.col("type"), meta("meta", "root_kind"))
    return nodes.withColumn("kind", kind).filter("kind IS NOT NULL").select(F.col("id").alias("node_id"), "kind", "label", "service", "file", "line")


def skipped_roots(nodes: DataFrame) -> DataFrame:
    """Functions that are roots of another kind, counted."""
    kind = skipped_root_kind(F.col("type"), meta("meta", "root_kind"))
    return nodes.select(kind.alias("root_kind")).filter("root_kind IS NOT NULL").groupBy("root_kind").agg(F.count("*").alias("n"))


def root_classes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Functions and methods that only containment enters: entrypoint, callback (referenced) or unreachable."""
    called = edges.filter("type <> 'contains'").select(F.col("dst").alias("id")).distinct()
    named = edges.filter("type IN ('reads', 'uses_type', 'imports')").select(F.col("dst").alias("id")).distinct().withColumn("__ref", F.lit(True))
    roots = nodes.filter("type IN ('function', 'method')").join(called, "id", "left_anti").join(named, "id", "left")
    kind = F.when(F.col("label").isin("main", "init", "(module)"), "entrypoint").when(F.col("__ref"), "callback").otherwise("unreachable")
    return roots.select("id", "label", kind.alias("root_kind"))


def dead_ends(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Entry points that no flow edge leaves."""
    onward = edges.filter(is_flow(F.col("type"))).select(F.col("src").alias("node_id"))
    return entrypoints(nodes).join(onward, "node_id", "left_anti").select("node_id", "kind")


def variable_flow(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Readers, writers and captors of variables, and where they flow."""
    variables = nodes.filter("type = 'variable'").select("id")
    inward = edges.filter("type IN ('reads', 'writes', 'captures')").select(F.col("dst").alias("id"), "type", F.col("src").alias("other"))
    outward = edges.filter("type = 'flows_to'").select(F.col("src").alias("id"), "type", F.col("dst").alias("other"))
    rows = inward.unionByName(outward).join(variables, "id", "left_semi")
    count = lambda t: F.countDistinct(F.when(F.col("type") == t, F.col("other")))
    return rows.groupBy("id").agg(count("reads").alias("n_readers"), count("writes").alias("n_writers"), count("captures").alias("n_captors"), count("flows_to").alias("n_targets"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """In- and out-edges of every node."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("e")).select("e.*")
    sums = ends.groupBy("id").agg(F.sum("i").alias("n_in"), F.sum("o").alias("n_out"))
    return nodes.select("id").join(sums, "id", "left").select("id", F.coalesce("n_in", F.lit(0)).alias("n_in"), F.coalesce("n_out", F.lit(0)).alias("n_out"))


def neighbours(nodes: DataFrame, edges: DataFrame, node: str) -> DataFrame:
    """Edges of a node in both directions, with the columns of the node at the other end: ``direction``, ``type``, ``other``, ``label``, ``service``, ``file``."""
    side = lambda own, far, way: edges.filter(F.col(own) == node).select(F.lit(way).alias("direction"), "type", F.col(far).alias("other"))
    both = side("src", "dst", "out").unionByName(side("dst", "src", "in"))
    return both.join(nodes.select(F.col("id").alias("other"), "label", "service", "file"), "other", "left")


def filtered(nodes: DataFrame, edges: DataFrame, types: list[str], services: list[str], edge_types: list[str], states: list[str]) -> tuple[DataFrame, DataFrame]:
    """What a view shows: nodes of the types and services, and edges of the types and states between them; an empty list is no filter."""
    def within(df: DataFrame, column: str, values: list[str]) -> DataFrame:
        return df.filter(F.col(column).isin(*values)) if values else df

    shown = within(within(nodes, "type", types), "service", services)
    kept = within(within(edges, "type", edge_types), "verification_state", states)
    ids = shown.select("id")
    return shown, kept.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def outline(nodes: DataFrame) -> DataFrame:
    """Folders of every service, all levels, with the files and nodes below them.

    A path's prefixes are exploded once; no recursion.
    """
    parts = F.split("file", "/")
    depth = F.explode(F.sequence(F.lit(1), F.size(parts) - 1))
    inner = nodes.filter(F.col("file").contains("/")).select("service", "file", "id", parts.alias("p"), depth.alias("depth"))
    folder = F.array_join(F.slice("p", 1, F.col("depth")), "/")
    rows = inner.select("service", folder.alias("folder"), F.col("depth").cast("bigint").alias("depth"), "file", "id")
    return rows.groupBy("service", "folder", "depth").agg(F.countDistinct("file").alias("n_files"), F.count("id").alias("n_nodes"))


def hierarchy_levels(nodes: DataFrame) -> DataFrame:
    """Service, folder and file levels with their direct children."""
    folder = F.when(F.col("file").contains("/"), F.regexp_replace("file", "/[^/]*$", "")).otherwise("")
    held = nodes.filter("file <> ''").select("service", folder.alias("folder"), "file", "id")
    level = lambda name, key, child: held.groupBy("service", key.alias("name")).agg(F.countDistinct(child).alias("n_children")).withColumn("level", F.lit(name))
    return level("service", F.col("service"), "folder").unionByName(level("folder", F.col("folder"), "file")).unionByName(level("file", F.col("file"), "id"))


def unparsed(files: DataFrame, known: tuple[str, ...]) -> DataFrame:
    """Files of unknown extensions: total, and the first three extensions by name."""
    ext = F.regexp_extract(base_name(F.col("file")), r"\.([^.]+)$", 1)
    rest = files.select("file", ext.alias("ext")).filter(~F.col("ext").isin(*known))
    return rest.agg(F.countDistinct("file").alias("n_files"), F.array_join(F.slice(F.array_sort(F.collect_set("ext")), 1, 3), ",").alias("first_exts"))


def channel_roles(rows: DataFrame, by: list[str]) -> DataFrame:
    """Roles of a channel merged: producer and consumer make both; '' adds nothing."""
    roles = F.collect_set(F.when(F.col("role") != "", F.col("role")))
    merged = F.when(F.array_contains("__r", "both") | (F.size("__r") > 1), "both").otherwise(F.coalesce(F.try_element_at("__r", F.lit(1)), F.lit("")))
    return rows.groupBy(*by).agg(roles.alias("__r")).select(*by, merged.alias("role"))


def health(nodes: DataFrame, edges: DataFrame, ledger: DataFrame) -> DataFrame:
    """Counts of nodes, of edges by state, and of the ledger by kind: ``what``, ``kind``, ``n``."""
    count = lambda df, what, kind: df.groupBy(kind.alias("kind")).agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "kind", "n")
    return count(nodes, "nodes", F.lit("")).unionByName(count(edges, "edges", F.col("verification_state"))).unionByName(count(ledger, "ledger", F.col("kind")))


def ledger_rows(ledger: DataFrame, service: str = "", kind: str = "", q: str = "") -> DataFrame:
    """Ledger rows (``service``, ``file``, ``name``, ``kind``) by service, kind, and a text in name or file."""
    for column, value in (("service", service), ("kind", kind)):
        ledger = ledger.filter(F.col(column) == value) if value else ledger
    return ledger.filter(F.lower("name").contains(q.lower()) | F.lower("file").contains(q.lower())) if q else ledger
