"""Traversals, blast radius, and simple paths over edge tables.

Reachability is a loop of frontier joins: a level is one join of the frontier
with the edges, less what was seen. A frontier of checked size is broadcast, so
edges are only scanned; a larger one is joined by shuffle. Paths carry arrays
and are bounded by depth.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowskein.functions.predicates import is_structural
from flowskein.session import Levels, materialize

#: Rows of a frontier that may be broadcast: some 20 MB of ids.
BROADCAST_ROWS = 100_000


@dataclass(frozen=True)
class Policy:
    """Edge types that are reported but not walked on, and whether captured locals are left out."""

    terminal: tuple[str, ...] = ()
    drop_locals: bool = False


BLAST_RADIUS = Policy(drop_locals=True)
CONTAINMENT_TERMINAL = Policy(terminal=("contains", "declares"), drop_locals=True)


def traverse(edges: DataFrame, seeds: DataFrame, direction: str = "out", max_depth: int = 0, policy: Policy = Policy(), locals_: DataFrame | None = None) -> DataFrame:
    """Nodes that each seed reaches: ``root_id``, ``node_id``, ``depth``, ``via_id``, ``via_type``, ``structural``, ``terminal``.

    ``seeds`` has ``root_id`` and ``node_id``; seeds themselves are not returned.
    ``direction`` is out or in; depth 0 means no limit: levels follow until one
    finds nothing new. A node is found at its
    least depth, by the edge of the least (type, id) there; it is terminal only
    if all edges there are. ``locals_`` (``id``) names captured locals.
    """
    near, far = ("src", "dst") if direction == "out" else ("dst", "src")
    steps = edges.select(F.col(near).alias("node_id"), F.col(far).alias("next_id"), F.col("type").alias("__t"), F.col("id").alias("__e")).filter(
        F.col("node_id").isNotNull() & F.col("next_id").isNotNull()
    )
    if policy.drop_locals and locals_ is not None:
        steps = steps.join(locals_.select(F.col("id").alias("next_id")), "next_id", "left_anti")
    if max_depth != 1:
        steps, _ = materialize(steps, "steps")  # what stands behind the edges is worked out once, not once a level
    start = seeds.select("root_id", "node_id").distinct()
    found = Levels("traverse")
    first = start.select("root_id", "node_id", F.lit(0).alias("depth"), F.lit("").alias("via_id"), F.lit("").alias("via_type"), F.lit(False).alias("structural"), F.lit(False).alias("terminal"))
    rows, depth = found.add(first), 0
    while rows and (not max_depth or depth < max_depth):
        depth += 1
        frontier = found.last.filter(~F.col("terminal")).select("root_id", "node_id", "structural")
        seen = found.all().select("root_id", "node_id")
        walked = steps.join(F.broadcast(frontier) if rows <= BROADCAST_ROWS else frontier, "node_id")
        reached = walked.groupBy("root_id", F.col("next_id").alias("node_id")).agg(
            F.min(F.struct("__t", "__e", (F.col("structural") | is_structural(F.col("__t"))).alias("s"))).alias("v"),
            F.min(F.col("__t").isin(*policy.terminal) if policy.terminal else F.lit(False)).alias("terminal"),
        )
        level = reached.join(seen, ["root_id", "node_id"], "left_anti").select(
            "root_id", "node_id", F.lit(depth).alias("depth"), F.col("v.__e").alias("via_id"), F.col("v.__t").alias("via_type"), F.col("v.s").alias("structural"), "terminal"
        )
        rows = found.add(level)
    return found.all().filter("depth > 0")


def both_ways(edges: DataFrame, seeds: DataFrame, max_depth: int, policy: Policy = Policy(), locals_: DataFrame | None = None) -> DataFrame:
    """Backward hits, and forward hits that are not backward hits; ``direction`` tells."""
    back = traverse(edges, seeds, "in", max_depth, policy, locals_)
    forth = traverse(edges, seeds, "out", max_depth, policy, locals_).join(back.select("root_id", "node_id"), ["root_id", "node_id"], "left_anti")
    return back.withColumn("direction", F.lit("in")).unionByName(forth.select(*back.columns).withColumn("direction", F.lit("out")))


def best_hits(hits: DataFrame) -> DataFrame:
    """Of several roots' hits the nearest for each node, ties to the first root."""
    return hits.groupBy("node_id").agg(F.min(F.struct("depth", "root_id")).alias("b")).select("node_id", "b.depth", "b.root_id")


@dataclass(frozen=True)
class PathRule:
    """How paths grow: depth, and which edges are followed."""

    depth: int
    direction: str = "out"


def _steps(edges: DataFrame, direction: str) -> DataFrame:
    near, far = ("src", "dst") if direction == "out" else ("dst", "src")
    return edges.select(F.col(near).alias("__at"), F.col(far).alias("__next"), F.col("type").alias("__type"), F.col("id").alias("__edge"))


def simple_paths(edges: DataFrame, seeds: DataFrame, rule: PathRule) -> DataFrame:
    """All simple paths from the seeds (``node_id``) up to the depth, level by level.

    ``nodes`` and ``edge_ids`` are arrays, ``keys`` the (type, neighbour, edge)
    of each hop, ``is_leaf`` says that nothing unvisited follows or that the
    depth is reached. Exponential in its nature: bound the depth.
    """
    steps, _ = materialize(_steps(edges, rule.direction), "steps")
    level = seeds.select(
        F.array("node_id").alias("nodes"), F.expr("cast(array() as array<string>)").alias("edge_ids"), F.expr("cast(array() as array<string>)").alias("keys")
    )
    level, _ = materialize(level, "paths")
    parts: list[DataFrame] = []
    for depth in range(1, rule.depth + 1):
        last = F.element_at("nodes", -1)
        grown = level.withColumn("__at", last).join(steps, "__at").filter(~F.array_contains("nodes", F.col("__next")))
        grown = grown.select(
            F.concat("nodes", F.array("__next")).alias("nodes"),
            F.concat("edge_ids", F.array("__edge")).alias("edge_ids"),
            F.concat("keys", F.array(F.concat_ws("\u0001", "__type", "__next", "__edge"))).alias("keys"),
        )
        grown, _ = materialize(grown, f"paths-{depth}")
        if depth > 1:
            onward = grown.select(F.expr("slice(edge_ids, 1, size(edge_ids) - 1)").alias("edge_ids")).distinct().withColumn("__on", F.lit(True))
            parts.append(level.join(onward, "edge_ids", "left").select("nodes", "edge_ids", "keys", F.col("__on").isNull().alias("is_leaf")))
        level = grown
    parts.append(level.select("nodes", "edge_ids", "keys", F.lit(True).alias("is_leaf")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def leaf_chains(edges: DataFrame, seeds: DataFrame, depth: int) -> DataFrame:
    """All root-to-leaf chains with ``chain_key``, whose order is the depth-first one."""
    leaves = simple_paths(edges, seeds, PathRule(depth)).filter("is_leaf")
    return leaves.withColumn("chain_key", F.array_join("keys", "\u0002"))


def chains(edges: DataFrame, seeds: DataFrame, depth: int, show: int = 100, explore: int = 500) -> DataFrame:
    """Root-to-leaf chains in depth-first order, cut at ``explore`` and then at ``show``.

    Children come by type, neighbour and edge id, so depth-first order is the
    order of the key arrays.
    """
    return leaf_chains(edges, seeds, depth).orderBy("chain_key").limit(min(show, explore))


def shortest_paths(edges: DataFrame, source: str, target: str, k: int = 5, max_depth: int = 10) -> DataFrame:
    """The ``k`` (at most 20) shortest simple paths, ties by the sequence of edge ids.

    Paths grow a hop at a time over nodes that can still reach the target in
    the hops that are left, and end with the length at which there are ``k``.
    """
    spark, k, max_depth = edges.sparkSession, min(k, 20), min(max_depth, 50)
    schema = "nodes array<string>, edge_ids array<string>"
    if source == target:
        return spark.createDataFrame([], schema + ", hops int")
    seed = spark.createDataFrame([(target, target)], "root_id string, node_id string")
    near, _ = materialize(traverse(edges, seed, "in", max_depth).select("node_id", "depth").unionByName(seed.select("node_id", F.lit(0).alias("depth"))), "near")
    # a path that reached its target does not go on
    steps = edges.filter(F.col("src") != target).select(F.col("src").alias("__at"), F.col("dst").alias("node_id"), F.col("id").alias("__edge"))
    steps, _ = materialize(steps.join(near, "node_id"), "steps")
    ended = F.element_at("nodes", -1) == target
    grown = Levels("paths")
    rows = grown.add(spark.createDataFrame([([source], [])], schema))
    hops = 0
    while rows and hops < max_depth:
        hops += 1
        onward = grown.last.filter(~ended).withColumn("__at", F.element_at("nodes", -1)).join(steps, "__at")
        fit = ~F.array_contains("nodes", F.col("node_id")) & (F.col("depth") + hops <= max_depth)
        rows = grown.add(onward.filter(fit).select(F.concat("nodes", F.array("node_id")).alias("nodes"), F.concat("edge_ids", F.array("__edge")).alias("edge_ids")))
        if grown.all().filter(ended).limit(k).count() == k:
            break
    found = grown.all().filter(ended)
    return found.select("nodes", "edge_ids", F.size("edge_ids").alias("hops")).orderBy("hops", F.array_join("edge_ids", ",")).limit(k)


def flows_through(edges: DataFrame, entrypoints: DataFrame, target: str, depth: int = 8, limit: int = 20) -> DataFrame:
    """Chains from entry points (``node_id``) that pass the target, in depth-first order.

    Only entry points that reach the target within the depth are walked from;
    the target itself may be one.
    """
    seed = edges.sparkSession.createDataFrame([(target, target)], "root_id string, node_id string")
    behind = traverse(edges, seed, "in", depth).select("node_id").unionByName(seed.select("node_id"))
    roots, _ = materialize(entrypoints.select("node_id").join(behind, "node_id", "left_semi"), "roots")
    through = simple_paths(edges, roots, PathRule(depth)).filter("is_leaf").filter(F.array_contains("nodes", target))
    return through.withColumn("chain_key", F.array_join(F.concat(F.slice("nodes", 1, 1), "keys"), "\u0002")).orderBy("chain_key").limit(min(limit, 200))


def rolled_up(edges: DataFrame, nodes: DataFrame, most: int = 8) -> DataFrame:
    """Edges for flow walks: neighbours of one (node, type, service) above ``most`` become one ``rollup`` hop."""
    target = nodes.select(F.col("id").alias("dst"), F.col("service").alias("dst_service"))
    known = edges.join(target, "dst")
    sized = known.groupBy("src", "type", "dst_service").agg(F.count("*").alias("n"), F.min("dst").alias("least"), F.min("id").alias("least_id"))
    hubs = sized.filter(F.col("n") > most).select(
        "src", F.concat(F.lit("rollup:"), "type", F.lit(":"), "dst_service").alias("dst"), "type", F.concat(F.lit("rollup:"), "least_id").alias("id"), "n"
    )
    small = sized.filter(F.col("n") <= most).select("src", "type", "dst_service")
    single = known.join(small, ["src", "type", "dst_service"], "left_semi").select("src", "dst", "type", "id", F.lit(1).cast("bigint").alias("n"))
    return single.unionByName(hubs)


def seam_sides(edges: DataFrame, edge_id: str) -> DataFrame:
    """Producers and consumers of an edge's channel: ``side``, ``node_id``.

    The channel is all edges of its type and label, or the edge alone without label.
    """
    one = edges.filter(F.col("id") == edge_id).select("type", "label", F.col("id").alias("__id"))
    same = edges.join(F.broadcast(one), ["type", "label"]).filter((F.col("label") != "") | (F.col("id") == F.col("__id")))
    sides = F.explode(F.array(F.struct(F.lit("producer").alias("side"), F.col("src").alias("node_id")), F.struct(F.lit("consumer").alias("side"), F.col("dst").alias("node_id"))))
    return same.select(sides.alias("s")).select("s.*").distinct()


def longest_chains(edges: DataFrame, seeds: DataFrame, depth: int, direction: str) -> DataFrame:
    """The longest simple chain of each seed, ties in depth-first order."""
    paths = simple_paths(edges, seeds, PathRule(depth, direction)).withColumn("node_id", F.element_at("nodes", 1))
    order = W.partitionBy("node_id").orderBy(F.size("edge_ids").desc(), F.array_join("keys", "\u0002"))
    return paths.withColumn("__r", F.row_number().over(order)).filter("__r = 1").select("node_id", F.size("edge_ids").alias("hops"), "nodes")


def waypoints(edges: DataFrame, stops: list[str], max_depth: int = 50) -> list[str]:
    """Shortest path through all stops; raises at the first pair without one."""
    whole = stops[:1]
    for a, b in zip(stops, stops[1:]):
        row = shortest_paths(edges, a, b, 1, max_depth).first()
        if row is None:
            raise ValueError(f"no path from {a} to {b}")
        whole += row["nodes"][1:]
    return whole


def link_page(edges: DataFrame, nodes: DataFrame, node: str, direction: str = "out", depth: int = 1, offset: int = 0, limit: int = 100) -> DataFrame:
    """Linked nodes of up to three hops, by depth and id, a page at a time, with the total."""
    seeds = edges.sparkSession.createDataFrame([(node, node)], "root_id string, node_id string")
    hits = traverse(edges, seeds, direction, min(depth, 3))
    named = hits.join(nodes.select(F.col("id").alias("node_id"), "label", "service"), "node_id", "left")
    shown = named.orderBy("depth", "node_id").offset(offset).limit(min(limit, 100))
    return shown.select("node_id", "depth", "label", "service", F.lit(hits.count()).cast("bigint").alias("total"))


def within(nodes: DataFrame, edges: DataFrame, inside: DataFrame) -> DataFrame:
    """Edges of a scope (``id``): both ends inside, or one, flagged ``stub``."""
    flag = lambda side: inside.select(F.col("id").alias(side), F.lit(True).alias(f"__{side}"))
    marked = edges.join(flag("src"), "src", "left").join(flag("dst"), "dst", "left")
    held = marked.filter("__src OR __dst")
    return held.select("id", "src", "dst", "type", (F.col("__src").isNull() | F.col("__dst").isNull()).alias("stub"))


def cross_service(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are of two named services; service nodes do not count."""
    side = lambda name: nodes.filter("type <> 'service'").select(F.col("id").alias(name), F.col("service").alias(f"{name}_service"))
    both = edges.join(side("src"), "src").join(side("dst"), "dst")
    return both.filter("src_service <> dst_service AND src_service <> '' AND dst_service <> ''")

