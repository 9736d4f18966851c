"""Parent-child links to full hierarchies by tree contraction.

Rounds of leaf raking and unary-chain compression shrink the forest by a
constant factor whatever its shape; each round records what it removed, and the
records are played back in reverse to give every node its root, depth and path.
A cycle can neither be raked nor compressed away: it ends as a node that is its
own parent. Nodes travel as 128 hash bits. Once a checked number of links is
left, the same contraction is finished by one task on arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowskein.operators.skew import fragment_replicate_join
from flowskein.session import discard, materialize

#: Links that one task may finish; about 40 bytes each, without paths.
CORE_ROWS = 65_536
#: Links from which on the join of the play-back is split by load.
HUB_ROWS = 1_000_000
#: Rounds of a contraction: each removes a fixed share of the nodes, so more cannot come up.
MAX_ROUNDS = 400
KEEP, SPLICE, RAKE, CYCLE = 0, 1, 2, 3


def contract_core(child: np.ndarray, parent: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Root and depth of nodes 0..n-1 by raking and compressing in memory.

    ``parent[i]`` is the parent of ``child[i]`` at distance ``weight[i]``; a node
    is a child at most once. Root -1 and depth -1: on or below a cycle.
    """
    up = np.full(n, -1, dtype=np.int64)
    dist = np.zeros(n, dtype=np.int64)
    up[child], dist[child] = parent, weight
    rng = np.random.default_rng(7)
    live = child[parent != child]
    cyclic = np.zeros(n, dtype=bool)
    cyclic[child[parent == child]] = True
    removed: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while live.size:
        kids = np.bincount(up[live], minlength=n)
        leaf = live[kids[live] == 0]
        if leaf.size:
            removed.append((leaf, up[leaf].copy(), dist[leaf].copy()))
            live = live[kids[live] > 0]
            continue
        only = np.full(n, -1, dtype=np.int64)
        only[up[live]] = live
        rank = rng.permutation(n)
        unary = live[(kids[live] == 1)]
        x = only[unary]
        pick = unary[(rank[unary] < rank[up[unary]]) & (rank[unary] < rank[x])]
        if pick.size:
            x = only[pick]
            removed.append((pick, up[pick].copy(), dist[pick].copy()))
            dist[x] += dist[pick]
            up[x] = up[pick]
            gone = np.zeros(n, dtype=bool)
            gone[pick] = True
            live = live[~gone[live]]
        loops = live[up[live] == live]
        if loops.size:
            cyclic[loops] = True
            live = live[up[live] != live]
    root = np.arange(n, dtype=np.int64)
    depth = np.zeros(n, dtype=np.int64)
    root[cyclic], depth[cyclic] = -1, -1
    for node, above, far in reversed(removed):
        root[node] = root[above]
        depth[node] = np.where(root[above] < 0, -1, depth[above] + far)
    return root, depth


def _core_task(paths: bool):
    """Finishes a small forest; with ``paths``, the ids from the root down come along."""

    def finish(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts = list(frames)
        links = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame()
        if links.empty:
            return
        ends = np.concatenate([links[["c1", "c2"]].to_numpy(np.int64), links[["p1", "p2"]].to_numpy(np.int64)])
        names, code = np.unique(ends, axis=0, return_inverse=True)
        child, parent = np.split(code.reshape(-1), 2)
        root, depth = contract_core(child, parent, links["w"].to_numpy(np.int64), len(names))
        cyc = root[child] < 0
        at = names[np.where(cyc, 0, root[child])]
        out = pd.DataFrame({
            "c1": links["c1"], "c2": links["c2"],
            "r1": np.where(cyc, 0, at[:, 0]), "r2": np.where(cyc, 0, at[:, 1]), "depth": depth[child].astype(np.int64),
        })
        if paths:
            made: dict[int, list[str]] = {}
            known = [None] * len(links)
            for i in np.argsort(depth[child], kind="stable"):  # parents come first
                if not cyc[i]:
                    above = made[parent[i]] if parent[i] in made else [links["pid"].iat[i]]
                    known[i] = made[child[i]] = [*above, *links["via"].iat[i], links["cid"].iat[i]]
            out["path"] = known
        yield out

    return finish


def _rank(a: str, b: str, turn: int) -> Column:
    return F.xxhash64(F.lit(turn), F.col(a), F.col(b))


def _rake(links: DataFrame) -> DataFrame:
    inner = links.select(F.col("p1").alias("c1"), F.col("p2").alias("c2")).distinct().withColumn("__has", F.lit(True))
    op = F.when((F.col("c1") == F.col("p1")) & (F.col("c2") == F.col("p2")), CYCLE).when(F.col("__has").isNull(), RAKE).otherwise(KEEP)
    return links.join(inner, ["c1", "c2"], "left").withColumn("op", op).drop("__has")


def _compress(links: DataFrame, turn: int, paths: bool) -> DataFrame:
    """Splices out nodes with one child that rank below both neighbours: no two in a row."""
    more = [F.max("via").alias("xvia")] if paths else []
    below = links.groupBy(F.col("p1").alias("c1"), F.col("p2").alias("c2")).agg(
        F.count("*").alias("__k"), F.min("c1").alias("x1"), F.min("c2").alias("x2"), F.min("w").alias("xw"), *more
    )
    own = _rank("c1", "c2", turn)
    splice = (F.col("__k") == 1) & (own < _rank("p1", "p2", turn)) & (own < _rank("x1", "x2", turn))
    seen = links.join(below, ["c1", "c2"], "left").withColumn("op", F.when(splice, SPLICE).otherwise(KEEP))
    new = {"p1": F.col("p1"), "p2": F.col("p2"), "w": F.col("w") + F.col("xw")}
    if paths:
        new |= {"pid": F.col("pid"), "via": F.concat("via", F.array("cid"), "xvia")}
    moved = seen.filter(F.col("op") == SPLICE).select(F.col("x1").alias("c1"), F.col("x2").alias("c2"), *(v.alias(f"n_{k}") for k, v in new.items()))
    kept = [c for c in links.columns if c not in new and c not in ("c1", "c2")]
    return seen.join(moved, ["c1", "c2"], "left").select("c1", "c2", *kept, *(F.coalesce(f"n_{k}", k).alias(k) for k in new), "op")


def resolve_forest(links: DataFrame, core_rows: int = CORE_ROWS, paths: bool = False) -> DataFrame:
    """Root (``r1``, ``r2``) and ``depth`` of every child of hashed links.

    Input columns ``c1``, ``c2``, ``p1``, ``p2`` (bigint), each child once; with
    ``paths`` also the ids ``cid`` and ``pid``, which add ``path``. On or below a
    cycle the depth is -1, the root 0, 0 and the path null.
    """
    spark = links.sparkSession
    more = ["cid", "pid", F.expr("cast(array() as array<string>)").alias("via")] if paths else []
    live, first = materialize(links.select("c1", "c2", "p1", "p2", F.lit(1).cast("bigint").alias("w"), *more), "forest")
    records: list[tuple[DataFrame, str, int]] = []
    while (left := live.count()) > core_rows:
        turn = len(records)
        if turn >= MAX_ROUNDS:
            raise RuntimeError(f"contraction did not end: {left} links are left")
        done, path = materialize(_compress(live, turn, paths) if turn % 2 else _rake(live), f"forest-{turn}")
        if not turn:
            discard(spark, first)
        records.append((done.filter(F.col("op") != KEEP), path, left))
        live = done.filter(F.col("op") == KEEP).drop("op")
    result = "c1 bigint, c2 bigint, r1 bigint, r2 bigint, depth bigint" + ", path array<string>" * paths
    core = live.coalesce(1).mapInPandas(_core_task(paths), result)
    zero = F.lit(0).cast("bigint").alias
    on_cycle = [zero("r1"), zero("r2"), F.lit(-1).cast("bigint").alias("depth")]
    if paths:
        on_cycle.append(F.lit(None).cast("array<string>").alias("path"))
    resolved = []
    if records:
        loops, _ = materialize(_union([r.filter(F.col("op") == CYCLE).select("c1", "c2") for r, _, _ in records[::2]]), "loops")
        resolved.append(loops.select("c1", "c2", *on_cycle))
        # a node that was found to be its own parent looks like a root to the core
        core = core.join(loops.select(F.col("c1").alias("r1"), F.col("c2").alias("r2"), F.lit(True).alias("__loop")), ["r1", "r2"], "left")
        core = core.select("c1", "c2", *(F.when(F.col("__loop"), v).otherwise(F.col(k)).alias(k) for k, v in zip(("r1", "r2", "depth", "path"), on_cycle)))
    resolved.append(materialize(core, "core")[0])
    for record, path, size in reversed(records):
        known = _union(resolved).withColumnsRenamed({"c1": "p1", "c2": "p2"})
        removed = record.filter(F.col("op") != CYCLE)
        # a hub's children all ask for one parent: in a large record they are split by load, a small one is no task's burden
        rows = fragment_replicate_join(removed, known, ["p1", "p2"], spread="c1") if size > HUB_ROWS else removed.join(known, ["p1", "p2"], "left")
        deeper = F.when(F.col("depth").isNull(), F.col("w")).when(F.col("depth") < 0, F.col("depth")).otherwise(F.col("depth") + F.col("w"))
        new = [F.coalesce("r1", "p1").alias("r1"), F.coalesce("r2", "p2").alias("r2"), deeper.alias("depth")]
        if paths:
            above = F.when(F.col("depth").isNull(), F.array("pid")).otherwise(F.col("path"))
            new.append(F.concat(above, "via", F.array("cid")).alias("path"))
        resolved.append(materialize(rows.select("c1", "c2", *new), "resolved")[0])
        discard(spark, path)
    return _union(resolved)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _links(pairs: DataFrame, paths: bool = False) -> DataFrame:
    h = lambda n, s: F.xxhash64(F.lit(s), F.col("type"), F.col(n))
    ids = [F.col("child").alias("cid"), F.col("parent").alias("pid")] if paths else []
    hashed = pairs.select(h("child", 1).alias("c1"), h("child", 2).alias("c2"), h("parent", 1).alias("p1"), h("parent", 2).alias("p2"), *ids)
    above = ["p1", "p2", *(["cid", "pid"] if paths else [])]
    return hashed.groupBy("c1", "c2").agg(F.min(F.struct(*above)).alias("__p")).select("c1", "c2", *(f"__p.{c}" for c in above))


def _nodes(pairs: DataFrame) -> DataFrame:
    h = lambda s: F.xxhash64(F.lit(s), F.col("type"), F.col("node_id"))
    ends = pairs.select("type", F.explode(F.array("parent", "child")).alias("node_id"))
    known = ends.filter(F.col("type").isNotNull() & F.col("node_id").isNotNull()).distinct()
    return known.select("type", "node_id", h(1).alias("c1"), h(2).alias("c2"))


def _whole(pairs: DataFrame) -> DataFrame:
    return pairs.select("type", "parent", "child").dropna()


def hierarchy(pairs: DataFrame, core_rows: int = CORE_ROWS) -> DataFrame:
    """Root and depth of every node: ``type``, ``node_id``, ``root_id``, ``depth``.

    ``pairs``: ``type``, ``parent``, ``child`` (strings; other columns ignored),
    each type a forest of its own. Roots have depth 0. Nodes on or below a cycle
    have root '' and depth -1. Repeated pairs count once. A pair with a null end
    or type is no link; its other end is still a node. A child with several
    parents keeps the one of the lowest key hash; ``several_parents`` reports
    it with those it loses. Empty input, empty result.
    """
    resolved = resolve_forest(_links(_whole(pairs)), core_rows)
    placed = _nodes(pairs).join(resolved, ["c1", "c2"], "left")
    depth = F.coalesce("depth", F.lit(0)).cast("int").alias("depth")
    ranked, _ = materialize(placed.select("type", "node_id", F.coalesce("r1", "c1").alias("r1"), F.coalesce("r2", "c2").alias("r2"), depth), "placed")
    roots = ranked.filter(F.col("depth") == 0).select("r1", "r2", F.col("node_id").alias("root_id"))
    inner = fragment_replicate_join(ranked.filter(F.col("depth") > 0), roots, ["r1", "r2"], spread="node_id", how="inner")
    own = F.when(F.col("depth") == 0, F.col("node_id")).otherwise("")
    plain = ranked.filter(F.col("depth") <= 0).select("type", "node_id", own.alias("root_id"), "depth")
    return plain.unionByName(inner.select("type", "node_id", "root_id", "depth"))


def several_parents(pairs: DataFrame) -> DataFrame:
    """Nodes that name more than one parent, of which a hierarchy can keep one.

    ``type``, ``node_id``, ``n_parents``, and ``kept_parent``, the one that ``hierarchy`` goes by.
    """
    h = lambda s: F.xxhash64(F.lit(s), F.col("type"), F.col("parent"))
    each = _whole(pairs).groupBy("type", F.col("child").alias("node_id"), "parent").agg(F.lit(1).alias("__one"))
    least = F.min(F.struct(h(1).alias("a"), h(2).alias("b"), "parent"))
    return each.groupBy("type", "node_id").agg(F.count("*").alias("n_parents"), least["parent"].alias("kept_parent")).filter("n_parents > 1")


def hierarchy_paths(pairs: DataFrame, core_rows: int = CORE_ROWS // 8) -> DataFrame:
    """As ``hierarchy``, with ``path``: the ids from the root to the node, null on cycles.

    A path is as long as its node is deep, so the result is in its nature larger
    than the input; links carry the ids that were spliced out of them.
    """
    resolved = resolve_forest(_links(_whole(pairs), True), core_rows, True)
    placed = _nodes(pairs).join(resolved, ["c1", "c2"], "left")
    path = F.when(F.col("depth").isNull(), F.array("node_id")).otherwise(F.col("path"))
    return placed.select(
        "type", "node_id", F.when(F.col("depth") < 0, "").otherwise(F.element_at(path, 1)).alias("root_id"),
        F.coalesce("depth", F.lit(0)).cast("int").alias("depth"), path.alias("path"),
    )


def descendants(paths: DataFrame) -> DataFrame:
    """Every (ancestor, descendant) pair of ``hierarchy_paths`` with its ``distance``."""
    above = paths.filter("depth > 0").select("type", F.col("node_id").alias("descendant_id"), "depth", F.posexplode(F.expr("slice(path, 1, size(path) - 1)")).alias("__at", "node_id"))
    return above.select("type", "node_id", "descendant_id", (F.col("depth") - F.col("__at")).alias("distance"))
