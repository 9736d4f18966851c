"""Answers composed of other operators: context, investigation, chains for search, doctors."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowskein.functions import scalars as S
from flowskein.functions.predicates import given, is_structural, passes_verification
from flowskein.operators import contracts, rollups, search
from flowskein.operators import traversal as T
from flowskein.session import materialize


def context(nodes: DataFrame, edges: DataFrame, target: str, task: str = "", depth: int = 2) -> DataFrame:
    """Neighbourhood of a node: up for impact, down for generate, else both; with the nodes' columns."""
    seeds = edges.sparkSession.createDataFrame([(target, target)], "root_id string, node_id string")
    if task == "impact":
        hits = T.traverse(edges, seeds, "in", depth).withColumn("direction", F.lit("in"))
    elif task == "generate":
        hits = T.traverse(edges, seeds, "out", depth).withColumn("direction", F.lit("out"))
    else:
        hits = T.both_ways(edges, seeds, depth)
    return hits.join(nodes.select(F.col("id").alias("node_id"), "label", "type", "service", "file", "line"), "node_id", "left")


def investigate(nodes: DataFrame, edges: DataFrame, query: str, flows: int = 5, depth: int = 6) -> dict:
    """Target, its neighbourhood, and the first flows through it with the state of their weakest hop.

    A driver-side answer: every part of it is cut to what one answer shows, and
    ``totals`` says how many there are of each.
    """
    named = search.resolve_target(nodes, query)
    candidates = named.orderBy("pick").limit(4).collect()
    if not candidates:
        return {"target": None, "candidates": [], "context": [], "flows": [], "totals": {"candidates": 0, "context": 0, "flows": 0}}
    target = candidates[0]["id"]
    around, _ = materialize(context(nodes, edges, target, depth=3), "around")
    near = around.orderBy("depth", "node_id").limit(200).collect()
    seeds = edges.sparkSession.createDataFrame([(target,)], "node_id string")
    leaves, _ = materialize(T.leaf_chains(T.rolled_up(edges.filter("type NOT IN ('contains', 'declares')"), nodes), seeds, depth), "flows")
    flow = leaves.orderBy("chain_key").limit(flows)
    rank = F.when(F.col("verification_state") == "verified", 3).when(F.col("verification_state") == "observed_only_gap", 2).otherwise(1)
    hops = flow.select("chain_key", "nodes", F.explode("edge_ids").alias("id")).join(edges.select("id", rank.alias("r")), "id", "left")
    weakest = hops.groupBy("chain_key", "nodes").agg(F.min(F.coalesce("r", F.lit(0))).alias("r")).orderBy("chain_key").collect()
    names = ("rollup", "candidate", "observed_only_gap", "verified")
    return {
        "target": target, "candidates": [c["id"] for c in candidates[1:]], "context": [(r["node_id"], r["depth"]) for r in near],
        "flows": [(r["nodes"], names[r["r"]]) for r in weakest], "totals": {"candidates": named.count() - 1, "context": around.count(), "flows": leaves.count()},
    }


def symbol_context(nodes: DataFrame, edges: DataFrame, term: str) -> DataFrame:
    """Up to three nodes of that label, else two that contain it, with a few callers and callees each."""
    exact = nodes.filter(F.lower("label") == term.lower()).orderBy("id").limit(3)
    hits = exact if exact.limit(1).count() else nodes.filter(F.lower("label").contains(term.lower())).orderBy("id").limit(2)
    ids = hits.select("id")
    calls = edges.filter("type = 'calls'")
    up = calls.join(F.broadcast(ids.withColumnRenamed("id", "dst")), "dst").select(F.col("dst").alias("id"), F.col("src").alias("other"), F.lit("caller").alias("role"))
    down = calls.join(F.broadcast(ids.withColumnRenamed("id", "src")), "src").select(F.col("src").alias("id"), F.col("dst").alias("other"), F.lit("callee").alias("role"))
    rank = F.row_number().over(W.partitionBy("id", "role").orderBy("other"))
    return up.unionByName(down).withColumn("rank", rank).filter("rank <= 4")


def symbol_text(nodes: DataFrame, files: DataFrame) -> DataFrame:
    """Source of each node (``id``, ``service``, ``file``, ``line``, ``end_line``): its lines of the file's ``text``, one if its end is unknown.

    Nodes whose file is not there have null source.
    """
    n = F.greatest(F.col("end_line") - F.col("line") + 1, F.lit(1))
    joined = nodes.join(files.select("service", "file", "text"), ["service", "file"], "left")
    return joined.select("id", F.array_join(F.slice(F.split("text", "\n"), F.greatest("line", F.lit(1)), n), "\n").alias("source"))


def verified_chains(paths: DataFrame, edges: DataFrame, least: str) -> DataFrame:
    """Chains of which every hop passes the least verification."""
    bad = edges.filter(~passes_verification(F.col("verification_state"), least)).select("id")
    failing = paths.select("keys", F.explode("edge_ids").alias("id")).join(bad, "id", "left_semi").select("keys").distinct()
    return paths.join(failing, "keys", "left_anti")


def launch_prefix(edges: DataFrame, node: str, hops: int = 6) -> list[str]:
    """How a worker is reached: at each hop the non-structural in-edge of the least source, at most six."""
    path = [node]
    for _ in range(hops):
        row = edges.filter((F.col("dst") == path[0]) & ~is_structural(F.col("type")) & ~F.col("src").isin(path)).agg(F.min("src").alias("src")).first()
        if row["src"] is None:
            break
        path.insert(0, row["src"])
    return path


def chain_entities(nodes: DataFrame, edges: DataFrame, starts: DataFrame, depth: int = 12) -> DataFrame:
    """Forward chains from entry points as search entities: id by member hash, text by labels, members once."""
    leaves = T.simple_paths(edges, starts, T.PathRule(depth)).filter("is_leaf").select("nodes").distinct()
    members = leaves.select(F.col("nodes").alias("members"), F.posexplode("nodes").alias("at", "id")).join(nodes.select("id", "label"), "id", "left")
    text = members.groupBy("members").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "label"))), lambda x: given(x["label"])), " ").alias("text"))
    digest = F.substring(F.sha2(F.array_join("members", "\u0001"), 256), 1, 12)
    return text.select(F.concat(F.lit("chain:"), F.get("members", F.lit(0)), F.lit(":"), digest).alias("entity_id"), F.lit("flow").alias("type"), "text", "members")


def node_cards(nodes: DataFrame) -> DataFrame:
    """Search entities of nodes with their content hash."""
    text = S.card_text(F.col("label"), F.col("type"), F.col("service"), F.col("file"), F.array_join(F.map_values("meta"), " "))
    return nodes.select(F.col("id").alias("entity_id"), F.lit("node").alias("type"), text.alias("text")).withColumn("content_hash", S.content_hash(F.col("text")))


def rendered(paths: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Chains as one line each: places and labels, edge types between, ``?`` for uncertain matches, bars where the service changes."""
    hop = paths.select("keys", "nodes", "edge_ids", F.posexplode("nodes").alias("at", "id"))
    hop = hop.withColumn("edge_id", F.get("edge_ids", F.col("at") - 1)).join(nodes.select("id", "label", "service", "file", "line"), "id", "left")
    hop = hop.join(edges.select(F.col("id").alias("edge_id"), F.col("type").alias("via"), "confidence"), "edge_id", "left")
    place = F.concat(F.lit("("), given(F.col("service")), F.lit(") "), given(F.col("file")), F.lit(":"), F.coalesce("line", F.lit(0)).cast("string"), F.lit(" "), given(F.col("label")))
    arrow = F.when(F.col("at") == 0, "").otherwise(F.concat(F.lit(" -["), given(F.col("via")), F.when(F.col("confidence").isin("partial", "unknown"), "?").otherwise(""), F.lit("]-> ")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("at", F.concat(arrow, place).alias("s")))), lambda x: x["s"])
    return hop.groupBy("keys").agg(F.array_join(parts, "").alias("line"))


def inherited(calls: DataFrame, parents: DataFrame, methods: DataFrame, depth: int = 0) -> DataFrame:
    """Method of a call by the class and then what it inherits, however far up (or up to ``depth``): all definitions at the nearest distance.

    ``calls``: ``id``, ``class``, ``name``; ``parents``: ``class``, ``parent``;
    ``methods``: ``class``, ``name``, ``method_id``. Cycles end by what was seen.
    """
    edges = parents.select(F.concat_ws(">", "class", "parent").alias("id"), F.col("class").alias("src"), F.col("parent").alias("dst"), F.lit("inherits").alias("type"))
    seeds = calls.select(F.col("class").alias("root_id"), F.col("class").alias("node_id")).distinct()
    up = T.traverse(edges, seeds, "out", depth).select(F.col("root_id").alias("class"), F.col("node_id").alias("owner"), "depth")
    reach = up.unionByName(seeds.select(F.col("root_id").alias("class"), F.col("node_id").alias("owner"), F.lit(0).alias("depth")))
    found = calls.join(reach, "class").join(methods.select(F.col("class").alias("owner"), "name", "method_id"), ["owner", "name"])
    nearest = found.groupBy("id").agg(F.min("depth").alias("depth"))
    return found.join(nearest, ["id", "depth"]).select("id", "method_id", "depth")


def configured(refs: DataFrame, values: DataFrame) -> DataFrame:
    """References to configuration (``id``, ``service``, ``var``) with every value of theirs, or the miss.

    ``values``: ``service``, ``var``, ``value``.
    """
    joined = refs.join(values.distinct(), ["service", "var"], "left")
    return joined.select("id", "service", "var", "value", F.when(F.col("value").isNull(), "config_not_found").otherwise("").alias("problem"))


def base_paths(clients: DataFrame, values: DataFrame) -> DataFrame:
    """URL path of a client's base URL variable before its own path, if all values agree; never twice.

    ``clients``: ``id``, ``service``, ``var``, ``path``.
    """
    path = F.regexp_replace(F.regexp_replace("value", r"^[a-z]+://[^/]*", ""), r"/+$", "")
    agreed = values.select("service", "var", path.alias("base")).groupBy("service", "var").agg(F.countDistinct("base").alias("n"), F.min("base").alias("base")).filter("n = 1").drop("n")
    joined = clients.join(agreed, ["service", "var"], "left").withColumn("base", given(F.col("base")))
    has = (F.col("base") == "") | (F.col("path") == F.col("base")) | F.col("path").startswith(F.concat("base", F.lit("/")))
    return joined.select("id", F.when(has, F.col("path")).otherwise(F.concat("base", "path")).alias("path"))


def doctor(nodes: DataFrame, edges: DataFrame, ledger: DataFrame) -> DataFrame:
    """Onboarding checks: name, count, and whether it is a problem."""
    both = edges.join(nodes.select(F.col("id").alias("src"), F.col("service").alias("a")), "src").join(nodes.select(F.col("id").alias("dst"), F.col("service").alias("b")), "dst")
    checks = (
        ("nodes", nodes.agg(F.count("*").alias("n")), F.col("n") == 0), ("edges", edges.agg(F.count("*").alias("n")), F.col("n") == 0),
        ("cross_service_edges", both.filter("a <> b").agg(F.count("*").alias("n")), F.col("n") == 0), ("ledger", ledger.agg(F.count("*").alias("n")), F.col("n") > 0),
        ("services_without_entrypoint", nodes.filter("service <> ''").select("service").distinct().join(rollups.entrypoints(nodes).select("service"), "service", "left_anti").agg(F.count("*").alias("n")), F.col("n") > 0),
    )
    parts = [df.select(F.lit(name).alias("check"), "n", bad.alias("is_problem")) for name, df, bad in checks]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def rules_from_json(text: str) -> tuple[contracts.Rule, ...]:
    """Workspace rules after the built-in ones; unknown names are refused."""
    known = contracts.Rule.__dataclass_fields__.keys()
    out = []
    for raw in json.loads(text):
        if extra := set(raw) - set(known):
            raise ValueError(f"unknown rule field {sorted(extra)[0]!r}")
        ends = {side: contracts.Endpoint(**{k: tuple(v) if k == "key" else v for k, v in raw[side].items()}) for side in ("producer", "consumer")}
        norms = {k: tuple(v) for k, v in raw["normalizers"].items()}
        out.append(contracts.Rule(**(raw | ends | {"normalizers": norms, "tiers": tuple(raw["tiers"])})))
    return (*contracts.RULES, *out)


def rules_from_yaml(text: str) -> tuple[contracts.Rule, ...]:
    """Workspace rules in YAML after the built-in ones: a list ``contracts`` of kind, producer, consumer, normalizers, match, edge and unmatched.

    The normalisers hold for every key field. Unknown names and fields are
    refused, so that a slip is no rule that matches nothing.
    """
    import yaml  # only workspaces with such files need it

    def known(raw: dict, allowed: set[str], what: str) -> dict:
        if extra := set(raw) - allowed:
            raise ValueError(f"unknown {what} field {sorted(extra)[0]!r}")
        return raw

    def end(raw: dict) -> contracts.Endpoint:
        known(raw, {"node", "where", "not_where", "key", "key_fallbacks", "target_service_meta"}, "endpoint")
        fallbacks = {k: tuple(v) for k, v in (raw.get("key_fallbacks") or {}).items()}
        return contracts.Endpoint(raw["node"], tuple(raw["key"]), raw.get("where") or {}, raw.get("not_where") or {}, fallbacks, raw.get("target_service_meta") or "")

    out = []
    for raw in (yaml.safe_load(text) or {}).get("contracts") or []:
        known(raw, {"kind", "producer", "consumer", "normalizers", "match", "edge", "unmatched"}, "rule")
        edge = known(raw["edge"], {"type", "id_prefix", "same_service"}, "edge")
        p, c = end(raw["producer"]), end(raw["consumer"])
        chain = tuple(raw.get("normalizers") or ())
        names = {f: chain for f in (*p.key, *c.key)}
        out.append(contracts.Rule(raw["kind"], p, c, names, tuple(raw["match"]), edge["type"], edge["id_prefix"], edge.get("same_service", "keep"), raw.get("unmatched", "drop")))
    return (*contracts.RULES, *out)


def bundle(blocks: list[tuple[str, str]], most_tokens: int) -> tuple[str, int]:
    """Markdown blocks (title, body) within a budget of four bytes a token; whole blocks go, last first."""
    texts = [f"## {title}\n\n{body}\n" for title, body in blocks]
    kept = len(texts)
    while kept > 1 and sum(len(t.encode()) for t in texts[:kept]) / 4 > most_tokens:
        kept -= 1
    return "\n".join(texts[:kept]), len(texts) - kept


def word_pieces(text: Column, vocabulary: list[str], most_letters: int = 100) -> Column:
    """Greedy longest-match pieces of the words of a text, ``[UNK]`` for a word that cannot be made of them or is longer than ``most_letters``.

    Words are in lower case; signs are words of their own. The vocabulary
    travels to the workers once as a set. A word is taken apart once for each
    batch, however often it comes.
    """
    known = frozenset(vocabulary)
    longest = max(map(len, known), default=0)

    def pieces(word: str) -> list[str]:
        out: list[str] = []
        at = 0
        while at < len(word):
            head = "##" if at else ""
            end = min(len(word), at + longest - len(head))
            while end > at and head + word[at:end] not in known:
                end -= 1
            if end <= at:
                return ["[UNK]"]
            out.append(head + word[at:end])
            at = end
        return out if len(word) <= most_letters else ["[UNK]"]

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        seen: dict[str, list[str]] = {}
        rows = []
        for line in texts:
            row: list[str] | None = None
            if line is not None:
                row = []
                for word in line.split():
                    if word not in seen:
                        seen[word] = pieces(word)
                    row += seen[word]
            rows.append(row)
        return pd.Series(rows)

    return cut(F.regexp_replace(F.lower(text), r"([^\p{L}\p{N}\s])", " $1 "))
