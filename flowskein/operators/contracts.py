"""Producers joined to consumers over channel keys, by declared rules.

A rule is compiled to one plan: keys are normalised, each tier is an equi-join
(the wildcard tier on keys masked at their wildcard places), and the first tier with hits wins for each producer, with all of its
hits: joins are multi-valued.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowskein import model
from flowskein.functions import normalize as N
from flowskein.functions.predicates import given, is_browser_executed, is_relative_url, is_test_file, path_evidence
from flowskein.operators.graph_store import latest
from flowskein.session import materialize, task_count

SERVICE_POLICIES = ("keep", "skip", "same_service_only")
UNMATCHED_POLICIES = ("unknown_edge", "ledger", "drop")


@dataclass(frozen=True)
class Endpoint:
    """Which nodes take part, and the fields that make their key, with fallbacks."""

    node_type: str
    key: tuple[str, ...]
    where: dict[str, str] = field(default_factory=dict)
    not_where: dict[str, str] = field(default_factory=dict)
    fallbacks: dict[str, tuple[str, ...]] = field(default_factory=dict)
    #: Meta field that names the service a producer asks, if it is known: only its consumers count then.
    target: str = ""


@dataclass(frozen=True)
class Rule:
    kind: str
    producer: Endpoint
    consumer: Endpoint
    normalizers: dict[str, tuple[str, ...]]
    tiers: tuple[str, ...]
    edge_type: str
    id_prefix: str
    same_service: str = "keep"
    unmatched: str = "drop"

    def __post_init__(self) -> None:
        for known, names, what in (
            (N.NORMALIZERS, [n for c in self.normalizers.values() for n in c], "normalizer"),
            (model.MATCH_TIERS, self.tiers, "tier"),
            (SERVICE_POLICIES, [self.same_service], "service policy"),
            (UNMATCHED_POLICIES, [self.unmatched], "unmatched policy"),
        ):
            if bad := [n for n in names if n not in known]:
                raise ValueError(f"rule {self.kind}: unknown {what} {bad[0]!r}")


_PATH = ("case_fold", "url_to_path", "dynamic_host_strip", "query_strip", "param_wildcard", "trim_slash", "empty_path_guard")
_QUOTE = ("quote_strip",)


def _simple(kind: str, producer: str, consumer: str, key: str, edge: str, prefix: str, service: str, unmatched: str, where=("", ""), extra=()) -> Rule:
    p, c = where
    return Rule(
        kind, Endpoint(producer, (key,), {"pattern": p} if p else {}), Endpoint(consumer, (key,), {"pattern": c} if c else {}),
        {key: _QUOTE + tuple(extra)}, ("exact", "normalized"), edge, prefix, service, unmatched,
    )


#: The built-in rules.
RULES = (
    Rule("http", Endpoint("http_client", ("method", "path"), {"nav_link": ""}, fallbacks={"path": ("url",)}, target="target_service"), Endpoint("http_handler", ("method", "path")),
         {"method": ("case_fold",), "path": _PATH}, ("exact", "normalized", "wildcard_anchored"), "http_call", "link", "keep", "unknown_edge"),
    Rule("nav", Endpoint("http_client", ("method", "path"), {"nav_link": "true"}, fallbacks={"path": ("url",)}, target="target_service"), Endpoint("http_handler", ("method", "path")),
         {"method": ("case_fold",), "path": _PATH}, ("exact", "normalized", "wildcard_anchored"), "navigates_to", "nav", "keep", "drop"),
    Rule("amqp", Endpoint("channel", ("exchange", "routing_key"), not_where={"role": "consumer"}), Endpoint("channel", ("exchange", "routing_key"), {"role": "consumer"}),
         {"exchange": _QUOTE, "routing_key": ("quote_strip", "dynamic_host_strip", "amqp_topic_wildcard")}, ("exact", "normalized", "exchange_only"), "publishes", "broker", "skip", "drop"),
    _simple("graphql", "graphql_client", "graphql_resolver", "operation", "graphql_call", "graphql", "skip", "ledger"),
    _simple("grpc", "grpc_client", "grpc_handler", "service_method", "grpc_call", "grpc", "skip", "unknown_edge"),
    _simple("job", "publisher", "subscriber", "job_class", "job_enqueue", "job", "keep", "ledger", ("aj_perform_later", "aj_perform_method")),
    _simple("celery", "publisher", "subscriber", "name", "job_enqueue", "job", "keep", "ledger", ("celery_task_delay", "celery_task_decorator")),
    _simple("kafka", "publisher", "subscriber", "topic", "kafka_publish", "kafka", "skip", "ledger", ("kafka_publish", "kafka_subscribe"), ("dynamic_host_strip",)),
    _simple("nats", "publisher", "subscriber", "subject", "nats_publish", "nats", "skip", "ledger", ("nats_publish", "nats_subscribe")),
    _simple("redis_pubsub", "publisher", "subscriber", "channel", "redis_publish", "redis", "skip", "ledger", ("redis_publish", "redis_subscribe")),
    _simple("pusher", "publisher", "subscriber", "channel", "pusher_trigger", "pusher", "keep", "ledger", ("pusher_trigger", "pusher_subscribe_client"), ("dynamic_host_strip",)),
    _simple("websocket", "publisher", "subscriber", "message_type", "ws_send", "ws", "keep", "ledger", ("ws_send_typed", "ws_dispatch_case")),
)


def _field(end: Endpoint, name: str) -> Column:
    """First non-empty of the field and its fallbacks."""
    options = [F.nullif(given(F.try_element_at("meta", F.lit(n))), F.lit("")) for n in (name, *end.fallbacks.get(name, ()))]
    return F.coalesce(*options, F.lit(""))


def _candidates(nodes: DataFrame, end: Endpoint) -> DataFrame:
    """A node whose last key field has several values (``key_candidates``, a JSON list) once for each; ``cand`` counts them from 1, 0 for none."""
    field = F.lit(end.key[-1])
    values = F.from_json(F.try_element_at("meta", F.lit("key_candidates")), "array<string>")
    each = nodes.select("*", F.posexplode(F.when(F.size(values) > 0, values).otherwise(F.array(F.lit(None).cast("string")))).alias("__i", "__v"))
    rest = F.map_filter("meta", lambda k, _: ~k.isin(end.key[-1], "key_candidates"))
    own = F.when(F.col("__v").isNull(), F.col("meta")).otherwise(F.map_concat(rest, F.create_map(field, F.col("__v"))))
    return each.withColumn("meta", own).withColumn("cand", F.when(F.col("__v").isNull(), 0).otherwise(F.col("__i") + 1)).drop("__i", "__v")


def _side(nodes: DataFrame, rule: Rule, end: Endpoint) -> DataFrame:
    """Nodes of one side with raw and normalised key; none without any key, none whose given field normalises away."""
    kept = nodes.filter(F.col("type") == end.node_type).filter(~is_test_file(F.col("file")))
    for key, value in end.where.items():
        kept = kept.filter(given(F.try_element_at("meta", F.lit(key))) == value)
    for key, value in end.not_where.items():
        kept = kept.filter(given(F.try_element_at("meta", F.lit(key))) != value)
    kept = _candidates(kept, end)
    lang = F.col("lang") if "lang" in kept.columns else F.lit("")
    local = is_browser_executed(lang, given(F.try_element_at("meta", F.lit("nav_link")))) & is_relative_url(_field(end, end.key[-1]))
    raw = [_field(end, f) for f in end.key]
    norm = [N.normalize_fields([r], list(rule.normalizers.get(f, ()))) for f, r in zip(end.key, raw)]
    lost = F.lit(False)
    for r, n in zip(raw, norm):
        lost = lost | ((r != "") & (n == ""))
    empty = F.concat_ws("", *raw) == ""
    return kept.filter(~lost & ~empty).select(
        "id", "service", "file", "line", F.concat_ws(" ", *raw).alias("raw"), F.concat_ws(" ", *norm).alias("norm"),
        norm[0].alias("head"), norm[-1].alias("tail"), given(F.try_element_at("meta", F.lit("confidence_ceiling"))).alias("ceiling"),
        given(F.try_element_at("meta", F.lit("wrapper"))).alias("wrapper"), "cand", local.alias("local"),
        (given(F.try_element_at("meta", F.lit(end.target))) if end.target else F.lit("")).alias("target"),
    )


def deduped(producers: DataFrame) -> DataFrame:
    """Of producers of one key on one line the one with most evidence, ties to the least id."""
    score = F.when(path_evidence(F.col("tail")) == "strong", 4).otherwise(0) + F.when(F.col("ceiling") == "", 2).otherwise(0) + F.when(F.col("wrapper") == "", 1).otherwise(0)
    scored = producers.withColumn("__score", score)
    first = scored.groupBy("service", "file", "line", "raw").agg(F.min(F.struct((-F.col("__score")).alias("s"), "id", "cand")).alias("b"))
    return producers.join(first.select("b.id", "b.cand"), ["id", "cand"], "left_semi")


def _with_methods(producers: DataFrame) -> DataFrame:
    """Producers without method try each method in order; ``__try`` is the order."""
    tried = F.posexplode(F.when(F.col("head") == "", F.array(*(F.lit(m) for m in model.FALLBACK_METHODS))).otherwise(F.array("head")))
    return producers.select("*", tried.alias("__try", "__m")).withColumn("head", F.col("__m")).withColumn("norm", F.concat_ws(" ", "__m", "tail")).withColumn(
        "raw", F.when(F.col("__try") == 0, F.col("raw")).otherwise(F.col("norm"))
    ).drop("__m")


def _few(masks: DataFrame, most: int = 50_000) -> DataFrame:
    """Distinct sets of wildcard places, written once; broadcast if they are counted to be few, as they are for any but made-up routes."""
    kept, _ = materialize(masks.distinct(), "masks")
    return F.broadcast(kept) if kept.count() <= most else kept


def _wildcard_keys(p: DataFrame, q: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Segment-wise matches with ``*`` on either side, as equality of masked keys.

    A pair matches if its keys are equal once the wildcard places of both are
    masked. Few sets of places occur for a method and length, so each key is
    masked once for each set that occurs on the other side, and the join is on
    the masked text: no method's keys are compared all with all. Pairs without a
    literal place in common cannot pass the anchor rule and are never made; what
    else that rule asks (``segments_match``) can be told from the masked key.
    """
    wild = lambda segs: F.filter(F.transform(segs, lambda s, i: F.when(s == "*", i).otherwise(-1)), lambda i: i >= 0)
    left = p.withColumn("__s", N.segments(F.col("tail"))).filter(F.exists("__s", lambda s: s != "*")).withColumn("__n", F.size("__s")).withColumn("__mp", wild(F.col("__s")))
    right = q.withColumn("__cs", N.segments(F.col("c_tail"))).withColumn("__n", F.size("__cs")).withColumn("__mc", wild(F.col("__cs"))).withColumn("head", F.col("c_head"))
    both = lambda: F.array_union("__mp", "__mc")
    masked = lambda segs: F.transform(segs, lambda s, i: F.when(F.array_contains(both(), i), "*").otherwise(s))
    key = lambda segs: F.struct("head", "__n", "__mp", "__mc", F.array_join(masked(segs), "/").alias("s"))
    anchored = F.size(both()) < F.col("__n")
    told = (F.size("__mp") == 0) | F.exists(masked(F.col("__s")), lambda s: (s != "*") & ~N.is_boilerplate(s))
    lk = left.join(_few(right.select("head", "__n", "__mc")), ["head", "__n"]).filter(anchored & told).withColumn("__k", key(F.col("__s")))
    rk = right.join(_few(left.select("head", "__n", "__mp")), ["head", "__n"]).filter(anchored).withColumn("__k", key(F.col("__cs")))
    return lk.select(*p.columns, "__k"), rk.select(*q.columns, "__k")


def _keys(p: DataFrame, c: DataFrame, tier: str) -> tuple[DataFrame, DataFrame]:
    """Both sides of a tier with ``__k``: they pair where it is equal, each pair by one key."""
    q = c.select(*(F.col(n).alias(f"c_{n}") for n in ("id", "service", "raw", "norm", "head", "tail")))
    if tier == "exact":
        return p.withColumn("__k", F.col("raw")), q.withColumn("__k", F.col("c_raw"))
    if tier == "normalized":
        return p.withColumn("__k", F.col("norm")), q.withColumn("__k", F.col("c_norm"))
    if tier == "wildcard_anchored":
        return _wildcard_keys(p, q)
    # an open producer meets all consumers of its exchange, any other one those that are open
    is_open = lambda t: F.regexp_replace(t, r"[*#. ]", "") == ""
    kinds = F.when(is_open("c_tail"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))
    met = q.withColumn("__a", F.explode(kinds)).withColumn("__k", F.struct(F.col("c_head").alias("h"), F.col("__a").alias("a")))
    return p.withColumn("__k", F.struct(F.col("head").alias("h"), is_open("tail").alias("a"))), met.drop("__a")


def _judged(tried: DataFrame, c: DataFrame, rule: Rule) -> DataFrame:
    """For each producer with hits (``id``, ``cand``) the order and tier that win, whether only its own service's hits count, and whether several services' do.

    Hits are counted by key and service and never made: what is shuffled and
    written grows with the sides, not with their pairs.
    """
    rows = None
    for tier in rule.tiers:
        p, q = _keys(tried, c, tier)
        by = q.groupBy("__k", "c_service").agg(F.min("c_id").alias("__lo"), F.max("c_id").alias("__hi"))
        of_key = by.groupBy("__k").agg(F.count("*").alias("__n"), F.min("c_service").alias("__first"), F.max("c_service").alias("__last"))
        met = p.join(of_key, "__k").join(by.withColumnRenamed("c_service", "service"), ["__k", "service"], "left")
        told = F.col("target") != ""
        others = F.col("__n") - F.col("__lo").isNotNull().cast("int")
        if rule.producer.target:
            met = met.join(by.select("__k", F.col("c_service").alias("target"), F.lit(True).alias("__there")), ["__k", "target"], "left")
            others = F.when(told, (F.col("__there").isNotNull() & (F.col("target") != F.col("service"))).cast("int")).otherwise(others)
        # a node is no hit of its own
        at_home = F.coalesce((F.col("__lo") != F.col("id")) | (F.col("__hi") != F.col("id")), F.lit(False)) & (~told | (F.col("target") == F.col("service")))
        other = F.when(told, F.col("target")).when(F.col("__first") != F.col("service"), F.col("__first")).otherwise(F.col("__last"))
        seen = met.select(
            "id", "cand", "service", "local", "__try", F.lit(model.MATCH_TIERS.index(tier)).alias("__t"), other.alias("__one"),
            (F.lit(False) if rule.same_service == "skip" else at_home).alias("__home"), (F.lit(0) if rule.same_service == "same_service_only" else others).alias("__others"),
        ).filter("__home OR __others > 0")
        rows = seen if rows is None else rows.unionByName(seen)
    home, one = F.when(F.col("__home"), F.col("service")), F.when(F.col("__others") > 0, F.col("__one"))
    tiers = rows.groupBy("id", "cand", "__try", "__t").agg(
        F.max(F.col("local") & F.col("__home")).alias("own"), F.max(F.col("__others") > 1).alias("many"), F.min(F.least(home, one)).alias("lo"), F.max(F.greatest(home, one)).alias("hi")
    )
    best = tiers.groupBy("id", "cand").agg(F.min(F.struct("__try", "__t", "own", (F.col("many") | F.coalesce(F.col("lo") != F.col("hi"), F.lit(False))).alias("fan"))).alias("b"))
    # what a browser asks of its own origin is its own service's, if that answers at all
    return best.select("id", "cand", "b.__try", "b.__t", F.col("b.own").alias("__own"), (F.col("b.fan") & ~F.col("b.own")).alias("__fan"))


@dataclass
class Linked:
    edges: DataFrame
    unmatched: DataFrame


def link(nodes: DataFrame, rule: Rule) -> Linked:
    """Edges of one rule, and the producers that match nothing (per the rule's policy).

    ``edges``: ``id``, ``src``, ``dst``, ``type``, ``label``, ``confidence``,
    ``tier``. Static for the exact tier, inferred for the next two, partial for
    exchange only; partial too when the targets lie in several services. Without
    nodes both are empty.
    """
    # keys are made once: both sides are read several times below
    p, _ = materialize(_side(nodes, rule, rule.producer), f"{rule.kind}-producers")
    c, _ = materialize(_side(nodes, rule, rule.consumer), f"{rule.kind}-consumers")
    several = all(side.filter("cand > 0").limit(1).count() for side in (p, c))
    p = deduped(p)
    tried = _with_methods(p) if rule.producer.key[0] == "method" else p.withColumn("__try", F.lit(0))
    one = ["id", "cand"]
    won, _ = materialize(tried.join(_judged(tried, c, rule), [*one, "__try"]), f"{rule.kind}-won")
    edges = None
    for tier in rule.tiers:
        pairs = _edges(won, c, rule, tier)
        edges = pairs if edges is None else edges.unionByName(pairs)
    # only candidates of both sides can pair twice
    edges = edges.distinct() if several else edges
    lost = p.join(won.select(*one).distinct(), one, "left_anti").select("id", "service", "file", "line", F.col("raw").alias("name"), F.lit(rule.kind).alias("kind"))
    return Linked(edges, lost if rule.unmatched != "drop" else lost.limit(0))


def _edges(won: DataFrame, c: DataFrame, rule: Rule, tier: str) -> DataFrame:
    """Edges of the producers that a tier wins. Pairs are made by the last join and go straight on: neither sorted, shuffled nor written."""
    confidence = (
        F.when(F.col("__fan") | F.lit(tier == "exchange_only") | (F.col("ceiling") == "partial"), "partial")
        .when(F.lit(tier == "exact") & (F.col("ceiling") == "") & (F.col("cand") == 0), "static")
        .otherwise("inferred")
    )
    weak = F.col("__fan") & (path_evidence(F.col("tail")) == "weak")
    mine = won.filter(F.col("__t") == model.MATCH_TIERS.index(tier)).filter(~weak).withColumn("confidence", confidence)
    left, right = _keys(mine, c, tier)
    left = left.select("__k", "id", "service", "target", "__own", "norm", "confidence").distinct()
    right = right.select("__k", "c_id", "c_service").distinct()
    tasks = task_count(won.sparkSession)  # by number, as what is small before the join is large after it
    pairs = left.repartition(tasks, "__k").join(right.repartition(tasks, "__k"), "__k").filter("id <> c_id")
    same = F.col("service") == F.col("c_service")
    if rule.same_service != "keep":
        pairs = pairs.filter(same if rule.same_service == "same_service_only" else ~same)
    pairs = pairs.filter(((F.col("target") == "") | (F.col("c_service") == F.col("target"))) & (~F.col("__own") | same))
    return pairs.select(
        F.concat(F.lit(rule.id_prefix + ":"), "id", F.lit("->"), "c_id").alias("id"), F.col("id").alias("src"), F.col("c_id").alias("dst"),
        F.lit(rule.edge_type).alias("type"), F.col("norm").alias("label"), "confidence", F.lit(tier).alias("tier"),
    )


def unknown_edges(lost: DataFrame, rule: Rule) -> DataFrame:
    """Edges of unmatched producers to the ``unresolved`` node."""
    return lost.select(
        F.concat(F.lit(rule.id_prefix + ":"), "id", F.lit("->unresolved")).alias("id"), F.col("id").alias("src"), F.lit("unresolved").alias("dst"),
        F.lit(rule.edge_type).alias("type"), F.col("name").alias("label"), F.lit("unknown").alias("confidence"),
    )


def link_all(nodes: DataFrame, rules: tuple[Rule, ...] = RULES) -> Linked:
    """All rules; an edge id counts once."""
    done = [link(nodes, r) for r in rules]
    edges, lost = done[0].edges, done[0].unmatched
    for more in done[1:]:
        edges, lost = edges.unionByName(more.edges), lost.unionByName(more.unmatched)
    return Linked(latest(edges, ["id"], ["tier", "label"]), lost)
