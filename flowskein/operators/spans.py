"""Spans of captured exports, joined to flows between services.

Every span ends in a flow, is the matched client of one, or is in the ledger
with a reason: nothing is dropped unseen. Spans meet within their session only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowskein.functions import normalize as N
from flowskein.functions import scalars as S
from flowskein.functions.predicates import given
from flowskein.model import CONSUME_OPERATIONS, PUBLISH_OPERATIONS, SPAN_ATTRIBUTES
from flowskein.operators import nested

# Span kinds by number.
KINDS = ("UNSPECIFIED", "INTERNAL", "SERVER", "CLIENT", "PRODUCER", "CONSUMER")
#: Normalisers of a path, as static channels have it.
PATH_CHAIN = ["case_fold", "url_to_path", "query_strip", "param_wildcard", "trim_slash"]


def kind_name(kind: Column) -> Column:
    """Kind by name, from its number, its number as text, or its long name."""
    short = F.regexp_replace(F.upper(kind), "^SPAN_KIND_", "")
    number = kind.try_cast("double").cast("int")
    return F.when(number.between(0, 5), F.element_at(F.array(*(F.lit(k) for k in KINDS)), number + 1)).otherwise(F.when(short.isin(*KINDS), short).otherwise("UNSPECIFIED"))


def _plain(attribute: Column) -> Column:
    return F.coalesce(*(F.try_variant_get(attribute, f"$.value.{t}", "string") for t in ("stringValue", "intValue", "doubleValue", "boolValue")), F.lit(""))


def _attributes(span: Column) -> Column:
    """The attributes that are kept, as (``k``, ``v``) in their order."""
    listed = F.transform(nested.members(span, "attributes"), lambda a: F.struct(nested.text_of(a, "$.key").alias("k"), _plain(a).alias("v")))
    return F.filter(listed, lambda x: x["k"].isin(*SPAN_ATTRIBUTES))


def _links(span: Column) -> Column:
    ids = F.transform(nested.members(span, "links"), lambda x: F.concat_ws("/", nested.text_of(x, "$.traceId"), nested.text_of(x, "$.spanId")))
    return F.array_join(F.array_sort(F.array_distinct(ids)), ",")


_LEVELS = (
    nested.Level("resource", "", "resourceSpans", {"service": nested.service_of}),
    nested.Level("scope", "resource", "scopeSpans"),
    nested.Level(
        "span",
        "scope",
        "spans",
        {
            "is_span": nested.is_object,
            "trace_id": "$.traceId",
            "span_id": "$.spanId",
            "parent_span_id": lambda p: nested.parent_span(nested.text_of(p, "$.parentSpanId")),
            "kind": lambda p: kind_name(nested.text_of(p, "$.kind")),
            "start_ns": lambda p: nested.text_of(p, "$.startTimeUnixNano").try_cast("decimal(20,0)").cast("bigint"),
            "attrs": _attributes,
            "links": _links,
        },
    ),
)


def span_rows(exports: DataFrame, names: dict[str, str] | None = None, known: tuple[str, ...] = (), sse_routes: tuple[str, ...] = (), told_by_kind: bool = False) -> DataFrame:
    """One row for each distinct span of settled exports, and what it says of a channel.

    ``exports``: ``export_id``, ``received_at``, ``session``, ``body``, settled
    as ``nested.export_trees`` does. ``raw_service`` is the span's own name,
    ``service`` the one it resolves to: by ``names``, and only if ``known`` has
    it, where that is given; else ''. ``kind_of`` is http or sse for spans with
    a method, a messaging kind for producers and consumers, '' for others;
    ``key`` the channel's normalised key, '' without path or destination.
    ``role`` is publish or consume, by the span's operation; spans that do not
    tell it have none, or, under ``told_by_kind``, that of their kind.
    """
    trees = nested.export_trees(exports, _LEVELS, ("resource", "span"), ("session",))
    spans = trees.table("span", {"raw_service": ("resource", "service")}).filter("is_span")
    look = lambda name: F.coalesce(F.try_element_at(F.filter("attrs", lambda x: x["k"] == name), F.lit(1))["v"], F.lit(""))
    service = F.col("raw_service")
    if names:
        service = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in names.items() for x in pair)), service), service)
    if known:
        service = F.when(service.isin(*known), service).otherwise("")
    kind = F.col("kind")
    method, path = S.http_of_span(kind, look)
    m_kind, operation, m_key = S.messaging_of_span(look)
    said = F.when(operation.isin(*PUBLISH_OPERATIONS), "publish").when(operation.isin(*CONSUME_OPERATIONS), "consume")
    if told_by_kind:
        said = said.when(operation == "", F.when(kind == "PRODUCER", "publish").otherwise("consume"))
    columns = spans.select(
        "session", service.alias("service"), "raw_service", "trace_id", "span_id", "parent_span_id", "kind", "start_ns", "links",
        look("code.filepath").alias("code_file"), look("code.function").alias("code_func"), F.lower(method).alias("__m"), path.alias("__p"),
        m_kind.alias("__mk"), m_key.alias("__key"), S.is_event_stream(look, path, sse_routes).alias("__sse"), kind.isin("PRODUCER", "CONSUMER").alias("__msg"), said.alias("__said"),
    )
    norm = N.normalize_fields([F.col("__p")], PATH_CHAIN)
    of = F.when(F.col("__msg"), F.col("__mk")).when(F.col("__m") == "", "").when((F.col("kind") == "SERVER") & F.col("__sse"), "sse").otherwise("http")
    key = F.when(F.col("__msg"), F.col("__key")).when(F.col("__p") == "", "").when(of == "sse", norm).otherwise(F.trim(F.concat_ws(" ", "__m", norm)))
    role = F.when(F.col("__msg"), F.coalesce("__said", F.lit(""))).otherwise("")
    return columns.withColumns({"kind_of": of, "key": key, "role": role}).drop("__m", "__p", "__mk", "__key", "__sse", "__msg", "__said").distinct()


def _by_id(spans: DataFrame) -> DataFrame:
    """One row for each span id of a session and trace; of several spans of one id the greatest."""
    held = spans.filter("span_id <> ''").groupBy("session", "trace_id", "span_id").agg(F.max(F.struct("kind", "raw_service", "service")).alias("u"))
    return held.select("session", "trace_id", "span_id", F.col("u.kind").alias("u_kind"), F.col("u.raw_service").alias("u_raw"), F.col("u.service").alias("u_service"))


def calls(spans: DataFrame) -> DataFrame:
    """SERVER spans of a channel with their caller: the CLIENT parent of another service, if there is one.

    ``u_service`` is null without such a parent and '' if its service is unknown;
    ``src_service`` is '' in both cases.
    """
    servers = spans.filter("kind = 'SERVER' AND service <> '' AND kind_of <> '' AND key <> ''")
    clients = _by_id(spans).filter("u_kind = 'CLIENT'").withColumnRenamed("span_id", "parent_span_id")
    near = servers.join(clients, ["session", "trace_id", "parent_span_id"], "left")
    apart = F.when((F.col("parent_span_id") != "") & (F.col("u_raw") != F.col("raw_service")), F.col("u_service"))
    return near.withColumn("u_service", apart).withColumn("src_service", given(F.col("u_service"))).drop("u_kind", "u_raw")


def parent_child(spans: DataFrame) -> DataFrame:
    """Calls whose caller is known."""
    return calls(spans).filter("src_service <> ''")


def linked(spans: DataFrame) -> DataFrame:
    """Consumers with the producer spans they link to, every one of them."""
    each = spans.filter("role = 'consume' AND service <> '' AND key <> '' AND links <> ''").withColumn("link", F.explode(F.split("links", ",")))
    up = _by_id(spans).filter("u_kind = 'PRODUCER' AND u_service <> ''").select("session", F.concat_ws("/", "trace_id", "span_id").alias("link"), F.col("u_service").alias("src_service"))
    return each.join(up, ["session", "link"])


def _same(spans: DataFrame) -> list[str]:
    return ["session", "trace_id", "span_id", "raw_service", "kind_of", "key"]


def key_matched(spans: DataFrame) -> DataFrame:
    """Consumers without a link that holds, with every service that publishes to their kind and key in the session.

    Producers are brought down to their services first, so a channel of very
    many spans is no product of them.
    """
    free = spans.filter("role = 'consume' AND service <> '' AND key <> ''").join(linked(spans).select(*_same(spans)).distinct(), _same(spans), "left_anti")
    publishers = spans.filter("role = 'publish' AND service <> '' AND key <> ''").select("session", "kind_of", "key", F.col("service").alias("src_service")).distinct()
    return free.join(publishers, ["session", "kind_of", "key"])


def producers_alone(spans: DataFrame) -> DataFrame:
    """Producers that no consumer of their session links to or shares a channel with."""
    p = spans.filter("role = 'publish' AND service <> '' AND key <> ''")
    answered = key_matched(spans).select("session", "kind_of", "key").distinct()
    named = linked(spans).select("session", "link").distinct()
    return p.join(answered, ["session", "kind_of", "key"], "left_anti").withColumn("link", F.concat_ws("/", "trace_id", "span_id")).join(named, ["session", "link"], "left_anti")


def flow_records(spans: DataFrame) -> DataFrame:
    """Flows by kind, key and services, over all sessions: traces and sessions that show them, and how the first was found.

    ``causality``: parent_child, link, key_match, or server_only for a server
    whose caller was not captured. ``src_service`` is '' there, ``dst_service``
    where nobody was seen to consume. A trace counts once in a session.
    """
    def part(rows: DataFrame, dst: Column, src: Column, causality: Column) -> DataFrame:
        return rows.select("kind_of", "key", src.alias("src_service"), dst.alias("dst_service"), causality.alias("causality"), "trace_id", "session", "start_ns", "span_id")

    own, none, src = F.col("service"), F.lit(""), F.col("src_service")
    rows = part(calls(spans), own, src, F.when(src != "", "parent_child").otherwise("server_only"))
    for more in (part(linked(spans), own, src, F.lit("link")), part(key_matched(spans), own, src, F.lit("key_match")), part(producers_alone(spans), none, own, F.lit("key_match"))):
        rows = rows.unionByName(more)
    first = F.min(F.struct("session", "trace_id", "start_ns", "span_id", "causality"))["causality"]
    return rows.groupBy("kind_of", "key", "src_service", "dst_service").agg(
        first.alias("causality"), F.countDistinct("trace_id").alias("n_traces"), F.countDistinct("session").alias("n_sessions"), F.countDistinct("session", "trace_id").alias("n_refs")
    )


def span_ledger(spans: DataFrame) -> DataFrame:
    """What became of every span: one outcome each, counted; they add up to all spans."""
    ident = ["session", "trace_id", "span_id", "raw_service"]
    called = calls(spans).filter("u_service IS NOT NULL").select("session", "trace_id", F.col("parent_span_id").alias("span_id")).distinct().withColumn("__used", F.lit(True))
    met = linked(spans).select(*_same(spans)).unionByName(key_matched(spans).select(*_same(spans))).distinct().withColumn("__met", F.lit(True))
    rows = spans.join(called, ["session", "trace_id", "span_id"], "left").join(met, [*ident, "kind_of", "key"], "left")
    k = F.col("kind")
    messaging = F.when(F.col("key") == "", "no_route_or_path").when(F.col("role") == "", "unsupported_span_kind").when((F.col("role") == "publish") | F.col("__met"), "flow").otherwise("no_causality")
    outcome = (
        F.when(k == "SERVER", F.when(F.col("service") == "", "unknown_service").when(F.col("kind_of") == "", "unsupported_span_kind").when(F.col("key") == "", "no_route_or_path").otherwise("flow"))
        .when(k.isin("PRODUCER", "CONSUMER"), F.when(F.col("service") == "", "unknown_service").otherwise(messaging))
        .when((k == "CLIENT") & F.col("__used"), F.when(F.col("service") == "", "unknown_service").otherwise("matched_client"))
        .when((k == "CLIENT") & (F.col("kind_of") != ""), "no_causality")
        .otherwise("unsupported_span_kind")
    )
    return rows.groupBy(outcome.alias("outcome"), "kind").agg(F.count("*").alias("n_spans"))


def session_summary(spans: DataFrame) -> DataFrame:
    """Spans, traces and services of every session."""
    return spans.groupBy("session").agg(
        F.count("*").alias("n_spans"), F.countDistinct("trace_id").alias("n_traces"), F.array_join(F.array_sort(F.collect_set(F.when(F.col("service") != "", F.col("service")))), ",").alias("services")
    )


def flow_evidence(flows: DataFrame) -> DataFrame:
    """Flows as edge evidence: type and label of the channel."""
    known = {"http": "http_call", "sse": "sse_endpoint", "kafka": "kafka_publish", "nats": "nats_publish", "job": "job_enqueue"}
    kind = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in known.items() for x in pair)), F.col("kind_of")), F.lit("publishes"))
    return flows.select(kind.alias("type"), F.col("key").alias("label"), "src_service", "dst_service").distinct()
