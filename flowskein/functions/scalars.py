"""Scalar functions of records, spans, sources and search."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowskein import model
from flowskein.functions.normalize import quote_strip
from flowskein.functions.predicates import given


def search_tokens(query: Column) -> Column:
    """Lower-case runs of letters and digits; everything else separates, ``_`` too."""
    return F.filter(F.split(F.regexp_replace(F.lower(query), r"[^\p{L}\p{N}]+", " "), " "), lambda t: t != "")


def is_exact(label: Column, query: Column) -> Column:
    """The label is the query or one of its words, whatever the case."""
    low = F.lower(F.trim(label))
    return (low == F.lower(F.trim(query))) | F.array_contains(F.split(F.lower(query), r"\s+"), low)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where one has no length."""
    both = norm(a) * norm(b)
    return F.when(both == 0, 0.0).otherwise(dot(a, b) / both)


def l2_normalized(v: Column) -> Column:
    """Unit vector; vectors of hardly any length stay."""
    square = F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return F.when(square < 1e-12, v.cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / F.sqrt(square)))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def card_text(label: Column, node_type: Column, service: Column, file: Column, extra: Column) -> Column:
    """Search text of a node."""
    return F.concat_ws(" ", *(F.when(given(c) != "", c) for c in (label, node_type, service, file, extra)))


def sql_table(sql: Column) -> Column:
    """First table that the first statement names after FROM, INTO or UPDATE; '' for none."""
    first = F.substring_index(F.btrim(sql, F.lit(" \t\r\n\"'`")), ";", 1)
    return F.lower(F.regexp_extract(first, r"(?is)\b(?:from|into|update)\s+[\"`\[]?([A-Za-z_][\w.]*)", 1))


def json_tag_name(tag: Column) -> Column:
    """Name in a struct tag ``json:"name,..."``; '' for none and for ``-``."""
    name = F.regexp_extract(tag, r'json:"([^",]*)', 1)
    return F.when(name == "-", "").otherwise(name)


def env_var_name(code: Column) -> Column:
    """Variable read from the environment, in the spellings of Go, JS, Ruby and Python."""
    pattern = r"""(?:os\.Getenv\(|os\.environ\.get\(|os\.environ\[|os\.getenv\(|ENV\[|ENV\.fetch\(|process\.env\.|process\.env\[)["']?([A-Z][A-Z0-9_]*)"""
    return F.regexp_extract(code, pattern, 1)


def service_hint(variable: Column) -> Column:
    """Service that a variable such as ``ORDERS_SERVICE_URL`` points to; '' for none."""
    return F.lower(F.regexp_extract(variable, r"^([A-Z][A-Z0-9_]*?)_(?:SERVICE_URL|SERVICE_HOST|API_URL|BASE_URL|URL|HOST|ADDR)$", 1))


def age_text(seconds: Column) -> Column:
    """Age in whole days, hours or minutes; '' for none or a negative age."""
    return (
        F.when(seconds.isNull() | (seconds <= 0), "")
        .when(seconds >= 86_400, F.concat(F.floor(seconds / 86_400).cast("string"), F.lit("d")))
        .when(seconds >= 3_600, F.concat(F.floor(seconds / 3_600).cast("string"), F.lit("h")))
        .otherwise(F.concat(F.floor(seconds / 60).cast("string"), F.lit("m")))
    )


def compact_sources(sources: Column, now: Column) -> Column:
    """Sources as sorted ``provider:ref (age)`` texts."""

    def one(s: Column) -> Column:
        age = age_text(F.when(s["observed_at"] > 0, now - s["observed_at"]))
        return F.concat(s["provider"], F.lit(":"), given(s["ref"]), F.when(age != "", F.concat(F.lit(" ("), age, F.lit(")"))).otherwise(""))

    return F.array_sort(F.transform(F.coalesce(sources, F.array()), one))


def verification_state(sources: Column, confidence: Column) -> Column:
    """State of an edge from all its sources.

    Verified: static and (runtime or config), or static and contract unless the
    static match is partial. Without static: a gap if anything but a guess says
    so. Else candidate.
    """
    has = lambda *p: F.exists(F.coalesce(sources, F.array()), lambda s: s["provider"].isin(*p))
    return (
        F.when(has("static") & (has("runtime", "config") | (has("contract") & (given(confidence) != "partial"))), model.VERIFIED)
        .when(has("static"), model.CANDIDATE)
        .when(has("runtime", "config", "contract"), model.GAP)
        .otherwise(model.CANDIDATE)
    )


def verified_granularity(state: Column, sources: Column) -> Column:
    """'' unless verified; ``site`` if a runtime source names a code file, else ``channel``."""
    site = F.exists(F.coalesce(sources, F.array()), lambda s: (s["provider"] == "runtime") & (given(s["code_file"]) != ""))
    return F.when(state == model.VERIFIED, F.when(site, "site").otherwise("channel")).otherwise("")


def is_stale(state: Column, sources: Column, now: Column, after: int = model.STALE_AFTER_SECONDS) -> Column:
    """Verified, and every runtime source is older than the threshold."""
    runtime = F.filter(F.coalesce(sources, F.array()), lambda s: s["provider"] == "runtime")
    return (state == model.VERIFIED) & (F.size(runtime) > 0) & F.forall(runtime, lambda s: now - s["observed_at"] > after)


def merged_sources(sources: Column) -> Column:
    """Sources once for each (provider, ref), the first in order counts, in (provider, ref, time) order."""
    key = lambda s: F.struct(s["provider"], s["ref"], s["observed_at"], s["confidence"], s["code_file"], s["code_func"])
    listed = F.array_sort(F.transform(F.coalesce(sources, F.array()), key))
    return F.filter(listed, lambda s, i: (i == 0) | ~((F.get(listed, i - 1)["provider"] == s["provider"]) & (F.get(listed, i - 1)["ref"].eqNullSafe(s["ref"]))))


def channel_label(exchange: Column, routing_key: Column, label: Column, method: Column, path: Column) -> Column:
    """Exchange and routing key, else label, else method and path."""
    broker = F.trim(F.concat_ws(" ", given(exchange), given(routing_key)))
    return F.when(broker != "", broker).when(given(label) != "", label).otherwise(F.trim(F.concat_ws(" ", given(method), given(path))))


Look = Callable[[str], Column]


def first_given(look: Look, *names: str) -> Column:
    """The first attribute of those names that is not empty, else ''."""
    return F.coalesce(*(F.nullif(look(n), F.lit("")) for n in names), F.lit(""))


def http_of_span(kind: Column, look: Look) -> tuple[Column, Column]:
    """Method and path of an HTTP span, newer attribute names first; without a method there is neither.

    A server names its route, then its path; any other kind of span the full URL.
    """
    method = first_given(look, "http.request.method", "http.method")
    path = F.when(kind == "SERVER", first_given(look, "http.route", "url.path", "http.target")).otherwise(look("url.full"))
    return method, F.when(method != "", path).otherwise("")


def is_event_stream(look: Look, path: Column, routes: tuple[str, ...] = ()) -> Column:
    """Server-sent events: by the response's content type, or by a route known for it."""
    return F.lower(look("http.response.header.content-type")).contains("text/event-stream") | path.isin(*routes)


def messaging_of_span(look: Look) -> tuple[Column, Column, Column]:
    """Kind, operation and key of a messaging span: rabbitmq is amqp, others than kafka and nats are jobs; no destination, no key."""
    system = F.lower(look("messaging.system"))
    kind = F.when(system == "rabbitmq", "amqp").when(system.isin("kafka", "nats"), system).otherwise("job")
    target, routing = quote_strip(look("messaging.destination.name")), quote_strip(look("messaging.rabbitmq.destination.routing_key"))
    key = F.when(target == "", "").when((kind == "amqp") & (routing != ""), F.concat_ws(" ", target, routing)).otherwise(target)
    return kind, first_given(look, "messaging.operation.type", "messaging.operation"), key


def slug(text: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), F.lit("-"))


def normal_fact(text: Column) -> Column:
    """Facts compare in lower case with single blanks and without quotes."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[`'\"]", ""), r"\s+", " "))


def failure_class(message: Column) -> Column:
    """quota, transient, fatal, or '' for no failure."""
    low = F.lower(given(message))
    return (
        F.when(low == "", "")
        .when(low.rlike(r"quota|rate.?limit|429|credit"), "quota")
        .when(low.rlike(r"timeout|timed out|unavailable|502|503|504|reset|temporar|overloaded|locked"), "transient")
        .otherwise("fatal")
    )


def snippet(text: Column, start: Column, n: int) -> Column:
    """``n`` lines from line ``start`` (from 1)."""
    return F.array_join(F.slice(F.split(text, "\n"), F.greatest(start, F.lit(1)), n), "\n")


def rounded_score(x: Column) -> Column:
    return F.round(x, 3)

