"""Fixed vocabulary of the graph: types, states, and the sets that rules refer to."""

from __future__ import annotations

# Edge types that say where a node lives, not what depends on it.
STRUCTURAL_EDGES = ("contains", "declares", "instantiates", "uses_type", "imports")
# Edge types that flow queries leave out.
NON_FLOW_EDGES = ("contains", "declares")
# Edge types that the resolution scorecard leaves out.
NON_RESOLUTION_EDGES = (
    "contains", "declares", "reads", "writes", "captures", "flows_to", "uses_type", "inherits", "implements", "instantiates", "imports",
    "defined_in", "component_impl", "datastar_bind", "navigates_to", "dom_read", "dom_write", "dom_create", "dom_remove", "dom_listen",
)
# Edge types that a span can confirm.
RUNTIME_EDGES = ("http_call", "sse_endpoint", "publishes", "kafka_publish", "nats_publish", "job_enqueue")
# Node types that start flows.
ENTRYPOINT_TYPES = ("http_handler", "route", "worker", "subscriber", "grpc_handler", "graphql_resolver")
# Node types with an outline kind of the same name.
TREE_KINDS = ("class", "struct", "function", "method", "component", "variable")
# Middleware edges are marked by what made them.
FILTER_VIAS = ("rails_filter", "gin_middleware_use", "express_middleware_use")
NOISE_CLASSES = ("filter_chain", "mixin", "containment", "render_tree")
# Path segments that say nothing about the route.
BOILERPLATE_SEGMENTS = ("api", "apis", "rest", "public", "internal")
# Methods tried for a client without one, in this order.
FALLBACK_METHODS = ("get", "post", "put", "patch", "delete", "")
# Span attributes that are kept; no other ever leaves the body.
SPAN_ATTRIBUTES = (
    "http.request.method", "url.full", "url.path", "http.route", "http.response.header.content-type", "http.method", "http.target",
    "messaging.system", "messaging.operation.type", "messaging.destination.name", "messaging.rabbitmq.destination.routing_key", "messaging.operation",
    "code.filepath", "code.function",
)
# Operations that send to a channel, and that take from one.
PUBLISH_OPERATIONS, CONSUME_OPERATIONS = ("publish", "send"), ("process", "receive")

VERIFIED, CANDIDATE, GAP, CONFLICTING = "verified", "candidate", "observed_only_gap", "conflicting"
MATCH_TIERS = ("exact", "normalized", "wildcard_anchored", "exchange_only")
STALE_AFTER_SECONDS = 30 * 86_400
