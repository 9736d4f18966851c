"""Queries over evidence, spans, search, evaluation, histories and streams, with their oracle SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowskein.functions import normalize as N
from flowskein.functions import scalars as S
from flowskein.functions.predicates import given
from flowskein.operators import contracts, evaluation, evidence, graph_store, history, search
from flowskein.operators import spans as SP
from flowskein.plans.graph import W, edges, nodes
from flowskein.session import materialize, shared_dir, table
from flowskein.streaming import spans as streaming

NOW = 1_750_000_000


def reconcile_states(spark, sf_dir):
    """State of every edge recomputed from its sources."""
    return evidence.recomputed(edges(spark, sf_dir)).select("id", "state", "granularity")


def reconcile_report(spark, sf_dir):
    return evidence.reconcile_report(evidence.recomputed(edges(spark, sf_dir)))


def runtime_coverage(spark, sf_dir):
    return evidence.runtime_coverage(edges(spark, sf_dir))


def provider_pairs(spark, sf_dir):
    return evidence.provider_pairs(edges(spark, sf_dir))


def rule_proposals(spark, sf_dir):
    """Channels that were observed, but not found in code."""
    return evidence.proposals(evidence.recomputed(edges(spark, sf_dir)))


def evidence_fusion(spark, sf_dir):
    """Static edges fused with the evidence of the others: sources and gaps by type."""
    e = edges(spark, sf_dir)
    is_static = F.exists("sources", lambda s: s["provider"] == "static")
    static = e.filter(is_static).withColumn("sources", F.filter("sources", lambda s: s["provider"] == "static"))
    rest = e.withColumn("source", F.explode("sources")).filter("source.provider <> 'static'")
    out = evidence.fused(static, rest)
    gap = F.col("id").startswith("gap:")
    return out.groupBy("type").agg(F.count_if(gap).alias("n_gaps"), F.count_if(~gap).alias("n_static"), F.count_if(~gap & (F.size("sources") > 1)).alias("n_confirmed"))


def _ledger(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "edges").filter("dst = 'unresolved' OR startswith(dst, 'unresolved:')").filter("trim(src) <> ''")
    return rows.select(F.col("type").alias("class"), F.when(F.col("dst") == "unresolved", "internal").otherwise("cross").alias("scope"), F.lit("unresolved_edge").alias("reason"))


def yield_scorecard(spark, sf_dir):
    """Resolution by edge class and scope."""
    return evidence.yield_scorecard(edges(spark, sf_dir), nodes(spark, sf_dir), _ledger(spark, sf_dir))


def yield_gate(spark, sf_dir):
    return evidence.yield_gate(yield_scorecard(spark, sf_dir))


def ledger_retraction(spark, sf_dir):
    """Call references that an edge bears out leave the ledger: what stays, of the labels of all clients."""
    n, e = nodes(spark, sf_dir), edges(spark, sf_dir)
    ledger = n.filter("type = 'function'").select("service", "file", F.col("label").alias("name"), F.lit("call_ref").alias("kind"))
    ledger = ledger.unionByName(e.filter("type = 'calls'").join(n.select(F.col("id").alias("src"), "service", "file"), "src").join(n.select(F.col("id").alias("dst"), F.col("label").alias("name")), "dst").select("service", "file", "name", F.lit("call_ref").alias("kind")))
    return evidence.retracted(ledger, e, n, {"call_ref": "calls"}).groupBy("service").agg(F.count("*").alias("n"))


def provider_files(spark, sf_dir):
    """Files behind each provider's sources."""
    return evidence.provider_files(edges(spark, sf_dir))


def epistemic_verdicts(spark, sf_dir):
    """Per edge type, why answers over it are lower bounds."""
    e = edges(spark, sf_dir)
    n = lambda s: F.count_if(F.col("verification_state") == s)
    g = e.groupBy("type").agg(n("candidate").alias("c"), n("observed_only_gap").alias("g"), n("conflicting").alias("x"), F.count_if(S.is_stale(F.col("verification_state"), F.col("sources"), F.lit(NOW))).alias("s"))
    return g.select("type", evidence.verdict(F.lit(0), F.lit(False), F.col("c"), F.col("s"), F.col("g"), F.col("x")).alias("causes"))


def compact_sources(spark, sf_dir):
    """Sources as short texts with their age."""
    return edges(spark, sf_dir).select("id", F.array_join(S.compact_sources(F.col("sources"), F.lit(NOW)), "; ").alias("sources"))


def _spans(spark, sf_dir, **how) -> DataFrame:
    return materialize(SP.span_rows(table(spark, sf_dir, "otlp_exports"), **how), "spans")[0]  # bodies are parsed once


def spans_parent_child(spark, sf_dir):
    """Calls between services that spans show, by pair."""
    pairs = SP.parent_child(_spans(spark, sf_dir))
    return pairs.groupBy("src_service", F.col("service").alias("dst_service")).agg(F.count("*").alias("n"), F.countDistinct("trace_id").alias("n_traces"))


def spans_flow_records(spark, sf_dir):
    return SP.flow_records(_spans(spark, sf_dir))


def spans_messaging_flows(spark, sf_dir):
    """Flows where spans that do not tell their operation are taken by their kind: links, and channels where there are none."""
    return SP.flow_records(_spans(spark, sf_dir, told_by_kind=True)).filter("kind_of NOT IN ('http', 'sse')")


#: A route of the corpus taken for one of server-sent events.
SSE_ROUTES = ("/anvils/:id",)


def spans_event_streams(spark, sf_dir):
    """Flows of the routes that are known for server-sent events."""
    return SP.flow_records(_spans(spark, sf_dir, sse_routes=SSE_ROUTES)).filter("kind_of = 'sse'")


def spans_key_matches(spark, sf_dir):
    """Consumers without link by channel and the services that publish to it."""
    rows = SP.key_matched(_spans(spark, sf_dir, told_by_kind=True))
    return rows.groupBy("session", "kind_of", "key", "src_service", F.col("service").alias("dst_service")).agg(F.count("*").alias("n"))


def span_outcomes(spark, sf_dir):
    """What became of every span: the sum is all spans."""
    return SP.span_ledger(_spans(spark, sf_dir))


def span_outcomes_by_kind(spark, sf_dir):
    """As span_outcomes, with operations told by kind and one service unknown."""
    return SP.span_ledger(_spans(spark, sf_dir, told_by_kind=True, names={"anvil": "forge"}))


def session_summaries(spark, sf_dir):
    return SP.session_summary(_spans(spark, sf_dir))


def session_coverage(spark, sf_dir):
    """Runtime-verifiable edges whose channel a span shows."""
    return evidence.session_coverage(edges(spark, sf_dir), SP.flow_evidence(SP.flow_records(_spans(spark, sf_dir))))


def contract_http(spark, sf_dir):
    """Clients to handlers, as the spans name them: methods and URLs against routes."""
    s = _spans(spark, sf_dir).filter("kind_of = 'http' AND service <> '' AND key LIKE '% %'")
    method, path = F.substring_index("key", " ", 1), F.substring_index("key", " ", -1)
    made = s.filter("kind IN ('CLIENT', 'SERVER')").select(F.when(F.col("kind") == "CLIENT", "http_client").otherwise("http_handler").alias("type"), "service", method.alias("method"), path.alias("path")).distinct()
    rows = made.select(
        F.concat_ws(":", "service", "type", "method", "path").alias("id"), "type", F.lit("").alias("label"), "service", F.concat("service", F.lit(".go")).alias("file"), F.lit(1).alias("line"),
        F.create_map(F.lit("method"), F.col("method"), F.lit("path"), F.col("path")).alias("meta"),
    )
    return contracts.link(rows, contracts.RULES[0]).edges.select("id", "confidence", "tier")


def normalized_paths(spark, sf_dir):
    """Channel keys of calls through the path normalisers."""
    chain = ["case_fold", "url_to_path", "query_strip", "param_wildcard", "trim_slash"]
    e = edges(spark, sf_dir).filter("label <> ''")
    return e.select("id", N.normalize_fields([F.substring_index("label", " ", 1), F.substring_index("label", " ", -1)], chain).alias("key"))


QUERY = ["session", "ledger"]


def _docs(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text", given(F.lower(F.trim("source"))).alias("type"))


def bm25_search(spark, sf_dir):
    """BM25 of every chunk that holds a query word."""
    return search.bm25(_docs(spark, sf_dir), QUERY).select("doc_id", F.round("score", 6).alias("score"))


def _lexical(spark, sf_dir, k: int) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return search.top_per_type(search.bm25(docs, QUERY).withColumn("score", F.round("score", 6)), docs.select("doc_id", "type"), k)


def fts_per_type(spark, sf_dir):
    """Best ten of every source."""
    return _lexical(spark, sf_dir, 10).select("doc_id", "type", F.col("rank").cast("bigint").alias("rank"))


def _vectors(spark, sf_dir) -> tuple[DataFrame, list[float]]:
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("type"))
    return v, [float(x) for x in v.filter("doc_id = 0").first()["vector"]]


def cosine_topk_per_type(spark, sf_dir):
    """Nearest five of every label to the first vector."""
    v, q = _vectors(spark, sf_dir)
    return search.cosine_top(v, q, 5).select("doc_id", "type", F.col("rank").cast("bigint").alias("rank"), F.round("score", 5).alias("score"))


def _cosine_each(spark, sf_dir, k: int) -> DataFrame:
    """Every vector whose id is divisible by 50 against all."""
    e = table(spark, sf_dir, "embeddings")
    v = e.select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), F.col("label").cast("string").alias("type"))
    q = e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return search.cosine_top_each(v, q, k)


def cosine_topk_per_query(spark, sf_dir):
    """Nearest five of every label to every vector whose id is divisible by 50."""
    return _cosine_each(spark, sf_dir, 5).select("query_id", "doc_id", "type", F.col("rank").cast("bigint").alias("rank"), F.round("score", 5).alias("score"))


def rrf_fusion(spark, sf_dir):
    """Lexical and vector ranks fused."""
    v, q = _vectors(spark, sf_dir)
    lexical = _lexical(spark, sf_dir, 50).select("doc_id", "rank")
    return search.rrf(lexical, search.cosine_top(v, q, 50).select("doc_id", "rank")).groupBy("doc_id", "match").agg(F.round(F.max("score"), 6).alias("score"))


def rrf_fusion_per_query(spark, sf_dir):
    """As rrf_fusion, for every vector whose id is divisible by 50."""
    queries = table(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"))
    lexical = _lexical(spark, sf_dir, 50).select("doc_id", "rank").crossJoin(queries)
    fused = search.rrf(lexical, _cosine_each(spark, sf_dir, 50).select("query_id", "doc_id", "rank"), by=("query_id",))
    return fused.groupBy("query_id", "doc_id", "match").agg(F.round(F.max("score"), 6).alias("score"))


def exact_first_search(spark, sf_dir):
    """The first 20 nodes for a name: exact labels, then production files."""
    return search.search_nodes(nodes(spark, sf_dir), "sinkhole sink", 20).select("id", "exact", F.col("n_words").cast("bigint").alias("n_words"))


def resolve_target(spark, sf_dir):
    return search.resolve_target(nodes(spark, sf_dir), "Sundry").select("id", "service")


def embed_delta(spark, sf_dir):
    """Chunks to embed again, where those of even ids are stored and unchanged."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("entity_id"), "text")
    stored = docs.filter("cast(entity_id AS bigint) % 2 = 0").select("entity_id", S.content_hash(F.col("text")).alias("content_hash"), F.lit("hashed-64").alias("embedder"))
    return search.stale_embeddings(docs, stored, "hashed-64").select("entity_id", "content_hash")


def doc_chunks(spark, sf_dir):
    """Sections and pieces of every chunk."""
    c = search.chunks(table(spark, sf_dir, "documents"))
    return c.groupBy("doc_id").agg(F.countDistinct("section_no").alias("n_sections"), F.count("*").alias("n_pieces"), F.sum(F.length("text").cast("bigint")).alias("n_chars"))


def rank_margins(spark, sf_dir):
    """Lead of the best vector of every label over the second."""
    v, q = _vectors(spark, sf_dir)
    return search.rank_margin(search.cosine_top(v, q, 2).select("type", "doc_id", "score"), ["type"]).select("type", "doc_id", F.round("margin", 2).alias("margin"))


def rank_margins_per_query(spark, sf_dir):
    """As rank_margins, for every vector whose id is divisible by 50."""
    rows = _cosine_each(spark, sf_dir, 2).select("query_id", "type", "doc_id", "score")
    return search.rank_margin(rows, ["query_id", "type"]).select("query_id", "type", "doc_id", F.round("margin", 2).alias("margin"))


def _eval(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "eval_baseline").select("run_id", "repo", F.lower(F.trim("case_id")).alias("case_id"), "kind", "recall", "precision_score", "honest_misses", "silent_misses", "hard_fail")
    return rows.distinct()


def eval_report(spark, sf_dir):
    """Macro averages of every repository."""
    return evaluation.corpus_report(_eval(spark, sf_dir), ["repo"])


def eval_gate(spark, sf_dir):
    """Cases of the last run that are worse than in the first run that has them."""
    rows = _eval(spark, sf_dir)
    first = graph_store.latest(rows.withColumn("__o", -F.col("run_id")), ["repo", "case_id"], ["__o", "recall", "precision_score", "silent_misses", "hard_fail"])
    last = graph_store.latest(rows, ["repo", "case_id"], ["run_id", "recall", "precision_score", "silent_misses", "hard_fail"])
    return evaluation.regression_gate(last, first, ["repo", "case_id"])


def _calls(spark, sf_dir) -> DataFrame:
    cols = ("id", "ts", "duration_ms", "result_bytes", "status", "error")
    return table(spark, sf_dir, "tool_calls").select(*cols, F.lower(F.trim("tool")).alias("tool"), F.lower(F.trim("source")).alias("source")).distinct()


def arm_summary(spark, sf_dir):
    """Mean duration by source of the call; failed calls count apart."""
    calls = _calls(spark, sf_dir).filter("duration_ms >= 0")
    return evaluation.arm_summary(calls, "source", "duration_ms", "error")


def ab_pairing_median(spark, sf_dir):
    """Median change in duration from ui to mcp calls over (tool, hour)."""
    calls = _calls(spark, sf_dir).filter("duration_ms >= 0").withColumn("hour", F.date_format("ts", "yyyy-MM-dd HH"))
    return evaluation.pairing(calls, ["tool", "hour"], "source", "duration_ms", "ui", "mcp")


def promoted_gaps(spark, sf_dir):
    """Eval cases for observed gaps, none of them covered yet."""
    return evaluation.promoted_gaps(edges(spark, sf_dir), table(spark, sf_dir, "eval_baseline")).select("case_id", "src", "dst", "type")


def case_scores(spark, sf_dir):
    """Recall of labelled services: labels expected, half of them returned, some in the ledger."""
    n = nodes(spark, sf_dir).filter("label <> '' AND service <> ''")
    item = lambda t: n.filter(F.col("type").isin(*t)).select(F.col("service").alias("case_id"), F.col("label").alias("item"))
    return evaluation.case_scores(item(["function", "method"]), item(["function", "class"]), item(["method", "struct"])).select("case_id", "n_expected", "n_hits", "honest_misses", "silent_misses", F.round("recall", 6).alias("recall"))


def promotion_diff(spark, sf_dir):
    """Imports that reads do not cover, and reads that imports do not, by (src, dst)."""
    e = edges(spark, sf_dir)
    return evaluation.set_diff(e.filter("type = 'imports'"), e.filter("type = 'reads'"), ["src", "dst"]).groupBy("side").agg(F.count("*").alias("n"))


def _history(spark, sf_dir) -> DataFrame:
    return history.run_counts(table(spark, sf_dir, "events").withColumn("run_at", F.to_date("ts")), ["event_type"])


def trend_delta(spark, sf_dir):
    return history.trend(_history(spark, sf_dir), ["event_type"], 5)


def growth_flags(spark, sf_dir):
    """Users whose events grew on their last three days."""
    rows = history.run_counts(table(spark, sf_dir, "events").withColumn("run_at", F.to_date("ts")), ["user_id"])
    return history.growth(rows, ["user_id"], 3)


def budget_prefix(spark, sf_dir):
    """Chunks of every source, by id, within 50,000 characters."""
    docs = _docs(spark, sf_dir).select("doc_id", "type", F.length("text").cast("bigint").alias("cost"))
    return history.budget_prefix(docs, ["type"], ["doc_id"], "cost", 50_000).select("doc_id", "type", "used")


def budget_backfill(spark, sf_dir):
    """As budget_prefix, with later chunks that still fit."""
    docs = _docs(spark, sf_dir).select("doc_id", "type", F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("cost"))
    return history.backfill(docs, "type", "doc_id", "cost", 50_000)


def per_file_caps(spark, sf_dir):
    """Nodes shown and dropped at five a file."""
    n = nodes(spark, sf_dir).filter("file <> ''").withColumn("key", F.concat_ws(":", "service", "file"))
    return history.per_file_cap(n, "key", [F.col("line"), F.col("id")], 5)


def previous_click(spark, sf_dir):
    """The last click at or before every purchase of a user."""
    ev = table(spark, sf_dir, "events")
    out = history.asof_previous(ev, "user_id", "ts", "event_id", F.col("event_type") == "purchase", F.col("event_type") == "click", "event_id")
    return out.select("event_id", F.coalesce("previous", F.lit(-1)).alias("click_id"))


def _streamed(spark, sf_dir, build) -> DataFrame:
    """Runs a query over the event log as a stream and reads what it wrote."""
    schema = table(spark, sf_dir, "events").schema
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    source = spark.readStream.schema(schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out")

    out = build(source)
    query = out.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out")


def stream_tumbling_counts(spark, sf_dir):
    """Events of every type in each six hours, as a stream."""
    out = _streamed(spark, sf_dir, lambda s: streaming.windowed_counts(s, "ts", ["event_type"], "6 hours"))
    return out.select(F.col("window_start").cast("string").alias("window_start"), "event_type", "n")


def stream_sliding_counts(spark, sf_dir):
    """Events in a day, every six hours, as a stream."""
    out = _streamed(spark, sf_dir, lambda s: streaming.windowed_counts(s, "ts", [], "1 day", "6 hours"))
    return out.select(F.col("window_start").cast("string").alias("window_start"), "n")


def stream_sessions(spark, sf_dir):
    """Sessions of users with gaps below two hours, as a stream."""
    out = _streamed(spark, sf_dir, lambda s: streaming.sessions(s, "ts", "user_id", "2 hours"))
    return out.select("user_id", F.col("session_start").cast("string").alias("session_start"), "n")


QUERIES = {
    f.__name__: f
    for f in (
        reconcile_states, reconcile_report, runtime_coverage, provider_pairs, rule_proposals, evidence_fusion, yield_scorecard, yield_gate, ledger_retraction,
        provider_files, epistemic_verdicts, compact_sources, spans_parent_child, spans_flow_records, spans_messaging_flows, spans_event_streams, spans_key_matches, span_outcomes, span_outcomes_by_kind, session_summaries, session_coverage,
        contract_http, normalized_paths, bm25_search, fts_per_type, cosine_topk_per_type, cosine_topk_per_query, rrf_fusion, rrf_fusion_per_query, exact_first_search, resolve_target, embed_delta,
        doc_chunks, rank_margins, rank_margins_per_query, eval_report, eval_gate, arm_summary, ab_pairing_median, promoted_gaps, case_scores, promotion_diff, trend_delta,
        growth_flags, budget_prefix, budget_backfill, per_file_caps, previous_click, stream_tumbling_counts, stream_sliding_counts, stream_sessions,
    )
}

_HAS = "len(list_filter(coalesce(sources, []), lambda s: s.provider IN ({}))) > 0"
_STATE = (
    f", r0 AS (SELECT *, CASE WHEN {_HAS.format(chr(39) + 'static' + chr(39))} AND ({_HAS.format(chr(39) + 'runtime' + chr(39) + ', ' + chr(39) + 'config' + chr(39))} OR ({_HAS.format(chr(39) + 'contract' + chr(39))} AND confidence <> 'partial')) THEN 'verified' "
    f"WHEN {_HAS.format(chr(39) + 'static' + chr(39))} THEN 'candidate' WHEN {_HAS.format(chr(39) + 'runtime' + chr(39) + ', ' + chr(39) + 'config' + chr(39) + ', ' + chr(39) + 'contract' + chr(39))} THEN 'observed_only_gap' ELSE 'candidate' END AS state0 FROM e), "
    "r AS (SELECT *, CASE WHEN state0 = 'observed_only_gap' AND label <> '' AND (type, label) IN (SELECT (type, label) FROM r0 WHERE state0 = 'verified') THEN 'conflicting' ELSE state0 END AS state FROM r0)"
)
_NONRES = "('contains','declares','reads','writes','captures','flows_to','uses_type','inherits','implements','instantiates','imports','defined_in','component_impl','datastar_bind','navigates_to','dom_read','dom_write','dom_create','dom_remove','dom_listen')"
_LIST = "array_to_string(list_sort(list_distinct(list({}))), ',')"
_YIELD = (
    W
    + f""", y AS (SELECT e.type AS class, CASE WHEN a.service <> '' AND a.service = b.service THEN 'internal' ELSE 'cross' END AS scope,
  CASE WHEN b.type = 'external_service' THEN 'external' WHEN e.verification_state IN ('verified', 'observed_only_gap') THEN 'runtime' ELSE 'static' END AS kind
  FROM e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst WHERE e.type NOT IN {_NONRES}
  UNION ALL SELECT type, CASE WHEN dst = 'unresolved' THEN 'internal' ELSE 'cross' END, 'unresolved' FROM edges WHERE (dst = 'unresolved' OR starts_with(dst, 'unresolved:')) AND trim(src) <> ''),
c AS (SELECT class, scope, count(*) FILTER (kind = 'static') AS n_static, count(*) FILTER (kind = 'runtime') AS n_runtime, count(*) FILTER (kind = 'external') AS n_external,
  count(*) FILTER (kind = 'unresolved') AS n_unresolved, count(*) AS n_resolvable FROM y GROUP BY 1, 2)
"""
)
def _attr(name: str) -> str:
    got = f"list_filter(json_extract(p, '$.attributes[*]'), lambda x: coalesce(json_extract_string(x, '$.key'), '') = '{name}')[1]"
    return "coalesce(" + ", ".join(f"json_extract_string({got}, '$.value.{t}')" for t in ("stringValue", "intValue", "doubleValue", "boolValue")) + ", '')"


def _first(*names: str) -> str:
    return "coalesce(" + ", ".join(f"nullif({_attr(n)}, '')" for n in names) + ", '')"


def _spans_sql(by_kind: bool = False, sse: tuple[str, ...] = (), names: tuple[tuple[str, str], ...] = ()) -> str:
    """Spans, calls, links, key matches, lone producers and flows."""
    told = "WHEN op = '' THEN CASE WHEN kind = 'PRODUCER' THEN 'publish' ELSE 'consume' END" if by_kind else ""
    routes = f"sv IN ({', '.join(repr(r) for r in sse)})" if sse else "false"
    renamed = "CASE raw_service " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in names) + " ELSE raw_service END" if names else "raw_service"
    return (
        """WITH b AS (SELECT export_id, min(session) AS session, min(body) AS body FROM otlp_exports WHERE json_valid(body) AND json_type(body) = 'OBJECT' GROUP BY export_id),
sr AS (SELECT session, unnest(json_extract(body, '$.resourceSpans[*]')) AS r FROM b),
ss AS (SELECT session, r, unnest(json_extract(r, '$.scopeSpans[*]')) AS s FROM sr),
sp AS (SELECT * FROM (SELECT session, coalesce(json_extract_string(list_filter(json_extract(r, '$.resource.attributes[*]'), lambda x: json_extract_string(x, '$.key') = 'service.name')[1], '$.value.stringValue'), '') AS raw_service,
  unnest(json_extract(s, '$.spans[*]')) AS p FROM ss) WHERE json_type(p) = 'OBJECT'),
sa AS (SELECT session, raw_service, p, coalesce(json_extract_string(p, '$.traceId'), '') AS trace_id, coalesce(json_extract_string(p, '$.spanId'), '') AS span_id, coalesce(json_extract_string(p, '$.parentSpanId'), '') AS ps,
  json_extract_string(p, '$.kind') AS k, json_extract_string(p, '$.startTimeUnixNano') AS start_ns, """
        + f"""{_first('http.request.method', 'http.method')} AS m, {_first('http.route', 'url.path', 'http.target')} AS sv, {_attr('url.full')} AS cv, {_attr('http.response.header.content-type')} AS ct,
  lower({_attr('messaging.system')}) AS ms, {_attr('messaging.destination.name')} AS md, {_attr('messaging.rabbitmq.destination.routing_key')} AS mr, {_first('messaging.operation.type', 'messaging.operation')} AS op,
  {_attr('code.filepath')} AS code_file, {_attr('code.function')} AS code_func,
  array_to_string(list_sort(list_distinct(list_transform(json_extract(p, '$.links[*]'), lambda x: coalesce(json_extract_string(x, '$.traceId'), '') || '/' || coalesce(json_extract_string(x, '$.spanId'), '')))), ',') AS links FROM sp),
sb AS (SELECT session, raw_service, {renamed} AS service, trace_id, span_id, CASE WHEN regexp_full_match(ps, '[\\s0]*') THEN '' ELSE ps END AS parent_span_id, start_ns, links, code_file, code_func,
  CASE WHEN TRY_CAST(k AS INT) BETWEEN 0 AND 5 THEN list_extract(['UNSPECIFIED', 'INTERNAL', 'SERVER', 'CLIENT', 'PRODUCER', 'CONSUMER'], CAST(TRY_CAST(k AS INT) + 1 AS INT)) ELSE replace(upper(k), 'SPAN_KIND_', '') END AS kind,
  lower(m) AS m, sv, cv, ct, ms, md, mr, op FROM sa),
sc AS (SELECT *, kind IN ('PRODUCER', 'CONSUMER') AS msg, CASE WHEN m = '' THEN '' WHEN kind = 'SERVER' THEN sv ELSE cv END AS path FROM sb),
sd AS (SELECT *, CASE WHEN msg THEN CASE WHEN ms = 'rabbitmq' THEN 'amqp' WHEN ms IN ('kafka', 'nats') THEN ms ELSE 'job' END WHEN m = '' THEN '' WHEN kind = 'SERVER' AND (contains(lower(ct), 'text/event-stream') OR {routes}) THEN 'sse' ELSE 'http' END AS kind_of,
  CASE WHEN contains(path, '://') THEN CASE WHEN regexp_extract(lower(path), '://[^/]*(/.*)$', 1) = '' THEN '/' ELSE regexp_extract(lower(path), '://[^/]*(/.*)$', 1) END ELSE lower(path) END AS p1 FROM sc),
se AS (SELECT *, regexp_replace(regexp_replace(string_split(p1, '?')[1], ':[^/]+', '*', 'g'), '\\{{[^}}]+\\}}', '*', 'g') AS p2 FROM sd),
sf AS (SELECT *, CASE WHEN p2 = '' THEN '' WHEN regexp_replace(p2, '/+$', '') = '' THEN '/' ELSE regexp_replace(p2, '/+$', '') END AS p3 FROM se),
s AS (SELECT DISTINCT session, raw_service, service, trace_id, span_id, parent_span_id, kind, start_ns, links, code_file, code_func, kind_of,
  CASE WHEN msg THEN CASE WHEN md = '' THEN '' WHEN kind_of = 'amqp' AND mr <> '' THEN md || ' ' || mr ELSE md END WHEN path = '' THEN '' WHEN kind_of = 'sse' THEN p3 ELSE trim(m || ' ' || p3) END AS key,
  CASE WHEN NOT msg THEN '' WHEN op IN ('publish', 'send') THEN 'publish' WHEN op IN ('process', 'receive') THEN 'consume' {told} ELSE '' END AS role FROM sf),
u AS (SELECT session, trace_id, span_id, max((kind, raw_service, service)) AS v FROM s WHERE span_id <> '' GROUP BY 1, 2, 3),
ca AS (SELECT d.*, CASE WHEN u.v[2] <> d.raw_service THEN u.v[3] END AS up FROM s d LEFT JOIN u ON u.session = d.session AND u.trace_id = d.trace_id AND u.span_id = d.parent_span_id AND u.v[1] = 'CLIENT' AND d.parent_span_id <> ''
  WHERE d.kind = 'SERVER' AND d.service <> '' AND d.kind_of <> '' AND d.key <> ''),
pc AS (SELECT *, up AS src_service FROM ca WHERE up <> ''),
cs AS (SELECT * FROM s WHERE role = 'consume' AND service <> '' AND key <> ''),
pr AS (SELECT * FROM s WHERE role = 'publish' AND service <> '' AND key <> ''),
ln AS (SELECT d.*, u.v[3] AS src_service FROM (SELECT *, unnest(string_split(links, ',')) AS lk FROM cs WHERE links <> '') d JOIN u ON u.session = d.session AND u.trace_id || '/' || u.span_id = d.lk AND u.v[1] = 'PRODUCER' AND u.v[3] <> ''),
lf AS (SELECT * FROM cs ANTI JOIN ln USING (session, trace_id, span_id, raw_service, kind_of, key)),
km AS (SELECT d.*, q.src_service FROM lf d JOIN (SELECT DISTINCT session, kind_of, key, service AS src_service FROM pr) q USING (session, kind_of, key)),
al AS (SELECT * FROM pr ANTI JOIN km USING (session, kind_of, key) WHERE (session, trace_id || '/' || span_id) NOT IN (SELECT (session, lk) FROM ln)),
fa AS (SELECT kind_of, key, coalesce(up, '') AS src_service, service AS dst_service, CASE WHEN coalesce(up, '') <> '' THEN 'parent_child' ELSE 'server_only' END AS causality, trace_id, session, CAST(start_ns AS BIGINT) AS ns, span_id FROM ca
  UNION ALL SELECT kind_of, key, src_service, service, 'link', trace_id, session, CAST(start_ns AS BIGINT), span_id FROM ln UNION ALL SELECT kind_of, key, src_service, service, 'key_match', trace_id, session, CAST(start_ns AS BIGINT), span_id FROM km
  UNION ALL SELECT kind_of, key, service, '', 'key_match', trace_id, session, CAST(start_ns AS BIGINT), span_id FROM al),
fl AS (SELECT kind_of, key, src_service, dst_service, arg_min(causality, (session, trace_id, ns, span_id, causality)) AS causality, count(DISTINCT trace_id) AS n_traces, count(DISTINCT session) AS n_sessions, count(DISTINCT (session, trace_id)) AS n_refs FROM fa GROUP BY 1, 2, 3, 4),
us AS (SELECT DISTINCT session, trace_id, parent_span_id AS span_id FROM ca WHERE up IS NOT NULL),
mt AS (SELECT DISTINCT session, trace_id, span_id, raw_service, kind_of, key FROM (SELECT session, trace_id, span_id, raw_service, kind_of, key FROM ln UNION ALL SELECT session, trace_id, span_id, raw_service, kind_of, key FROM km)),
oc AS (SELECT s.kind, CASE WHEN s.kind = 'SERVER' THEN CASE WHEN service = '' THEN 'unknown_service' WHEN s.kind_of = '' THEN 'unsupported_span_kind' WHEN s.key = '' THEN 'no_route_or_path' ELSE 'flow' END
  WHEN s.kind IN ('PRODUCER', 'CONSUMER') THEN CASE WHEN service = '' THEN 'unknown_service' WHEN s.key = '' THEN 'no_route_or_path' WHEN role = '' THEN 'unsupported_span_kind' WHEN role = 'publish' OR mt.key IS NOT NULL THEN 'flow' ELSE 'no_causality' END
  WHEN s.kind = 'CLIENT' AND us.span_id IS NOT NULL THEN CASE WHEN service = '' THEN 'unknown_service' ELSE 'matched_client' END WHEN s.kind = 'CLIENT' AND s.kind_of <> '' THEN 'no_causality' ELSE 'unsupported_span_kind' END AS outcome
  FROM s LEFT JOIN us ON us.session = s.session AND us.trace_id = s.trace_id AND us.span_id = s.span_id
  LEFT JOIN mt ON mt.session = s.session AND mt.trace_id = s.trace_id AND mt.span_id = s.span_id AND mt.raw_service = s.raw_service AND mt.kind_of = s.kind_of AND mt.key = s.key)
"""
    )


_SPANS = _spans_sql()
_BM = """WITH d AS (SELECT doc_id, coalesce(lower(trim(source)), '') AS type, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS t FROM documents),
c AS (SELECT doc_id, type, len(t) AS len, len(list_filter(t, lambda w: starts_with(w, 'session'))) AS a, len(list_filter(t, lambda w: starts_with(w, 'ledger'))) AS b FROM d),
k AS (SELECT count(*) AS n, avg(len) AS av, count(*) FILTER (a > 0) AS na, count(*) FILTER (b > 0) AS nb FROM c),
bm AS (SELECT doc_id, type, round(CASE WHEN a > 0 THEN greatest(ln((n - na + 0.5) / (na + 0.5)), 1e-6) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * len / av)) ELSE 0 END
  + CASE WHEN b > 0 THEN greatest(ln((n - nb + 0.5) / (nb + 0.5)), 1e-6) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * len / av)) ELSE 0 END, 6) AS score FROM c, k WHERE a > 0 OR b > 0)
"""
_COS = """cq AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0),
cs AS (SELECT vec_id AS doc_id, CAST(label AS VARCHAR) AS type, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(q AS DOUBLE[])), 9) AS score FROM embeddings, cq),
cr AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY score DESC, doc_id) AS rank FROM cs)
"""
_COS_EACH = """es AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, CAST(e.label AS VARCHAR) AS type, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 9) AS score
  FROM embeddings e JOIN embeddings q ON q.vec_id % 50 = 0),
er AS (SELECT *, row_number() OVER (PARTITION BY query_id, type ORDER BY score DESC, doc_id) AS rank FROM es)
"""
_EVAL = "WITH v AS (SELECT DISTINCT run_id, repo, lower(trim(case_id)) AS case_id, kind, recall, precision_score, honest_misses, silent_misses, hard_fail FROM eval_baseline)"
_CALLS = "WITH c AS (SELECT DISTINCT id, ts, duration_ms, result_bytes, status, error, lower(trim(tool)) AS tool, lower(trim(source)) AS source FROM tool_calls)"

ORACLES = {
    "reconcile_states": W
    + _STATE
    + """SELECT id, state, CASE WHEN state <> 'verified' THEN '' WHEN len(list_filter(coalesce(sources, []), lambda s: s.provider = 'runtime' AND coalesce(s.code_file, '') <> '')) > 0 THEN 'site' ELSE 'channel' END AS granularity FROM r""",
    "reconcile_report": W
    + _STATE
    + """, g AS (SELECT type, count(*) FILTER (state = 'verified') AS n_verified, count(*) FILTER (state = 'candidate') AS n_candidate, count(*) FILTER (state = 'observed_only_gap') AS n_gap, count(*) FILTER (state = 'conflicting') AS n_conflicting FROM r GROUP BY 1),
q AS (SELECT type, array_to_string(list_sort(list(DISTINCT s.provider)), ',') AS providers FROM (SELECT type, unnest(sources) AS s FROM r) GROUP BY 1)
SELECT g.*, CASE WHEN n_verified + n_candidate > 0 THEN round(100.0 * n_verified / (n_verified + n_candidate), 4) ELSE 0.0 END AS pct_verified, coalesce(providers, '') AS providers FROM g LEFT JOIN q ON q.type = g.type""",
    "runtime_coverage": W
    + f"""SELECT type, count(*) AS n_edges, count(*) FILTER (verification_state = 'verified') AS n_verified, count(*) FILTER ({_HAS.format("'runtime'")}) AS n_observed
FROM e WHERE type IN ('http_call', 'sse_endpoint', 'publishes', 'kafka_publish', 'nats_publish', 'job_enqueue') GROUP BY type""",
    "provider_pairs": W + "SELECT array_to_string(list_sort(list_distinct(list_transform(coalesce(sources, []), lambda s: s.provider))), '+') AS providers, count(*) AS n FROM e GROUP BY 1",
    "rule_proposals": W + _STATE + "SELECT type, label, count(DISTINCT src) AS n_from, count(DISTINCT dst) AS n_to, count(*) AS n_edges FROM r WHERE state IN ('observed_only_gap', 'conflicting') AND label <> '' GROUP BY 1, 2",
    "evidence_fusion": W
    + f""", x AS (SELECT *, type || CASE WHEN label <> '' THEN '|l|' || label ELSE '|e|' || src || '|' || dst END AS ch FROM e),
st AS (SELECT *, list_distinct(list_transform(list_filter(sources, lambda s: s.provider = 'static'), lambda s: {{'p': s.provider, 'r': s.ref}})) AS own FROM x WHERE {_HAS.format("'static'")}),
ev AS (SELECT DISTINCT ch, src, dst, type, label, s.provider AS p, s.ref AS r FROM (SELECT ch, src, dst, type, label, unnest(sources) AS s FROM x) WHERE s.provider <> 'static'),
kn AS (SELECT st.id, st.type, len(any_value(st.own)) + count(DISTINCT (ev.p, ev.r)) FILTER (ev.ch IS NOT NULL) AS k FROM st LEFT JOIN ev ON ev.ch = st.ch GROUP BY 1, 2),
gp AS (SELECT DISTINCT type, src, dst, label FROM ev WHERE ch NOT IN (SELECT ch FROM st))
SELECT t.type, (SELECT count(*) FROM gp WHERE gp.type = t.type) AS n_gaps, (SELECT count(*) FROM kn WHERE kn.type = t.type) AS n_static, (SELECT count(*) FROM kn WHERE kn.type = t.type AND k > 1) AS n_confirmed
FROM (SELECT type FROM kn UNION SELECT type FROM gp) t""",
    "yield_scorecard": _YIELD + """SELECT *, round((n_resolvable - n_unresolved) / n_resolvable, 6) AS "yield" FROM c""",
    "yield_gate": _YIELD
    + """SELECT scope, round(reached, 6) AS reached, reached >= CASE WHEN scope = 'internal' THEN 1.0 ELSE 0.95 END - 1e-9 AS "pass"
FROM (SELECT scope, CAST(CASE WHEN scope = 'internal' THEN sum(n_static + n_external + n_runtime) ELSE sum(n_static + n_external) END AS DOUBLE) / sum(n_resolvable) AS reached FROM c GROUP BY scope)""",
    "ledger_retraction": W
    + """, w AS (SELECT DISTINCT a.service, a.file, b.label FROM e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst WHERE e.type = 'calls')
SELECT service, count(*) AS n FROM n WHERE type = 'function' AND (service, file, label) NOT IN (SELECT (service, file, label) FROM w) GROUP BY service""",
    "provider_files": W
    + f""", x AS (SELECT id, type, unnest(sources) AS s FROM e), y AS (SELECT id, type, s.provider AS provider, regexp_replace(coalesce(s.ref, ''), ':[0-9]+$', '') AS file FROM x)
SELECT provider, file, count(DISTINCT id) AS n_edges, {_LIST.format('type')} AS types FROM y WHERE file <> '' GROUP BY 1, 2""",
    "epistemic_verdicts": W
    + """, q AS (SELECT *, list_filter(coalesce(sources, []), lambda s: s.provider = 'runtime') AS rt FROM e),
g AS (SELECT type, count(*) FILTER (verification_state = 'candidate') AS c, count(*) FILTER (verification_state = 'observed_only_gap') AS g, count(*) FILTER (verification_state = 'conflicting') AS x,
  count(*) FILTER (verification_state = 'verified' AND len(rt) > 0 AND list_max(list_transform(rt, lambda s: s.observed_at)) < 1750000000 - 2592000) AS s FROM q GROUP BY 1)
SELECT type, array_to_string(list_filter([CASE WHEN c > 0 THEN 'candidate_edges' END, CASE WHEN x > 0 THEN 'conflicting_evidence' END, CASE WHEN g > 0 THEN 'observed_gaps' END, CASE WHEN s > 0 THEN 'stale_evidence' END], lambda y: y IS NOT NULL), ',') AS causes FROM g""",
    "compact_sources": W
    + """SELECT id, array_to_string(list_sort(list_transform(coalesce(sources, []), lambda s: s.provider || ':' || coalesce(s.ref, '') || CASE WHEN s.observed_at > 0 AND 1750000000 - s.observed_at > 0 THEN ' (' ||
  CASE WHEN 1750000000 - s.observed_at >= 86400 THEN CAST((1750000000 - s.observed_at) // 86400 AS VARCHAR) || 'd' WHEN 1750000000 - s.observed_at >= 3600 THEN CAST((1750000000 - s.observed_at) // 3600 AS VARCHAR) || 'h'
  ELSE CAST((1750000000 - s.observed_at) // 60 AS VARCHAR) || 'm' END || ')' ELSE '' END)), '; ') AS sources FROM e""",
    "spans_parent_child": _SPANS + "SELECT src_service, service AS dst_service, count(*) AS n, count(DISTINCT trace_id) AS n_traces FROM pc GROUP BY 1, 2",
    "spans_flow_records": _SPANS + "SELECT * FROM fl",
    "spans_messaging_flows": _spans_sql(True) + "SELECT * FROM fl WHERE kind_of NOT IN ('http', 'sse')",
    "spans_event_streams": _spans_sql(sse=SSE_ROUTES) + "SELECT * FROM fl WHERE kind_of = 'sse'",
    "spans_key_matches": _spans_sql(True) + "SELECT session, kind_of, key, src_service, service AS dst_service, count(*) AS n FROM km GROUP BY 1, 2, 3, 4, 5",
    "span_outcomes": _SPANS + "SELECT outcome, kind, count(*) AS n_spans FROM oc GROUP BY 1, 2",
    "span_outcomes_by_kind": _spans_sql(True, names=(("anvil", "forge"),)) + "SELECT outcome, kind, count(*) AS n_spans FROM oc GROUP BY 1, 2",
    "session_summaries": _SPANS + "SELECT session, count(*) AS n_spans, count(DISTINCT trace_id) AS n_traces, array_to_string(list_sort(list_distinct(list(service) FILTER (service <> ''))), ',') AS services FROM s GROUP BY session",
    "bm25_search": _BM + "SELECT doc_id, score FROM bm",
    "fts_per_type": _BM + "SELECT doc_id, type, row_number() OVER (PARTITION BY type ORDER BY score DESC, doc_id) AS rank FROM bm QUALIFY rank <= 10",
    "cosine_topk_per_type": "WITH " + _COS + "SELECT doc_id, type, rank, round(score, 5) AS score FROM cr WHERE rank <= 5",
    "cosine_topk_per_query": "WITH " + _COS_EACH + "SELECT query_id, doc_id, type, rank, round(score, 5) AS score FROM er WHERE rank <= 5",
    "rrf_fusion_per_query": _BM
    + ", l AS (SELECT bm.doc_id, bm.type, row_number() OVER (PARTITION BY type ORDER BY score DESC, doc_id) AS rank FROM bm QUALIFY rank <= 50), lq AS (SELECT q.vec_id AS query_id, l.doc_id, l.rank FROM l JOIN embeddings q ON q.vec_id % 50 = 0), "
    + _COS_EACH
    + """SELECT query_id, doc_id, match, round(max(score), 6) AS score FROM (SELECT coalesce(l.query_id, v.query_id) AS query_id, coalesce(l.doc_id, v.doc_id) AS doc_id, CASE WHEN l.doc_id IS NOT NULL AND v.doc_id IS NOT NULL THEN 'fused' WHEN l.doc_id IS NOT NULL THEN 'lexical' ELSE 'semantic' END AS match,
  coalesce(1.0 / (60 + l.rank), 0) + coalesce(1.0 / (60 + v.rank), 0) AS score FROM lq l FULL JOIN (SELECT * FROM er WHERE rank <= 50) v ON v.doc_id = l.doc_id AND v.query_id = l.query_id) GROUP BY 1, 2, 3""",
    "rank_margins_per_query": "WITH " + _COS_EACH
    + "SELECT a.query_id, a.type, a.doc_id, round(round(coalesce(a.score - b.score, 0), 3), 2) AS margin FROM er a LEFT JOIN er b ON b.query_id = a.query_id AND b.type = a.type AND b.rank = 2 WHERE a.rank = 1",
    "rrf_fusion": _BM
    + ", l AS (SELECT doc_id, row_number() OVER (PARTITION BY type ORDER BY score DESC, doc_id) AS rank FROM bm QUALIFY rank <= 50), "
    + _COS
    + """SELECT doc_id, match, round(max(score), 6) AS score FROM (SELECT coalesce(l.doc_id, v.doc_id) AS doc_id, CASE WHEN l.doc_id IS NOT NULL AND v.doc_id IS NOT NULL THEN 'fused' WHEN l.doc_id IS NOT NULL THEN 'lexical' ELSE 'semantic' END AS match,
  coalesce(1.0 / (60 + l.rank), 0) + coalesce(1.0 / (60 + v.rank), 0) AS score FROM l FULL JOIN (SELECT * FROM cr WHERE rank <= 50) v ON v.doc_id = l.doc_id) GROUP BY 1, 2""",
    "exact_first_search": W
    + """, t AS (SELECT *, list_filter(regexp_split_to_array(lower(label || ' ' || file || ' ' || service), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS w FROM n),
m AS (SELECT *, CAST(len(list_filter(w, lambda x: starts_with(x, 'sinkhole'))) > 0 AS INT) + CAST(len(list_filter(w, lambda x: starts_with(x, 'sink'))) > 0 AS INT) AS n_words FROM t)
SELECT id, CAST(lower(trim(label)) IN ('sinkhole sink', 'sinkhole', 'sink') AS INT) AS exact, CAST(n_words AS BIGINT) AS n_words FROM m WHERE n_words > 0
ORDER BY exact DESC, CASE WHEN regexp_matches(lower(file), '_test\\.go$|_test\\.py$|^test_|/test_|_spec\\.rb$|_test\\.rb$|\\.test\\.|\\.spec\\.|^spec/|/spec/|^test/|/test/|^tests/|/tests/|/__tests__/') THEN 1 ELSE 0 END, n_words DESC, id LIMIT 20""",
    "resolve_target": W + "SELECT id, service FROM n WHERE lower(label) = 'sundry'",
    "embed_delta": "SELECT CAST(doc_id AS VARCHAR) AS entity_id, sha256(text) AS content_hash FROM documents WHERE doc_id % 2 <> 0",
    "rank_margins": "WITH " + _COS + "SELECT a.type, a.doc_id, round(round(coalesce(a.score - b.score, 0), 3), 2) AS margin FROM cr a LEFT JOIN cr b ON b.type = a.type AND b.rank = 2 WHERE a.rank = 1",
    "eval_report": _EVAL
    + """SELECT repo, count(*) AS n_cases, floor(sum(CAST(round(CASE WHEN NOT isnan(recall) THEN recall END * 1e6) AS BIGINT)) / count(recall) FILTER (NOT isnan(recall))) / 1e6 AS recall, floor(sum(CAST(round(CASE WHEN NOT isnan(precision_score) THEN precision_score END * 1e6) AS BIGINT)) / count(precision_score) FILTER (NOT isnan(precision_score))) / 1e6 AS precision_mean,
  CAST(sum(honest_misses) AS BIGINT) AS honest_misses, CAST(sum(silent_misses) AS BIGINT) AS silent_misses, count(*) FILTER (hard_fail) AS hard_fails FROM v GROUP BY repo""",
    "eval_gate": _EVAL
    + """, o AS (SELECT repo, case_id, arg_max(v, (run_id, recall, precision_score, silent_misses, hard_fail)) AS c, arg_max(v, (-run_id, recall, precision_score, silent_misses, hard_fail)) AS b FROM v GROUP BY 1, 2),
g AS (SELECT repo, case_id, CASE WHEN c.hard_fail AND NOT b.hard_fail THEN 'new_hard_fail' WHEN NOT isnan(c.recall) AND NOT isnan(b.recall) AND c.recall < b.recall - 1e-9 THEN 'recall_drop' WHEN c.silent_misses > b.silent_misses THEN 'silent_miss_rise'
  WHEN NOT isnan(c.precision_score) AND NOT isnan(b.precision_score) AND c.precision_score < b.precision_score - 1e-9 THEN 'precision_drop' END AS reason FROM o)
SELECT * FROM g WHERE reason IS NOT NULL""",
    "arm_summary": _CALLS
    + """SELECT source, count(*) AS n_trials, count(*) FILTER (coalesce(error, '') <> '') AS n_errors, floor(10000 * sum(duration_ms) FILTER (coalesce(error, '') = '') / count(*) FILTER (coalesce(error, '') = '')) / 10000 AS mean_value FROM c WHERE duration_ms >= 0 GROUP BY source""",
    "ab_pairing_median": _CALLS
    + """, g AS (SELECT tool, strftime(ts, '%Y-%m-%d %H') AS h, avg(duration_ms) FILTER (source = 'ui') AS a, avg(duration_ms) FILTER (source = 'mcp') AS b FROM c WHERE duration_ms >= 0 GROUP BY 1, 2)
SELECT count(*) AS n_pairs, round(median(100.0 * (a - b) / a), 6) AS median_reduction FROM g WHERE a > 0 AND b IS NOT NULL""",
    "promoted_gaps": W + "SELECT DISTINCT 'gap-' || substr(sha256(src || chr(1) || dst || chr(1) || type), 1, 12) AS case_id, src, dst, type FROM e WHERE verification_state = 'observed_only_gap'",
    "case_scores": W
    + """, x AS (SELECT service AS case_id, label AS item, bool_or(type IN ('function', 'method')) AS e, bool_or(type IN ('function', 'class')) AS r, bool_or(type IN ('method', 'struct')) AS l
  FROM n WHERE label <> '' AND service <> '' AND type IN ('function', 'method', 'class', 'struct') GROUP BY 1, 2),
g AS (SELECT case_id, count(*) FILTER (e) AS n_expected, count(*) FILTER (e AND r) AS n_hits, count(*) FILTER (e AND NOT r AND l) AS honest_misses, count(*) FILTER (e AND NOT r AND NOT l) AS silent_misses FROM x GROUP BY 1)
SELECT *, CASE WHEN n_expected = 0 THEN 1.0 ELSE round(n_hits / n_expected, 6) END AS recall FROM g""",
    "promotion_diff": W
    + """, a AS (SELECT src, dst FROM e WHERE type = 'imports'), b AS (SELECT src, dst FROM e WHERE type = 'reads')
SELECT 'missing' AS side, count(*) AS n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) HAVING count(*) > 0 UNION ALL SELECT 'extra', count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a) HAVING count(*) > 0""",
    "trend_delta": """WITH h AS (SELECT event_type, CAST(ts AS DATE) AS d, count(*) AS k FROM events GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY d DESC) AS rn, count(*) OVER (PARTITION BY event_type) AS runs FROM h)
SELECT event_type, max(k) FILTER (rn = 1) AS latest, max(k) FILTER (rn = least(5, runs)) AS baseline, max(runs) AS runs, max(k) FILTER (rn = 1) - max(k) FILTER (rn = least(5, runs)) AS delta FROM r GROUP BY 1""",
    "growth_flags": """WITH h AS (SELECT user_id, CAST(ts AS DATE) AS d, count(*) AS k FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY d DESC) AS rn FROM h)
SELECT a.user_id FROM r a JOIN r b ON b.user_id = a.user_id AND b.rn = 2 JOIN r c ON c.user_id = a.user_id AND c.rn = 3 WHERE a.rn = 1 AND a.k > b.k AND b.k > c.k""",
    "budget_prefix": """WITH d AS (SELECT doc_id, coalesce(lower(trim(source)), '') AS type, length(text) AS cost FROM documents),
r AS (SELECT doc_id, type, CAST(sum(cost) OVER w AS BIGINT) AS used, row_number() OVER w AS k FROM d WINDOW w AS (PARTITION BY type ORDER BY doc_id)) SELECT doc_id, type, used FROM r WHERE used <= 50000 OR k = 1""",
    "budget_backfill": """WITH RECURSIVE d AS (SELECT doc_id, coalesce(lower(trim(source)), '') AS type, coalesce(length(text), 0) AS cost, row_number() OVER (PARTITION BY coalesce(lower(trim(source)), '') ORDER BY doc_id) AS r FROM documents),
w AS (SELECT doc_id, type, cost, r, cost AS used, true AS fits FROM d WHERE r = 1
  UNION ALL SELECT d.doc_id, d.type, d.cost, d.r, CASE WHEN w.used + d.cost <= 50000 THEN w.used + d.cost ELSE w.used END, w.used + d.cost <= 50000 FROM w JOIN d ON d.type = w.type AND d.r = w.r + 1)
SELECT doc_id, type, CAST(cost AS BIGINT) AS cost FROM w WHERE fits""",
    "per_file_caps": W + "SELECT service || ':' || file AS key, least(count(*), 5) AS n_shown, greatest(count(*) - 5, 0) AS n_dropped FROM n WHERE file <> '' GROUP BY 1",
    "previous_click": """SELECT p.event_id, coalesce((SELECT arg_max(c.event_id, (c.ts, c.event_id)) FROM events c WHERE c.user_id = p.user_id AND c.event_type = 'click' AND (c.ts, c.event_id) <= (p.ts, p.event_id)), -1) AS click_id FROM events p WHERE p.event_type = 'purchase'""",
    "stream_tumbling_counts": """SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2""",
    "stream_sliding_counts": """SELECT strftime(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') - INTERVAL 6 HOUR * k, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n FROM events, range(4) r(k) GROUP BY 1""",
    "stream_sessions": """WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM o) SELECT user_id, rtrim(strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f'), '0') AS session_start, count(*) AS n FROM s GROUP BY user_id, k""",
    "normalized_paths": W
    + """, x AS (SELECT id, lower(string_split(label, ' ')[1]) AS m, lower(string_split(label, ' ')[-1]) AS p FROM e WHERE label <> ''),
y AS (SELECT id, m, regexp_replace(regexp_replace(string_split(p, '?')[1], ':[^/]+', '*', 'g'), '\\{[^}]+\\}', '*', 'g') AS p FROM x)
SELECT id, m || ' ' || CASE WHEN p = '' THEN '' WHEN regexp_replace(p, '/+$', '') = '' THEN '/' ELSE regexp_replace(p, '/+$', '') END AS key FROM y""",
    "contract_http": _SPANS
    + """, k AS (SELECT DISTINCT kind = 'CLIENT' AS is_client, service, string_split(key, ' ')[1] AS m, string_split(key, ' ')[-1] AS p FROM s
  WHERE kind_of = 'http' AND service <> '' AND key LIKE '% %' AND kind IN ('CLIENT', 'SERVER')),
x AS (SELECT service || CASE WHEN is_client THEN ':http_client:' ELSE ':http_handler:' END || m || ':' || p AS id, *, list_filter(string_split(p, '/'), lambda g: g <> '') AS g FROM k),
y AS (SELECT * FROM x WHERE len(g) = 0 OR len(list_filter(g, lambda z: z <> '*')) > 0),
h AS (SELECT c.id, d.id AS d_id, d.service AS ds, c.p, c.g, CASE WHEN c.p = d.p THEN 0
    WHEN len(c.g) = len(d.g) AND len(list_filter(c.g, lambda z: z <> '*')) > 0 AND len(list_filter(list_zip(c.g, d.g), lambda z: z[1] = z[2] OR z[1] = '*' OR z[2] = '*')) = len(c.g)
      AND (NOT list_contains(c.g, '*') OR len(list_filter(list_zip(c.g, d.g), lambda z: z[1] = z[2] AND z[1] <> '*' AND z[1] NOT IN ('api', 'apis', 'rest', 'public', 'internal') AND NOT regexp_full_match(z[1], 'v[0-9]+'))) > 0) THEN 2 END AS t
  FROM y c JOIN y d ON c.is_client AND NOT d.is_client AND c.m = d.m),
bt AS (SELECT id, min(t) AS t FROM h GROUP BY id), w AS (SELECT h.* FROM h JOIN bt ON bt.id = h.id AND bt.t = h.t), f AS (SELECT id, count(DISTINCT ds) AS k FROM w GROUP BY id)
SELECT 'link:' || w.id || '->' || w.d_id AS id, CASE WHEN f.k > 1 THEN 'partial' WHEN t = 0 THEN 'static' ELSE 'inferred' END AS confidence, CASE WHEN t = 0 THEN 'exact' ELSE 'wildcard_anchored' END AS tier FROM w JOIN f ON f.id = w.id
WHERE NOT (f.k > 1 AND contains(w.p, '*') AND len(list_filter(w.g, lambda z: NOT contains(z, '*') AND z[-1] <> ':')) = 1)""",
    "session_coverage": W.rstrip()
    + ", "
    + _SPANS.replace("WITH ", "", 1)
    + """, f AS (SELECT DISTINCT CASE WHEN kind_of = 'http' THEN 'http_call' WHEN kind_of = 'sse' THEN 'sse_endpoint' WHEN kind_of = 'kafka' THEN 'kafka_publish' WHEN kind_of = 'nats' THEN 'nats_publish' WHEN kind_of = 'job' THEN 'job_enqueue' ELSE 'publishes' END AS type, key AS label FROM fl)
SELECT e.type, count(*) AS n_edges, count(f.type) AS n_seen FROM e LEFT JOIN f ON f.type = e.type AND f.label = e.label
WHERE e.type IN ('http_call', 'sse_endpoint', 'publishes', 'kafka_publish', 'nats_publish', 'job_enqueue') GROUP BY e.type""",
    "doc_chunks": """WITH s AS (SELECT doc_id, CASE WHEN len(parts) = 0 THEN [] ELSE parts END AS parts FROM (
  SELECT doc_id, list_filter(string_split(regexp_replace(coalesce(text, ''), '(^|\\n)(#{1,6} )', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda p: trim(p) <> '') AS parts FROM documents)),
p AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS k FROM s)
SELECT doc_id, count(DISTINCT k) AS n_sections, CAST(sum(greatest(ceil(length(part) / 800), 1)) AS BIGINT) AS n_pieces, CAST(sum(length(part)) AS BIGINT) AS n_chars FROM p GROUP BY doc_id""",
}
