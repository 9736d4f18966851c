import json
import math
import random

import pytest
from pyspark.sql import functions as F

from flowskein.operators import contracts, evaluation, history, search
from flowskein.operators import spans as SP
from flowskein.sources import files
from flowskein.streaming import spans as streaming

NODE = "id string, type string, label string, service string, file string, line int, meta map<string,string>"


def nodes(spark, rows):
    return spark.createDataFrame([(i, t, "", s, f"{s}/{i}.go", 1, m) for i, t, s, m in rows], NODE)


def test_http_tiers_and_fan_out(spark):
    http = contracts.RULES[0]
    rows = [
        ("c1", "http_client", "web", {"method": "GET", "url": "/users/:id"}), ("h1", "http_handler", "api", {"method": "GET", "path": "/users/{id}"}),
        ("c2", "http_client", "web", {"method": "GET", "path": "http://h/users/9?x=1"}), ("c3", "http_client", "web", {"path": "/items/all"}),
        ("h2", "http_handler", "api", {"method": "POST", "path": "/items/all"}), ("h3", "http_handler", "other", {"method": "POST", "path": "/items/all"}),
        ("c4", "http_client", "web", {"method": "GET", "path": "/nothing/here"}), ("c5", "http_client", "web", {"method": "GET", "path": "/users/:id", "nav_link": "true"}),
        ("c6_test", "http_client", "web", {}),
    ]
    linked = contracts.link(nodes(spark, rows), http)
    got = {(r["src"], r["dst"]): (r["tier"], r["confidence"]) for r in linked.edges.collect()}
    assert got == {("c1", "h1"): ("normalized", "inferred"), ("c2", "h1"): ("wildcard_anchored", "inferred"), ("c3", "h2"): ("normalized", "partial"), ("c3", "h3"): ("normalized", "partial")}
    assert [r["id"] for r in linked.unmatched.collect()] == ["c4"]
    assert contracts.unknown_edges(linked.unmatched, http).first()["confidence"] == "unknown"
    assert contracts.link(nodes(spark, rows).limit(0), http).edges.count() == 0


def test_candidate_keys_and_own_origin(spark):
    http = contracts.RULES[0]
    rows = [
        ("c", "http_client", "web", {"method": "GET", "key_candidates": '["/a/one", "/b/two", "/none/x"]'}), ("h1", "http_handler", "api", {"method": "GET", "path": "/a/one"}), ("h2", "http_handler", "api", {"method": "GET", "path": "/b/:id"}),
        ("b", "http_client", "shop", {"method": "GET", "path": "/cart/items"}), ("o", "http_handler", "shop", {"method": "GET", "path": "/cart/items"}), ("x", "http_handler", "other", {"method": "GET", "path": "/cart/items"}),
    ]
    linked = contracts.link(nodes(spark, rows).withColumn("lang", F.lit("typescript")), http)
    got = {(r["src"], r["dst"], r["confidence"]) for r in linked.edges.collect()}
    assert got == {("c", "h1", "inferred"), ("c", "h2", "inferred"), ("b", "o", "static")}
    assert [r["name"] for r in linked.unmatched.collect()] == ["GET /none/x"]


def test_messaging_rules(spark):
    rule = {r.kind: r for r in contracts.RULES}
    kafka = [
        ("p", "publisher", "a", {"pattern": "kafka_publish", "topic": '"orders"'}), ("s", "subscriber", "b", {"pattern": "kafka_subscribe", "topic": "orders"}),
        ("own", "subscriber", "a", {"pattern": "kafka_subscribe", "topic": "orders"}), ("lost", "publisher", "a", {"pattern": "kafka_publish", "topic": "none"}),
    ]
    linked = contracts.link(nodes(spark, kafka), rule["kafka"])
    assert [(r["src"], r["dst"], r["type"]) for r in linked.edges.collect()] == [("p", "s", "kafka_publish")] and [r["id"] for r in linked.unmatched.collect()] == ["lost"]
    amqp = [("p", "channel", "a", {"exchange": "ex", "routing_key": "k.one"}), ("q", "channel", "b", {"exchange": "ex", "routing_key": "#", "role": "consumer"}), ("r", "channel", "b", {"exchange": "ex", "routing_key": "k.two", "role": "consumer"})]
    assert [(r["dst"], r["tier"], r["confidence"]) for r in contracts.link(nodes(spark, amqp), rule["amqp"]).edges.collect()] == [("q", "exchange_only", "partial")]


def test_rules_are_checked():
    with pytest.raises(ValueError, match="unknown tier"):
        contracts.Rule("x", contracts.Endpoint("a", ("k",)), contracts.Endpoint("b", ("k",)), {}, ("fuzzy",), "calls", "x")


def span(trace, ident, parent="", kind=3, **attrs):
    return {"traceId": trace, "spanId": ident, "parentSpanId": parent, "kind": kind, "attributes": [{"key": k.replace("__", "."), "value": {"stringValue": v}} for k, v in attrs.items()]}


EXPORTS = "export_id bigint, received_at timestamp, session string, body string"


def resources(*parts):
    """An export of (service, span, span, ...)."""
    own = lambda service: {"attributes": [{"key": "service.name", "value": {"stringValue": service}}]}
    return json.dumps({"resourceSpans": [{"resource": own(service), "scopeSpans": [{"spans": list(spans)}]} for service, *spans in parts]})


def flows_of(spans):
    return {(r["kind_of"], r["key"], r["src_service"], r["dst_service"], r["causality"], r["n_refs"]) for r in SP.flow_records(spans).collect()}


def outcomes_of(spans):
    return {(r["outcome"], r["kind"]): r["n_spans"] for r in SP.span_ledger(spans).collect()}


def message(trace, ident, kind, to="orders", system="Kafka", operation=None, **more):
    told = {"messaging__operation__type": operation or ("publish" if kind == 4 else "process")} if operation != "" else {}
    return span(trace, ident, kind=kind, messaging__system=system, messaging__destination__name=to, **told, **more)


def test_spans_become_flows_or_ledger_rows(spark):
    link = message("t2", "c", "SPAN_KIND_CONSUMER") | {"links": [{"traceId": "t1", "spanId": "p"}]}
    body = resources(
        ("web", span("t1", "a", http__request__method="GET", url__full="http://h/x/1"), span("t1", "i", kind=1), message("t1", "p", 4), span("t1", "w", http__request__method="GET", url__full="http://h/o")),
        ("api", span("t1", "b", "a", 2, http__method="GET", http__route="/x/:id"), span("t1", "z", "gone", 2, http__method="PUT", url__path="/y/"), span("t1", "q", "", 2, http__route="/no-method"), span("t1", "r", "", 2, http__method="GET"), link),
        ("", span("t9", "n", kind=2, http__method="GET", http__route="/n")),
    )
    rows = SP.span_rows(spark.createDataFrame([(1, None, "s", body), (1, None, "s", body), (2, None, "s", body), (3, None, "s", "{")], EXPORTS))
    assert flows_of(rows) == {("http", "get /x/*", "web", "api", "parent_child", 1), ("http", "put /y", "", "api", "server_only", 1), ("kafka", "orders", "web", "api", "link", 1)}
    ledger = outcomes_of(rows)
    assert ledger == {
        ("flow", "SERVER"): 2, ("flow", "CONSUMER"): 1, ("flow", "PRODUCER"): 1, ("matched_client", "CLIENT"): 1, ("no_causality", "CLIENT"): 1, ("unsupported_span_kind", "INTERNAL"): 1,
        ("unsupported_span_kind", "SERVER"): 1, ("no_route_or_path", "SERVER"): 1, ("unknown_service", "SERVER"): 1,
    }
    assert sum(ledger.values()) == rows.count()


def test_channels_match_where_no_link_does(spark):
    """Consumers without link meet all services that publish to their kind and key, in their session only; producers alone are flows to nobody."""
    unknown = message("t3", "u", 5) | {"links": [{"traceId": "t1", "spanId": "gone"}]}
    one = resources(
        ("shop", message("t1", "p", 4), message("t1", "x", 4, "lonely"), message("t1", "m", 4, "mail", "RabbitMQ", messaging__rabbitmq__destination__routing_key="new.*")),
        ("cart", message("t1", "p2", 4)),
        ("bill", unknown, message("t4", "v", 5, "nobody"), message("t4", "k", 5, "mail", "rabbitmq", "receive", messaging__rabbitmq__destination__routing_key="new.*"), message("t4", "o", 5, operation=""), message("t4", "e", 5, "")),
    )
    rows = SP.span_rows(spark.createDataFrame([(1, None, "s", one), (2, None, "other", resources(("bill", message("t5", "w", 5))))], EXPORTS))
    assert flows_of(rows) == {
        ("kafka", "orders", "shop", "bill", "key_match", 1), ("kafka", "orders", "cart", "bill", "key_match", 1), ("kafka", "lonely", "shop", "", "key_match", 1), ("amqp", "mail new.*", "shop", "bill", "key_match", 1),
    }
    assert outcomes_of(rows) == {("flow", "PRODUCER"): 4, ("flow", "CONSUMER"): 2, ("no_causality", "CONSUMER"): 2, ("unsupported_span_kind", "CONSUMER"): 1, ("no_route_or_path", "CONSUMER"): 1}
    by_kind = SP.span_rows(spark.createDataFrame([(1, None, "s", one)], EXPORTS), told_by_kind=True)
    assert outcomes_of(by_kind)["flow", "CONSUMER"] == 3


def test_event_streams_names_and_unknown_callers(spark):
    body = resources(
        ("front-1", span("t", "a", http__request__method="GET", url__full="http://h/e")),
        ("api", span("t", "b", "a", 2, http__method="GET", http__route="/e/:id", **{"http__response__header__content-type": "Text/Event-Stream; x"}), span("t", "c", "", 2, http__method="GET", http__route="/live")),
    )
    exports = spark.createDataFrame([(1, None, "s", body)], EXPORTS)
    assert flows_of(SP.span_rows(exports, {"front-1": "front"}, ("front", "api"), ("/live",))) == {("sse", "/e/*", "front", "api", "parent_child", 1), ("sse", "/live", "", "api", "server_only", 1)}
    stranger = SP.span_rows(exports, known=("api",))
    assert flows_of(stranger) == {("sse", "/e/*", "", "api", "server_only", 1), ("http", "get /live", "", "api", "server_only", 1)} and outcomes_of(stranger)["unknown_service", "CLIENT"] == 1
    kept = SP.span_rows(spark.createDataFrame([(1, None, "s", resources(("a", span("t", "x", secret__key="s", code__filepath="f.go"))))], EXPORTS)).first()
    assert kept["code_file"] == "f.go" and "s" not in [v for k, v in kept.asDict().items() if k != "session"]


def test_search(spark):
    docs = spark.createDataFrame([(1, "session ledger"), (2, "session session sessions"), (3, "other"), (4, None)], "doc_id bigint, text string")
    scores = {r["doc_id"]: r["score"] for r in search.bm25(docs, ["session", "ledger"]).collect()}
    assert set(scores) == {1, 2} and scores[1] > scores[2]
    assert search.bm25(docs.limit(0), ["x"]).count() == 0
    types = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "doc_id bigint, type string")
    lexical = spark.createDataFrame([(1, 1), (2, 2)], "doc_id bigint, rank int")
    semantic = spark.createDataFrame([(2, 1), (3, 2)], "doc_id bigint, rank int")
    fused = search.rrf(lexical, semantic, spark.createDataFrame([(3,)], "doc_id bigint"))
    assert {r["doc_id"]: r["match"] for r in fused.collect()} == {1: "lexical", 2: "fused", 3: "exact"}
    assert {r["doc_id"] for r in search.capped(fused, types, {"a": 1}, 5).collect()} == {2, 3}
    vectors = spark.createDataFrame([(1, [1.0, 0.0], "a"), (2, [0.0, 1.0], "a"), (3, [0.0, 0.0], "a")], "doc_id bigint, vector array<float>, type string")
    assert [r["doc_id"] for r in search.cosine_top(vectors, [1.0, 0.0], 2).orderBy("rank").collect()] == [1, 2]
    entities = docs.selectExpr("cast(doc_id as string) AS entity_id", "text")
    assert search.embedded(entities, lambda texts: [[float(len(t))] for t in texts]).count() == 4
    stored = search.stale_embeddings(entities, entities.select("entity_id", F.lit("").alias("content_hash"), F.lit("").alias("embedder")), "e")
    assert stored.count() == 4 and search.stale_embeddings(entities, stored, "e").filter("text IS NOT NULL").count() == 0 and search.stale_embeddings(entities, stored, "f").count() == 4
    assert search.expand_query("a b", {"b": ["c"]}) == "a b c"
    pieces = search.chunks(spark.createDataFrame([(1, "intro\n# One\n" + "x" * 1000 + "\n## Two\ny")], "doc_id bigint, text string")).orderBy("section_no", "piece_no").collect()
    assert [(r["heading"], r["piece_no"]) for r in pieces] == [("", 0), ("One", 0), ("One", 1), ("Two", 0)]


def test_evaluation(spark):
    items = lambda rows: spark.createDataFrame(rows, "case_id string, item string")
    scores = evaluation.case_scores(items([("a", "1"), ("a", "2"), ("a", "3"), ("b", "1")]), items([("a", "1"), ("b", "9")]), items([("a", "2")]), items([("a", "3")]), items([("b", "9")]), items([("a", "")]).select("case_id"))
    by = {r["case_id"]: r for r in scores.collect()}
    assert (by["a"]["n_hits"], by["a"]["honest_misses"], by["a"]["silent_misses"], by["a"]["hard_fail"], by["a"]["precision"]) == (1, 1, 1, True, 1.0)
    assert by["b"]["forbidden_hits"] == 1 and by["b"]["hard_fail"] and by["b"]["precision"] is None
    schema = "repo string, case_id string, recall double, precision_score double, silent_misses int, hard_fail boolean"
    base = spark.createDataFrame([("r", "1", 1.0, math.nan, 0, False), ("r", "2", 1.0, 1.0, 0, False), ("r", "3", 1.0, 1.0, 0, False), ("r", "4", 0.5, 1.0, 0, False)], schema)
    now = spark.createDataFrame([("r", "1", 0.5, 1.0, 0, False), ("r", "2", 1.0, 1.0, 2, False), ("r", "4", 0.5, 1.0, 0, True), ("r", "5", 0.0, 0.0, 9, True)], schema)
    assert {r["case_id"]: r["reason"] for r in evaluation.regression_gate(now, base, ["repo", "case_id"]).collect()} == {"1": "recall_drop", "2": "silent_miss_rise", "3": "missing_case", "4": "new_hard_fail"}
    answers = spark.createDataFrame([("a", "The `Foo` calls Bar"), ("b", "nothing")], "case_id string, answer string")
    facts = spark.createDataFrame([("a", "foo calls", True), ("a", "baz", False), ("b", "x", True)], "case_id string, fact string, required boolean")
    assert {r["case_id"]: r["correct"] for r in evaluation.facts_matched(answers, facts).collect()} == {"a": True, "b": False}


def test_history(spark):
    runs = lambda rows: spark.createDataFrame(rows, "g string, run_at int, count bigint")
    got = history.trend(runs([("a", 1, 5), ("a", 2, 7), ("a", 2, 6), ("a", 3, 9), ("b", 9, 1)]), ["g"], 2).collect()
    assert {r["g"]: (r["latest"], r["baseline"], r["delta"], r["runs"]) for r in got} == {"a": (9, 7, 2, 3), "b": (1, 1, 0, 1)}
    up = runs([("a", 1, 1), ("a", 2, 2), ("a", 3, 3), ("b", 1, 1), ("b", 2, 2), ("b", 3, 2), ("c", 3, 1), ("c", 2, 0)])
    assert [r["g"] for r in history.growth(up, ["g"], 3).collect()] == ["a"]
    items = spark.createDataFrame([("x", 1, 60), ("x", 2, 50), ("x", 3, 30), ("x", 4, 20), ("y", 1, 900)], "g string, n int, cost bigint")
    assert sorted(r["n"] for r in history.backfill(items, "g", "n", "cost", 100).filter("g = 'x'").collect()) == [1, 3]
    assert {(r["g"], r["n"]) for r in history.budget_prefix(items, ["g"], ["n"], "cost", 110).collect()} == {("x", 1), ("x", 2), ("y", 1)}


def test_budget_counts_what_overshoots_in_a_salt(spark):
    r = random.Random(2)
    rows = [("x", 1, 10), ("x", 2, 60_000), ("x", 3, 10)] + [(f"g{g}", n, r.choice([1, 5, 20, 300, None])) for g in range(20) for n in range(60)]
    want = set()
    for g in {g for g, _, _ in rows}:
        used = None
        for k, (_, n, c) in enumerate(sorted(x for x in rows if x[0] == g)):
            used = used if c is None else (used or 0) + c
            want |= {(g, n, used)} if k == 0 or used is not None and used <= (50_000 if g == "x" else 200) else set()
    items = spark.createDataFrame(rows, "g string, n int, cost bigint")
    for salts in (1, 2, 3, 64):
        cut = lambda df, most: {(x["g"], x["n"], x["used"]) for x in history.budget_prefix(df, ["g"], ["n"], "cost", most, salts).collect()}  # noqa: E731,B023
        assert cut(items.filter("g = 'x'"), 50_000) | cut(items.filter("g <> 'x'"), 200) == want


def test_cosine_answers_every_query(spark):
    r = random.Random(4)
    rows = [(i, [r.uniform(-1, 1) for _ in range(8)] if i else [0.0] * 8, "ab"[i % 2]) for i in range(60)]
    v = spark.createDataFrame(rows, "doc_id int, vector array<float>, type string")
    q = v.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.col("vector").alias("query"))
    key = lambda x: (x["doc_id"], x["type"], x["rank"], x["score"])
    got = search.cosine_top_each(v, q, 3).collect()
    assert len(got) == 3 * 2 * 3
    for one in q.collect():
        assert {key(x) for x in got if x["query_id"] == one["query_id"]} == {key(x) for x in search.cosine_top(v, one["query"], 3).collect()}


def test_sources(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / ".env").write_text("# c\nexport A='x y' # z\nB=1\nB=2 # note\n")
    (tmp_path / "a" / "k.yaml").write_text("env:\n  - name: DB_URL\n    value: \"http://db\"\n")
    (tmp_path / "a" / "v.tfvars").write_text('region = "eu"\n')
    texts = files.texts(spark, str(tmp_path)).unionByName(files.hidden_texts(spark, str(tmp_path)))
    values = {(r["var"], r["value"]) for r in files.config_values(texts).collect()}
    assert values == {("A", "x y"), ("B", "1"), ("B", "2"), ("DB_URL", "http://db"), ("region", "eu")}
    tree = files.tree(spark, str(tmp_path))
    assert tree.count() == 2 and files.fingerprint(tree).first() == files.fingerprint(tree.orderBy("path")).first()
    diff = "diff --git a/x.go b/x.go\n--- a/x.go\n+++ b/x.go\n@@ -1,2 +3,4 @@ f\n+a\n@@ -9 +12 @@\n@@ -20,2 +21,0 @@\ndiff --git a/y b/y\n--- a/y\n+++ /dev/null\n@@ -1,3 +0,0 @@\n"
    hunks = [(r["file"], r["start"], r["end"], r["deleted"]) for r in files.diff_hunks(spark.createDataFrame([(1, diff)], "diff_id int, text string")).collect()]
    assert hunks == [("x.go", 3, 6, False), ("x.go", 12, 12, False), ("x.go", 21, 20, False), ("y", 0, -1, True)]
    specs = [
        ("o.json", '{"openapi": "3", "paths": {"/a/{id}": {"get": {}, "parameters": []}}}'), ("s.yaml", "asyncapi: 2\nchannels:\n  orders: {}\n"),
        ("x.proto", "package p.v1;\nservice S {\n  rpc Get (A) returns (B);\n}\n"), ("q.graphql", "type Query {\n  user(id: ID): User\n}\n"), ("bad.json", "{"),
    ]
    found = files.spec_channels(spark.createDataFrame(specs, "path string, text string")).collect()
    assert {(r["kind"], r["key"]) for r in found if not r["problem"]} == {("http", "get /a/{id}"), ("async", "orders"), ("grpc", "p.v1.S/Get"), ("graphql", "user")}
    assert [r["path"] for r in found if r["problem"]] == ["bad.json"]
    (tmp_path / "cap" / "s1").mkdir(parents=True)
    (tmp_path / "cap" / "s1" / "spans.jsonl").write_text('{"resourceSpans": []}\n{"resourceSpans": []}\n')
    assert files.exports(spark, str(tmp_path / "cap")).count() == 2
    used = files.transcripts(spark.createDataFrame([("t", '{"result": "see src/a.go and src/a.go, x/b.rb", "usage": {"input_tokens": 3}}'), ("u", "?")], "task_id string, text string")).collect()
    assert used[0]["files"] == ["src/a.go", "x/b.rb"] and used[0]["input_tokens"] == 3 and used[1]["files"] == []
    pairs = spark.createDataFrame([("a", "b", "calls")], "src string, dst string, label string")
    assert files.mermaid(pairs).splitlines() == ["graph LR", '  n0["a"]', '  n1["b"]', "  n0 -->|calls| n1"]
    rows = spark.createDataFrame([("s", f"f{i}.go", 1, 1) for i in range(50)], "service string, file string, n_nodes int, min_depth int")
    assert len(files.review_comment(rows, 700).encode()) <= 700 and "more" in files.review_comment(rows, 700)


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i, f"2024-01-01 {i % 5:02d}:10:00", "a" if i % 2 else "b") for i in range(40)]
    batch = spark.createDataFrame(rows, "id int, t string, kind string").select("id", F.col("t").cast("timestamp").alias("ts"), "kind")
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = streaming.stream_table(spark, str(tmp_path / "in"), batch.schema)
    out = streaming.run_to_memory(streaming.windowed_counts(stream, "ts", ["kind"], "2 hours"), "w", "complete", str(tmp_path / "ck1"))
    want = streaming.windowed_counts(batch, "ts", ["kind"], "2 hours")
    assert sorted(map(str, out.collect())) == sorted(map(str, want.collect()))
    once = streaming.run_to_memory(streaming.deduped(stream, "ts", ["ts", "kind"]), "d", "append", str(tmp_path / "ck2"))
    assert once.count() == batch.select("ts", "kind").distinct().count()
    body = json.dumps({"resourceSpans": [{"scopeSpans": [{"spans": [{"spanId": "a"}]}]}]})
    spark.createDataFrame([(1, None, body)], "export_id bigint, received_at timestamp, body string").write.parquet(str(tmp_path / "caps"))
    caps = streaming.stream_table(spark, str(tmp_path / "caps"), spark.read.parquet(str(tmp_path / "caps")).schema)
    streaming.ingest_spans(caps, str(tmp_path / "spans"), str(tmp_path / "ck3")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "spans")).count() == 1
    again = [(1, None, body), (1, None, body), (2, None, body)]  # delivered again in a later batch
    spark.createDataFrame(again, "export_id bigint, received_at timestamp, body string").write.mode("append").parquet(str(tmp_path / "caps"))
    streaming.ingest_spans(caps, str(tmp_path / "spans"), str(tmp_path / "ck3")).awaitTermination()
    assert sorted(r["export_id"] for r in spark.read.parquet(str(tmp_path / "spans")).collect()) == [1, 2]


def test_stream_join_matches_spans(spark, tmp_path):
    schema = "trace_id string, span_id string, parent_span_id string, service string, started_at timestamp"
    at = "2024-01-01 00:00:00"
    for name, rows in (("c", [("t", "1", "", "web", at), ("t", "3", "", "web", at)]), ("s", [("t", "2", "1", "api", at)])):
        spark.createDataFrame(rows, schema.replace("timestamp", "string")).withColumn("started_at", F.col("started_at").cast("timestamp")).write.parquet(str(tmp_path / name))
    side = lambda n: streaming.stream_table(spark, str(tmp_path / n), spark.read.parquet(str(tmp_path / n)).schema)
    out = streaming.run_to_memory(streaming.matched_spans(side("c"), side("s")), "m", "append", str(tmp_path / "ck"))
    assert [tuple(r) for r in out.collect()] == [("t", "1", "2", "web", "api")]
