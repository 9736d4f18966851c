import json

import pytest
from pyspark.sql import functions as F

from flowskein.operators import answers, contracts
from flowskein.operators import traversal as T
from flowskein.sources import patterns

NODE = "id string, type string, label string, service string, file string, line int, lang string, meta map<string,string>"


@pytest.fixture(scope="module")
def graph(spark):
    nodes = spark.createDataFrame([(i, t, i.upper(), s, f"{s}/{i}.go", 1, "go", {}) for i, t, s in (("a", "http_handler", "x"), ("b", "function", "x"), ("c", "function", "y"), ("w", "worker", "y"))], NODE)
    rows = [("1", "a", "b", "calls", "static", "verified"), ("2", "b", "c", "calls", "partial", "candidate"), ("3", "c", "w", "spawns", "static", "verified"), ("4", "a", "c", "contains", "static", "")]
    return nodes, spark.createDataFrame([(*r, "", []) for r in rows], "id string, src string, dst string, type string, confidence string, verification_state string, label string, sources array<string>")


def test_investigation(graph):
    found = answers.investigate(*graph, "A")
    assert found["target"] == "a" and found["flows"] == [(["a", "b", "c", "w"], "candidate")] and dict(found["context"]) == {"b": 1, "c": 1, "w": 2}
    assert answers.investigate(*graph, "zzz")["target"] is None
    assert {r["node_id"] for r in answers.context(*graph, "c", "impact").collect()} == {"a", "b"}
    assert {(r["other"], r["role"]) for r in answers.symbol_context(*graph, "b").collect()} == {("a", "caller"), ("c", "callee")}


def test_chains(graph, spark):
    nodes, edges = graph
    seeds = spark.createDataFrame([("a",)], "node_id string")
    calls = edges.filter("type <> 'contains'")
    paths = T.simple_paths(calls, seeds, T.PathRule(5)).filter("is_leaf")
    assert answers.verified_chains(paths, edges, "verified").count() == 0 and answers.verified_chains(paths, edges, "any").count() == 1
    assert answers.rendered(paths, nodes, edges).first()["line"].startswith("(x) x/a.go:1 A -[calls]-> (x) x/b.go:1 B -[calls?]-> (y) y/c.go:1 C")
    entity = answers.chain_entities(nodes, calls, seeds).first()
    assert entity["text"] == "A B C W" and entity["entity_id"].startswith("chain:a:")
    assert answers.launch_prefix(edges, "w") == ["a", "b", "c", "w"]
    assert answers.node_cards(nodes).filter("content_hash IS NULL").count() == 0
    checks = {r["check"]: r["is_problem"] for r in answers.doctor(nodes, edges, edges.limit(0)).collect()}
    assert not any(checks.values())


def test_inheritance_and_configuration(spark):
    calls = spark.createDataFrame([("1", "C", "m"), ("2", "C", "n"), ("3", "C", "none")], "id string, class string, name string")
    parents = spark.createDataFrame([("C", "B"), ("B", "A"), ("C", "M"), ("A", "C")], "class string, parent string")
    methods = spark.createDataFrame([("A", "m", "A#m"), ("B", "m", "B#m"), ("M", "m", "M#m"), ("A", "n", "A#n")], "class string, name string, method_id string")
    assert {(r["id"], r["method_id"], r["depth"]) for r in answers.inherited(calls, parents, methods).collect()} == {("1", "B#m", 1), ("1", "M#m", 1), ("2", "A#n", 2)}
    values = spark.createDataFrame([("s", "U", "http://h/api/"), ("s", "V", "http://h/a"), ("s", "V", "http://h/b")], "service string, var string, value string")
    refs = spark.createDataFrame([("1", "s", "U"), ("2", "s", "X")], "id string, service string, var string")
    assert {(r["id"], r["problem"]) for r in answers.configured(refs, values).collect()} == {("1", ""), ("2", "config_not_found")}
    clients = spark.createDataFrame([("1", "s", "U", "/x"), ("2", "s", "U", "/api/x"), ("3", "s", "V", "/x"), ("4", "s", "U", "/apix")], "id string, service string, var string, path string")
    assert {r["id"]: r["path"] for r in answers.base_paths(clients, values).collect()} == {"1": "/api/x", "2": "/api/x", "3": "/x", "4": "/api/apix"}


def test_rules_and_bundles(spark):
    raw = [{"kind": "mq", "producer": {"node_type": "publisher", "key": ["q"]}, "consumer": {"node_type": "subscriber", "key": ["q"]}, "normalizers": {"q": ["case_fold"]}, "tiers": ["exact", "normalized"], "edge_type": "publishes", "id_prefix": "mq"}]
    assert answers.rules_from_json(json.dumps(raw))[-1].kind == "mq" and len(answers.rules_from_json("[]")) == len(contracts.RULES)
    with pytest.raises(ValueError, match="unknown rule field"):
        answers.rules_from_json(json.dumps([raw[0] | {"typo": 1}]))
    text, dropped = answers.bundle([("a", "x" * 400), ("b", "y" * 400), ("c", "z")], 204)
    assert dropped == 1 and "## b" in text and "## c" not in text
    df = spark.createDataFrame([("Unfair, Unxyz",)], "t string")
    assert df.select(answers.word_pieces(F.col("t"), ["un", "##fair", ",", "##f"]).alias("p")).first()["p"] == ["un", "##fair", ",", "[UNK]"]


def test_pattern_packs(spark):
    texts = [
        ("a.go", 'package a\nfunc Run(x int) {\n\tr.GET("/u/:id", h)\n\thttp.Get("http://b/x")\n}\nfunc (s *Srv) Do() {}\ntype Srv struct {\n'), ("t/x.spec.ts", 'export const go = async (a) => {\n  fetch(`/api/y`)\n'),
        ("p.py", '@app.get("/z")\nasync def z():\n    requests.post("http://c/k")\n'), ("n.txt", "func No()"), ("null.go", None),
    ]
    rows = patterns.extract(spark.createDataFrame(texts, "path string, text string"), "svc").collect()
    got = {(r["file"], r["type"], r["label"], r["line"]) for r in rows}
    assert got == {
        ("a.go", "function", "Run", 2), ("a.go", "http_handler", "GET /u/:id", 3), ("a.go", "http_client", "Get http://b/x", 4), ("a.go", "method", "Do", 6), ("a.go", "struct", "Srv", 7),
        ("t/x.spec.ts", "function", "go", 1), ("t/x.spec.ts", "http_client", "/api/y", 2), ("p.py", "http_handler", "get /z", 1), ("p.py", "function", "z", 2), ("p.py", "http_client", "post http://c/k", 3),
    }
    assert {r["meta"].get("is_test") for r in rows if r["file"].startswith("t/")} == {"true"} and next(r for r in rows if r["type"] == "method")["meta"]["class"] == "*Srv"
    with pytest.raises(ValueError):
        patterns.Pattern("bad", "go", ("go",), "x", "(a)(b)", ("one",))


def test_own_packs_and_several_matches_a_line(spark):
    own = '[{"name": "todo", "lang": "any", "exts": ["go", "txt"], "node_type": "note", "regex": "TODO\\\\((\\\\w+)\\\\): (\\\\w+)", "fields": ["who", "label"]}]'
    packs = patterns.load_packs(own)
    text = "x TODO(ann): fix TODO(bob): test\n\tgo run() ; go stop()\nclose(os.Getenv(\"A\"), os.Getenv(\"B\"))"
    rows = patterns.extract(spark.createDataFrame([("a.go", text), ("b.txt", text), ("c.py", text), ("d", text), ("e.go", "")], "path string, text string"), "s", packs).collect()
    got = {(r["file"], r["type"], r["label"], r["line"]) for r in rows}
    notes = {(f, "note", label, 1) for f in ("a.go", "b.txt") for label in ("fix", "test")}
    assert got == notes | {("a.go", "function", "run", 2), ("a.go", "variable", "A", 3), ("a.go", "variable", "B", 3)}
    assert {r["meta"]["who"] for r in rows if r["type"] == "note"} == {"ann", "bob"}
    for bad in ('[{"name": "x", "typo": 1}]', '[{"name": "go_func", "lang": "go", "exts": ["go"], "node_type": "f", "regex": "(a)", "fields": ["label"]}]', '[{"name": "x", "lang": "go", "exts": [], "node_type": "f", "regex": "(a)", "fields": ["label"]}]'):
        with pytest.raises(ValueError):
            patterns.load_packs(bad)
    assert len({p.name for p in patterns.PACKS}) == len(patterns.PACKS)


def test_word_pieces_equal_a_public_tokenizer(spark):
    tokenizers = pytest.importorskip("tokenizers")
    vocabulary = ["[UNK]", *"abcdefgh", *(f"##{c}" for c in "abcdefg"), "ab", "abc", "##cd", "##de", "cab", "bad", ",", "!"]
    model = tokenizers.Tokenizer(tokenizers.models.WordPiece({w: i for i, w in enumerate(vocabulary)}, unk_token="[UNK]", max_input_chars_per_word=12))
    model.pre_tokenizer = tokenizers.pre_tokenizers.BertPreTokenizer()
    texts = ["Abcde cab, bad!", "abcdh h", "x", "", "  ", "aaaaaaaaaaaaa aaaaaaaaaaaa", "fade-cab", "cabbage", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = {r["i"]: r["p"] for r in df.select("i", answers.word_pieces(F.col("t"), vocabulary, 12).alias("p")).collect()}
    for i, text in enumerate(texts):
        assert rows[i] == (None if text is None else model.encode(text.lower()).tokens)


def test_sources_of_symbols(spark):
    files = spark.createDataFrame([("s", "f", "a\nb\nc")], "service string, file string, text string")
    nodes = spark.createDataFrame([("1", "s", "f", 2, 3), ("2", "s", "f", 3, 0), ("3", "s", "g", 1, 2), ("4", "s", "f", 0, 1)], "id string, service string, file string, line int, end_line int")
    assert {r["id"]: r["source"] for r in answers.symbol_text(nodes, files).collect()} == {"1": "b\nc", "2": "c", "3": None, "4": "a\nb"}


def test_rules_and_manifests_in_yaml(spark):
    pytest.importorskip("yaml")
    rule = """
contracts:
  - kind: mq
    producer: {node: publisher, where: {pattern: mq_send}, key: [q], key_fallbacks: {q: [queue]}, target_service_meta: to}
    consumer: {node: subscriber, key: [q]}
    normalizers: [case_fold, quote_strip]
    match: [exact, normalized]
    edge: {type: publishes, id_prefix: mq, same_service: skip}
    unmatched: ledger
"""
    made = answers.rules_from_yaml(rule)[-1]
    assert (made.kind, made.producer.fallbacks, made.producer.target, made.normalizers["q"], made.same_service, made.unmatched) == ("mq", {"q": ("queue",)}, "to", ("case_fold", "quote_strip"), "skip", "ledger")
    assert answers.rules_from_yaml("") == contracts.RULES
    for bad in (rule.replace("match:", "typo: 1\n    match:"), rule.replace("case_fold", "fold"), rule.replace("same_service: skip", "same_service: maybe")):
        with pytest.raises(ValueError):
            answers.rules_from_yaml(bad)
    nodes = spark.createDataFrame([("p", "publisher", "a", "f", 1, {"pattern": "mq_send", "queue": "Q", "to": "b"}), ("c1", "subscriber", "b", "f", 1, {"q": "'q'"}), ("c2", "subscriber", "c", "f", 1, {"q": "q"})], "id string, type string, service string, file string, line int, meta map<string,string>")
    assert [(r["src"], r["dst"]) for r in contracts.link(nodes, made).edges.collect()] == [("p", "c1")]
    from flowskein.operators import evaluation

    text = "cases:\n  - {id: a, kind: node, target: t, exhaustive: true, expected_impacted: [x, y], must_not_miss: [x], must_not_include: [z]}\n  - {kind: semantic, query: q, expect_any_of: [m]}\n"
    cases = evaluation.manifest_cases(spark.createDataFrame([("r", text), ("bad", "cases: [1]"), ("odd", "{"), ("none", None)], "repo string, text string"))
    got = {(r["repo"], r["case_id"], r["kind"], r["exhaustive"], tuple(r["expected"]), tuple(r["must"]), tuple(r["forbidden"])) for r in cases.collect() if r["kind"] != "invalid"}
    assert got == {("r", "a", "node", True, ("x", "y"), ("x",), ("z",)), ("r", "semantic-q", "semantic", False, ("m",), (), ())}
    assert {r["repo"] for r in cases.filter("kind = 'invalid'").collect()} == {"bad", "odd"}
    scores = evaluation.case_scores(evaluation.case_items(cases, "expected"), spark.createDataFrame([("a", "x"), ("a", "z")], "case_id string, item string"), cases.select("case_id", F.lit("").alias("item")).limit(0), evaluation.case_items(cases, "must"), evaluation.case_items(cases, "forbidden"))
    row = scores.filter("case_id = 'a'").first()
    assert row["recall"] == 0.5 and row["hard_fail"] and row["forbidden_hits"] == 1
