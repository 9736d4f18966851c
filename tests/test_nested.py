import json

from flowskein.operators import nested

SCHEMA = "export_id bigint, received_at timestamp, body string, dewey string"


def spans(spark, bodies):
    rows = [(i, None, b, "clash") for i, b in bodies]
    return {tuple(r) for r in nested.export_spans(spark.createDataFrame(rows, SCHEMA)).collect()}


def export(spans, service="svc"):
    attributes = [{"key": "service.name", "value": {"stringValue": service}}] if service is not None else []
    return {"resourceSpans": [{"resource": {"attributes": attributes}, "scopeSpans": [{"spans": spans}]}]}


def test_only_complete_objects_count(spark):
    good = json.dumps(export([{"spanId": "a"}]))
    bad = [good + " x", good + "}", good + "]", good + good, good[:-1], "[" + good + "]", "", None, "null", '{"a":1}],[{"b":2}', good + "]]]]", good.replace('"a"', "NaN")]
    assert spans(spark, [(1, good), *((i + 2, b) for i, b in enumerate(bad))]) == {(1, 0, 0, 0, "a", "", "svc")}
    assert spans(spark, [(1, f" \n{good}\t ")]) == {(1, 0, 0, 0, "a", "", "svc")}
    nested_lists = json.dumps(export([{"spanId": "a", "x": [[[[1]]]]}]))
    assert spans(spark, [(1, nested_lists)]) == {(1, 0, 0, 0, "a", "", "svc")}


def test_parents_services_and_places(spark):
    body = export([{"spanId": None}, {"parentSpanId": "0000"}, {"spanId": "c", "parentSpanId": " "}, None, 7, {"spanId": "d", "parentSpanId": "c"}], None)
    body["resourceSpans"].append({"resource": {"attributes": [{"key": "service.name", "value": {"intValue": 3}}]}, "scopeSpans": None})
    body["resourceSpans"].append({"resource": None, "scopeSpans": [{}, {"spans": []}, {"spans": [{"spanId": "e"}]}]})
    got = spans(spark, [(5, json.dumps(body))])
    assert got == {(5, 0, 0, 0, "", "", ""), (5, 0, 0, 1, "", "", ""), (5, 0, 0, 2, "c", "", ""), (5, 0, 0, 5, "d", "c", ""), (5, 2, 2, 0, "e", "", "")}


def test_redelivery_counts_once_and_null_ids_by_body(spark):
    a, b = json.dumps(export([{"spanId": "a"}])), json.dumps(export([{"spanId": "b"}]))
    assert len(spans(spark, [(1, a), (1, a), (None, a), (None, a), (None, b)])) == 3
    assert spans(spark, []) == set()


def test_dewey_labels_of_any_depth(spark):
    record = {"a": [{"b": [1, {"c": "x"}]}], "d": None, "e": ""}
    rows = nested.dewey_nodes(spark.createDataFrame([("k", json.dumps(record)), ("bad", "{"), ("none", None)], "id string, body string"), "id", "body").collect()
    assert [(r["record_key"], r["value"]) for r in rows if r["kind"] == "invalid"] == [("bad", "{")]  # seen, not dropped
    by = {tuple(r["dewey"]): r for r in rows if r["record_key"] == "k"}
    assert {r["record_key"] for r in rows} == {"k", "bad"}
    assert by[(0, 0, 0, 1, 0)]["schema_path"] == "$.a[].b[].c" and by[(0, 0, 0, 1, 0)]["value"] == "x"
    assert all(r["parent_dewey"] is None if not r["dewey"] else tuple(r["parent_dewey"]) in by for r in rows)


def test_tables_link_by_truncation(spark):
    attributes = [{"key": "k", "value": {"kvlistValue": {"values": []}}}, {"key": "n", "value": {"intValue": "7"}}, None, {}]
    one = {"spanId": "a", "attributes": attributes, "events": [{"name": "e", "attributes": [{"key": "x"}]}], "links": [{"spanId": "z"}, None]}
    rows = [(1, None, json.dumps(export([one])), "clash"), (2, None, None, ""), (3, None, "{", "")]
    trees = nested.export_trees(spark.createDataFrame(rows, SCHEMA))
    tables = {name: trees.table(name).collect() for name in trees.levels}
    assert list(tables["span"][0]["dewey"]) == [0, 0, 0] and list(tables["span"][0]["parent_dewey"]) == list(tables["scope"][0]["dewey"])
    found = {r["key"]: (list(r["parent_dewey"]), r["value_type"], r["value"]) for r in tables["span_attribute"]}
    assert found["n"] == ([0, 0, 0], "intValue", "7") and found["k"][1] == "kvlistValue" and len(tables["span_attribute"]) == 4
    assert [list(r["dewey"]) for r in tables["event_attribute"]] == [[0, 0, 0, 0, 0]] and len(tables["link"]) == 2
    lost = {r["table"]: (r["n_rows"], r["n_parents"], r["n_lost"]) for r in nested.lost_links(trees).collect()}
    assert lost["span_attribute"] == (4, 1, 0) and lost["link_attribute"] == (0, 0, 0) and lost["resource"] == (1, 1, 0)
    inherited = trees.table("event", {"scope": ("scope", "scope_name"), "service": ("resource", "service")}).first()
    assert (inherited["scope"], inherited["service"]) == ("", "svc")


def test_rows_without_parent_are_counted(spark):
    trees = nested.export_trees(spark.createDataFrame([(1, None, json.dumps(export([{"spanId": "a"}])), "")], SCHEMA))
    broken = nested.Trees(trees.packed.withColumn("scope", trees.packed["scope"].cast(trees.packed.schema["scope"].dataType)).selectExpr("record_key", *(f"{'slice(scope, 1, 0) AS scope' if t == 'scope' else t}" for t in trees.levels)), trees.levels)
    assert {r["table"]: r["n_lost"] for r in nested.lost_links(broken).collect()}["span"] == 1
    nodes = nested.dewey_nodes(spark.createDataFrame([("k", '{"a": [1, 2]}')], "id string, body string"), "id", "body")
    assert sum(r["n_lost"] for r in nested.node_summary(nodes).collect()) == 0
    assert {r["schema_path"]: r["n_lost"] for r in nested.node_summary(nodes.filter("kind <> 'array'")).collect()}["$.a"] == 2


def test_depth_without_limit(spark):
    """60,000 brackets are walked like any others, and what is cut among them is reported."""
    deep = "[" * 60_000 + "]" * 60_000
    assert nested.parse_json('{"a": 1, "a": [2, {"b": null}]}') == [("a", 1), ("a", [2, [("b", None)]])]
    wrapped = '{"x": ' * 50_000 + '[1.5e3, "q\\u0041\\"", true, false, null, -0, {}, []]' + "}" * 50_000
    value = nested.parse_json(wrapped)
    for _ in range(50_000):
        (name, value), *rest = value
        assert name == "x" and not rest
    assert value == [1500.0, 'qA"', True, False, None, 0, [], []]
    for bad in (deep[:-1], deep + "]", deep + " 1", "[" * 60_000, deep.replace("[]", "[1,]"), deep.replace("[]", "[,1]"), deep.replace("[]", '{"a" 1}'), deep.replace("[]", "{1:2}"), deep.replace("[]", '{"a":1,}')):
        try:
            nested.parse_json(bad)
        except ValueError:
            continue
        raise AssertionError(bad[59_990:60_010])
    rows = spark.createDataFrame([("deep", "[" * 3_000 + "7" + "]" * 3_000), ("cut", deep[:-1])], "id string, body string")
    kinds = nested.dewey_nodes(rows, "id", "body").groupBy("record_key", "kind").count().collect()
    assert {(r["record_key"], r["kind"]): r["count"] for r in kinds} == {("deep", "array"): 3_000, ("deep", "int"): 1, ("cut", "invalid"): 1}
