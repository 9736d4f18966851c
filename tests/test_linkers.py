from flowskein.operators import linkers as L

NODE = "id string, type string, label string, service string, file string, line int, lang string, meta map<string,string>"


def table(spark, *rows):
    return spark.createDataFrame([(i, t, label, s, f, n, lang, meta) for i, t, label, s, f, n, lang, meta in rows], NODE)


def ids(df, *columns):
    return {tuple(r[c] for c in columns) if len(columns) > 1 else r[columns[0]] for r in df.collect()}


def test_registrations_routes_twins(spark):
    n = table(
        spark,
        ("r1", "grpc_handler", "", "s", "f", 1, "go", {"pattern": "grpc_server_register", "impl": "&pb.Server{x}"}), ("r2", "grpc_handler", "", "s", "f", 2, "go", {"pattern": "grpc_server_register", "impl": "makeIt()"}),
        ("r3", "grpc_handler", "", "s", "f", 3, "go", {"pattern": "grpc_server_register", "impl": "new(Gone)"}), ("m1", "method", "A", "s", "g", 1, "go", {"receiver": "*server"}), ("m2", "method", "B", "s", "g", 2, "go", {"receiver": "Server"}),
        ("m3", "method", "B", "t", "g", 2, "go", {"receiver": "Server"}), ("m4", "method", "B", "s", "g", 2, "go", None),
        ("u", "route", "", "s", "f", 1, "ts", {"component": "Page"}), ("v", "route", "", "s", "f", 2, "ts", {"component": "None"}), ("c2", "component", "Page", "s", "z", 1, "ts", {}), ("c1", "function", "Page", "s", "y", 1, "ts", {}),
        ("t", "component", "Row", "s", "v/a.templ", 1, "templ", {}), ("g", "function", "Row", "s", "v/a_templ.go", 1, "go", {}), ("h", "function", "Row", "s", "v/atempl.go", 1, "go", {}),
    )
    links, lost = L.grpc_methods(n)
    assert ids(links, "src", "dst") == {("r1", "m1"), ("r1", "m2")} and ids(lost, "name") == {"makeIt()", "Gone"}
    links, lost = L.route_components(n)
    assert ids(links, "src", "dst") == {("u", "c1")} and ids(lost, "name", "kind") == {("None", "component_ref")}
    assert ids(L.template_twins(n), "src", "dst") == {("g", "t")}
    assert L.grpc_methods(n.limit(0))[0].count() == 0


def test_signals_and_streams(spark):
    n = table(
        spark,
        ("f", "function", "load", "s", "a.ts", 1, "ts", {}), ("c", "http_client", "", "s", "b.ts", 1, "ts", {"pattern": "eventsource_connect"}), ("r", "variable", "x", "s", "a.ts", 2, "ts", {"resource_fn": "load"}),
        ("q", "variable", "x", "s", "b.ts", 2, "ts", {"resource_fn": "load"}), ("h", "subscriber", "", "s", "b.ts", 9, "ts", {"pattern": "ws_on_message"}), ("k", "subscriber", "", "s", "b.ts", 9, "ts", {"pattern": "kafka"}),
    )
    e = spark.createDataFrame([("1", "f", "c", "calls"), ("2", "f", "r", "calls"), ("3", "c", "srv", "http_call"), ("3", "c", "srv", "http_call")], "id string, src string, dst string, type string")
    assert ids(L.resource_signals(n, e), "src", "dst") == {("c", "r")}
    assert ids(L.event_stream_handlers(n), "src", "dst") == {("c", "h")}
    assert [tuple(r) for r in L.event_stream_pushes(n, e).select("src", "dst", "type").collect()] == [("srv", "c", "sse_endpoint")]


def test_broker_hints_need_evidence_or_one_answer(spark):
    pub = lambda i, s, **m: (i, "publisher", i, s, "f", 1, "go", {"pattern": "amqp_publish"} | m)
    sub = lambda i, s, **m: (i, "subscriber", i, s, "f", 1, "go", {"pattern": "amqp_consume"} | m)
    n = table(
        spark, pub("own", "a", exchange="'x'"), pub("lone", "a"), sub("named", "b", exchange="x"), sub("by_queue", "b", queue="q"), sub("other", "b", exchange="else"), ("w", "publisher", "w", "a", "f", 1, "go", {"pattern": "ws"}),
        pub("many", "m"), ("ch", "channel", "", "b", "f", 1, "go", {"exchange": "x"}), ("chk", "channel", "", "b", "f", 1, "go", {"exchange": "x", "routing_key": "k"}), ("qq", "channel", "", "b", "f", 1, "go", {"queue": "q", "exchange": "x"}),
    )
    links = spark.createDataFrame([("a", "b", "x"), ("m", "b", "y"), ("m", "z", "v"), ("z", "z", "")], "src string, dst string, exchange string")
    new, edges, lost = L.broker_hints(n, links)
    assert ids(edges, "src", "dst", "type") == {("lone", "ch", "publishes"), ("lone", "qq", "publishes"), ("ch", "named", "subscribes"), ("qq", "named", "subscribes"), ("ch", "by_queue", "subscribes"), ("qq", "by_queue", "subscribes")}
    assert ids(lost, "name") == {"many", "other"} and new.count() == 0
    new, edges, _ = L.broker_hints(n.filter("type <> 'channel'"), links)
    assert ids(new, "id", "service") == {("broker:channel:x", "a")} and ("lone", "broker:channel:x", "publishes") in ids(edges, "src", "dst", "type")


def test_shapes_links_and_wrappers(spark):
    fields = '[{"name":"ID","tag":"json:\\"id,omitempty\\""},{"name":"Name","tag":""},{"name":"Secret","tag":"json:\\"-\\""}]'
    n = table(spark, ("s", "struct", "S", "a", "f", 1, "go", {"fields": fields}), ("t", "struct", "T", "a", "f", 1, "go", {"fields": fields}), ("i", "interface", "I", "b", "f", 1, "ts", {"methods": " id, Name ,"}), ("j", "interface", "J", "b", "f", 1, "ts", {"methods": "id,x"}))
    pairs, left, right = L.response_shapes(n, spark.createDataFrame([("1", "h", "s", "returns")], "id string, src string, dst string, type string"))
    assert pairs.count() == 1 and ids(left, "id") == {"s"} and ids(right.join(pairs, right["class"] == pairs["r"]), "id") == {"i"}
    ledger = spark.createDataFrame([("web", 'os.Getenv("ORDERS_SERVICE_URL")', "dynamic_url"), ("web", "plain", "dynamic_url"), ("web", "process.env.WEB_URL", "dynamic_url"), ("web", 'os.Getenv("ORDERS_URL")', "call_ref")], "service string, name string, kind string")
    channels = table(spark, ("1", "channel", "", "a", "f.go", 1, "go", {"exchange": '"x"'}), ("2", "channel", "", "b", "f.go", 1, "go", {"exchange": "x"}), ("3", "channel", "", "c", "f_test.go", 1, "go", {"exchange": "x"}))
    services = spark.createDataFrame([("orders-api",), ("web",), (None,)], "name string")
    assert ids(L.inferred_links(ledger, channels, services), "src", "dst", "via", "hint") == {("web", "orders-api", "http", "ORDERS_SERVICE_URL"), ("a", "b", "broker", "x"), ("b", "a", "broker", "x")}
    wrappers = spark.createDataFrame([("s", "a", "get", "GET", "/v1/"), ("s", "b", "get", "POST", ""), ("s", "c", "post", "POST", None)], "service string, file string, name string, method string, base_url string")
    calls = spark.createDataFrame([("s", "a", 1, "get", "/x"), ("s", "z", 2, "get", "/y"), ("s", "z", 3, "post", "/z"), ("s", "z", 4, "none", "/z")], "service string, file string, line int, name string, arg string")
    assert ids(L.wrapper_calls(wrappers, calls), "line", "method", "url") == {(1, "get", "/v1/x"), (3, "post", "/z")}
    fields = spark.createDataFrame([("1", "s", "f", 1, "data", "w"), ("2", "s", "f", 1, "url", "w"), ("3", "s", "f", 2, "a", "v"), ("4", "s", "f", 2, "b", "v"), ("5", "s", "f", 3, "path", "v"), ("6", "s", "f", 3, "uri", "v")], "id string, service string, file string, line int, key string, via string")
    picked, unsure = L.picked_candidates(fields, spark.createDataFrame([("s", "f", "w", "data")], "service string, file string, via string, key string"))
    assert ids(picked, "id") == {"1", "3", "6"} and ids(unsure, "name") == {"3"}


def test_middleware_filters_hosts(spark):
    routers = spark.createDataFrame([("root", ""), ("api", "root"), ("v1", "api"), ("x", "y"), ("y", "x")], "router string, parent string")
    uses = spark.createDataFrame([("root", "log", 5), ("v1", "auth", 10), ("x", "loop", 1)], "router string, fn string, line int")
    routes = spark.createDataFrame([("early", "v1", 9), ("late", "v1", 11), ("other", "root", 3), ("cyc", "y", 1)], "id string, router string, line int")
    assert ids(L.middleware(routers, uses, routes), "src", "dst") == {("early", "log"), ("late", "log"), ("late", "auth"), ("cyc", "loop")}
    arrays = "class string, callback string, only array<string>, except array<string>"
    parents = spark.createDataFrame([("C", "B"), ("B", "A")], "class string, parent string")
    filters = spark.createDataFrame([("A", "auth", None, ["index"]), ("C", "own", ["show"], [])], arrays)
    skips = spark.createDataFrame([("B", "auth", ["show"], None)], arrays)
    actions = spark.createDataFrame([(c, a) for c in "ABC" for a in ("index", "show", "new")], "class string, action string")
    assert ids(L.class_filters(parents, filters, skips, actions), "class", "action", "callback", "inherited_from") == {
        ("A", "show", "auth", ""), ("A", "new", "auth", ""), ("B", "new", "auth", "A"), ("C", "new", "auth", "A"), ("C", "show", "own", ""),
    }
    constants = spark.createDataFrame([("s", "a", "", "b"), ("s", "b", "http://orders.test:80/x", ""), ("s", "l", "", "m"), ("s", "m", "", "l"), ("s", "two", "h1", ""), ("s", "two", "h2", "")], "service string, name string, value string, ref string")
    clients = spark.createDataFrame([("1", "s", "a"), ("2", "s", "l"), ("3", "s", "two"), ("4", "t", "a")], "id string, service string, name string")
    links = spark.createDataFrame([("orders.test", "orders")], "host string, target string")
    assert ids(L.resolved_hosts(clients, constants, links), "id", "host", "target_service") == {("1", "orders.test", "orders"), ("2", "", ""), ("3", "", ""), ("4", "", "")}


def test_assets_services_profiles(spark):
    files = spark.createDataFrame([("s", "a/_b.scss"), ("s", "a/c/index.css"), ("s", "lib/d.sass")], "service string, file string")
    asked = spark.createDataFrame([("s", "a/m.scss", i, t) for i, t in enumerate(["b", "./c", "../lib/d", "lib/d", "gone", "http://x/y", "//cdn/z"])], "service string, file string, line int, target string")
    links, lost = L.asset_imports(asked, files)
    assert ids(links, "target", "found") == {("b", "a/_b.scss"), ("./c", "a/c/index.css"), ("../lib/d", "lib/d.sass"), ("lib/d", "lib/d.sass")} and ids(lost, "name") == {"gone"}
    tree = spark.createDataFrame([("go.mod",), ("x.go",), ("web/package.json",), ("web/Gemfile",), ("web/src/a.ts",), ("webby/b.go",)], "file string")
    assert ids(L.discovered_services(tree), "root", "name", "langs", "n_files") == {("", "", "go", 3), ("web", "web", "javascript,ruby", 3)}
    versions = spark.createDataFrame([("s", "go", v) for v in ("v1.22.3", "1.9", "0.1", "2")], "service string, tool string, version string")
    registry = spark.createDataFrame([("go", "1.9", "old"), ("go", "1.22.3", "new"), ("go", "1.10", "mid")], "tool string, version string, profile string")
    assert ids(L.selected_profiles(versions, registry), "version", "profile", "inferred") == {("v1.22.3", "new", False), ("1.9", "old", False), ("0.1", "old", True), ("2", "new", True)}
