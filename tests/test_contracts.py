"""Contract rules over crowded keys: what is written grows with the sides, not with their pairs."""

from dataclasses import replace

from flowskein.operators import contracts

SCHEMA = "id string, type string, label string, service string, file string, line int, lang string, meta map<string,string>"
HTTP = contracts.RULES[0]
N = 60


def clients(service="web", lang="go", **meta):
    return [(f"c{i:03}", "http_client", "", service, "a.go", i, lang, {"method": "get", "path": "/v/items", **meta}) for i in range(N)]


def handlers(*services, path="/v/items"):
    return [(f"h-{s}-{i:03}", "http_handler", "", s, "b.go", i, "go", {"method": "get", "path": path}) for s in services for i in range(N)]


def linked(spark, monkeypatch, rows, rule):
    """The result of the rule, and the rows of the largest table that it wrote."""
    written, real = [], contracts.materialize

    def counted(df, name):
        out = real(df, name)
        written.append(out[0].count())
        return out

    monkeypatch.setattr(contracts, "materialize", counted)
    done = contracts.link(spark.createDataFrame(rows, SCHEMA), rule)
    return done, max(written)


def test_pairs_are_never_written(spark, monkeypatch):
    rows = clients(method="") + handlers("api", "web", path="/V/items") + [("c999", "http_client", "", "web", "a.go", 999, "go", {"method": "get", "path": "/none/such"})]
    done, most = linked(spark, monkeypatch, rows, HTTP)
    edges = done.edges.collect()
    assert len({r["id"] for r in edges}) == len(edges) == N * 2 * N
    assert {(r["confidence"], r["tier"], r["label"]) for r in edges} == {("partial", "normalized", "get /v/items")}
    assert most <= 2 * N + 1


def test_unknown_edges_need_no_pairs(spark, monkeypatch):
    rows = clients() + handlers("api") + [("c999", "http_client", "", "web", "a.go", 999, "go", {"method": "get", "path": "/none/such"})]
    done, most = linked(spark, monkeypatch, rows, HTTP)
    assert [(r["id"], r["dst"]) for r in contracts.unknown_edges(done.unmatched, HTTP).collect()] == [("link:c999->unresolved", "unresolved")]
    assert most <= N + 1


def test_told_targets(spark, monkeypatch):
    told = [(i, *rest, meta | {"target_service": ("web", "api", "none", "")[k % 4]}) for k, (i, *rest, meta) in enumerate(clients())]
    done, most = linked(spark, monkeypatch, told + handlers("api", "web"), HTTP)
    got = {(int(r["src"][1:]) % 4, r["dst"].split("-")[1], r["confidence"]) for r in done.edges.collect()}
    assert got == {(0, "web", "static"), (1, "api", "static"), (3, "web", "partial"), (3, "api", "partial")}
    assert done.edges.count() == N // 4 * 4 * N and done.unmatched.count() == N // 4
    assert most <= 2 * N


def test_exchanges(spark, monkeypatch):
    p = [(f"p{i:03}", "channel", "", "web", "a.go", i, "go", {"exchange": "ex", "routing_key": "#" if i % 2 else "k.one"}) for i in range(N)]
    c = [(f"q{i:03}", "channel", "", "api", "b.go", i, "go", {"exchange": "ex", "routing_key": "#" if i % 3 == 0 else "k.two", "role": "consumer"}) for i in range(N)]
    done, most = linked(spark, monkeypatch, p + c, contracts.RULES[2])
    got = sorted((r["src"], r["dst"], r["tier"]) for r in done.edges.collect())
    open_p, open_c = lambda i: i % 2 == 1, lambda i: i % 3 == 0  # an open key equals an open key
    want = [(f"p{i:03}", f"q{j:03}", "exact" if open_p(i) else "exchange_only") for i in range(N) for j in range(N) if open_c(j)]
    assert got == sorted(want) and most <= N


def test_unmatched_of_own_services_only(spark, monkeypatch):
    done, most = linked(spark, monkeypatch, clients() + handlers("api"), replace(HTTP, same_service="same_service_only"))
    assert done.edges.count() == 0 and done.unmatched.count() == N
    done, most = linked(spark, monkeypatch, clients() + handlers("api", "web"), HTTP)
    assert done.unmatched.count() == 0 and most <= 2 * N


def test_other_services(spark, monkeypatch):
    done, most = linked(spark, monkeypatch, clients() + handlers("api", "web"), replace(HTTP, same_service="skip"))
    assert {(r["dst"].split("-")[1], r["confidence"]) for r in done.edges.collect()} == {("api", "static")} and done.edges.count() == N * N
    assert most <= 2 * N
