import random
from collections import deque

import pytest

from flowskein.operators import evidence, graph_store, linking, rollups
from flowskein.operators import traversal as T

EDGE = "id string, src string, dst string, type string"


def edges(spark, pairs, kind="calls"):
    rows = [(f"{a}->{b}:{t}", a, b, t) for a, b, t in (p if len(p) == 3 else (*p, kind) for p in pairs)]
    return spark.createDataFrame(rows, EDGE)


def seeds(spark, *ids):
    return spark.createDataFrame([(i, i) for i in ids], "root_id string, node_id string")


def test_traversal_equals_breadth_first_search(spark):
    r = random.Random(4)
    pairs = [(f"n{r.randrange(40)}", f"n{r.randrange(40)}") for _ in range(90)]
    want, queue = {"n0": 0}, deque(["n0"])
    while queue:
        at = queue.popleft()
        for a, b in pairs:
            if a == at and b not in want:
                want[b] = want[at] + 1
                queue.append(b)
    got = {r["node_id"]: r["depth"] for r in T.traverse(edges(spark, pairs), seeds(spark, "n0")).collect()}
    assert got == {k: v for k, v in want.items() if v}


def test_policies(spark):
    e = edges(spark, [("a", "b", "contains"), ("b", "c", "calls"), ("a", "v", "reads"), ("v", "w", "calls"), ("a", "d", "calls"), ("d", "b", "calls")])
    hits = {r["node_id"]: r for r in T.traverse(e, seeds(spark, "a"), "out", 0, T.CONTAINMENT_TERMINAL, spark.createDataFrame([("v",)], "id string")).collect()}
    assert set(hits) == {"b", "d"} and hits["b"]["terminal"] and hits["b"]["structural"] and not hits["d"]["structural"]
    assert T.traverse(e, seeds(spark, "nowhere")).count() == 0 and T.traverse(e.limit(0), seeds(spark, "a")).count() == 0


def test_both_ways_keeps_backward(spark):
    got = {(r["node_id"], r["direction"]) for r in T.both_ways(edges(spark, [("a", "b"), ("b", "c"), ("c", "a")]), seeds(spark, "a"), 1).collect()}
    assert got == {("c", "in"), ("b", "out")}


def test_paths(spark):
    e = edges(spark, [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("d", "e")])
    two = T.shortest_paths(e, "a", "d", 5, 4).collect()
    assert [r["nodes"] for r in two] == [["a", "b", "d"], ["a", "c", "d"]]
    assert T.shortest_paths(e, "a", "a").count() == 0 and T.shortest_paths(e, "e", "a").count() == 0
    chains = [r["nodes"] for r in T.chains(e, seeds(spark, "a").select("node_id"), 5).collect()]
    assert chains == [["a", "b", "d", "e"], ["a", "c", "d", "e"]]
    assert T.waypoints(e, ["a", "d", "e"], 4) in (["a", "b", "d", "e"], ["a", "c", "d", "e"])
    with pytest.raises(ValueError):
        T.waypoints(e, ["e", "a"], 4)
    longest = T.longest_chains(e, seeds(spark, "b").select("node_id"), 5, "out").first()
    assert longest["nodes"] == ["b", "d", "a", "c"]


def test_rollup_of_hubs(spark):
    e = edges(spark, [("h", f"t{i}") for i in range(12)] + [("x", "t0")])
    nodes = spark.createDataFrame([(f"t{i}", "svc") for i in range(12)], "id string, service string")
    rows = T.rolled_up(e, nodes).collect()
    assert sorted((r["src"], r["n"]) for r in rows) == [("h", 12), ("x", 1)]


def test_upsert_delete_union(spark):
    rows = spark.createDataFrame([("a", 1, "old"), ("a", 2, "new"), ("a", 2, "new"), ("b", None, "only")], "id string, at int, v string")
    assert {(r["id"], r["v"]) for r in graph_store.latest(rows, ["id"], ["at", "v"]).collect()} == {("a", "new"), ("b", "only")}
    e = edges(spark, [("a", "b"), ("b", "c"), ("c", "d")])
    nodes = spark.createDataFrame([(x,) for x in "abcd"], "id string")
    left, kept = graph_store.without_nodes(nodes, e, spark.createDataFrame([("b",)], "id string"))
    assert left.count() == 3 and [r["src"] for r in kept.collect()] == ["c"]
    assert graph_store.edge_union(e, e).count() == 3


def test_joins_by_position(spark):
    points = spark.createDataFrame([("f", 5, "p5"), ("f", 1, "p1"), ("g", 9, "p9")], "file string, at int, name string")
    spans = spark.createDataFrame([("f", 2, "a"), ("f", 5, "b"), ("f", 7, "c")], "file string, start int, fn string")
    assert {r["name"]: r["enclosing"] for r in linking.enclosing(points, spans, ["file"], "at", "start", "fn").collect()} == {"p5": "b", "p1": None, "p9": None}
    assert {r["name"]: r["nearest"] for r in linking.nearest_after(points, spans, ["file"], "at", "start", "fn").collect()} == {"p5": "b", "p1": "a", "p9": None}
    hunks = spark.createDataFrame([("s", "f", 250, 600), ("s", "f", 1, 0)], "service string, file string, start int, end int")
    nodes = spark.createDataFrame([("s", "f", "x", 1, 900), ("s", "f", "y", 601, 700), ("s", "f", "z", 600, 0), ("t", "f", "w", 300, 310)], "service string, file string, id string, line int, end_line int")
    assert sorted(r["node_id"] for r in linking.overlapping(hunks.filter("end > 0"), nodes).collect()) == ["x", "z"]


def test_similar_sets_equal_brute_force(spark):
    r = random.Random(9)
    make = lambda n: [(f"{n}{i}", [f"w{r.randrange(12)}" for _ in range(r.randrange(1, 9))]) for i in range(60)]
    left, right = make("l"), make("r")
    right += [("copy", left[0][1]), ("copy2", left[0][1])]
    jac = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    want = {(i, j) for i, a in left for j, b in right if len(set(a) & set(b)) >= 2 and jac(a, b) >= 0.8}
    df = lambda rows: spark.createDataFrame(rows, "id string, items array<string>")
    pairs, lm, rm = linking.similar_sets(df(left), df(right))
    got = pairs.join(lm.toDF("i", "l"), "l").join(rm.toDF("j", "r"), "r")
    assert {(x["i"], x["j"]) for x in got.collect()} == want


def test_routes_groups_hints(spark):
    files = ["app/shop/[id]/page.tsx", "pages/index.js", "pages/a/[...slug].vue", "server/api/x.ts", "src/routes/b/+page.svelte", "app/routes/c.$id.tsx", "lib/x.go"]
    got = {r["file"]: (r["dialect"], r["route"]) for r in linking.file_routes(spark.createDataFrame([(f,) for f in files], "file string")).collect()}
    assert got == {
        "app/shop/[id]/page.tsx": ("next-app", "/shop/:id"), "pages/index.js": ("next-pages", "/"), "pages/a/[...slug].vue": ("nuxt", "/a/:slug"), "server/api/x.ts": ("nuxt-server", "/api/x"),
        "src/routes/b/+page.svelte": ("sveltekit", "/b"), "app/routes/c.$id.tsx": ("remix", "/c/:id"),
    }
    groups = spark.createDataFrame([("a", "", "/api"), ("b", "a", "/v1"), ("c", "b", "/x"), ("l", "l", "/loop")], "id string, parent_id string, prefix string")
    assert {r["id"]: r["full"] for r in linking.group_prefixes(groups).collect()} == {"a": "/api", "b": "/api/v1", "c": "/api/v1/x", "l": None}
    clients = spark.createDataFrame([("1", "http://a/api/x"), ("2", "http://b"), ("3", "zzz")], "id string, url string")
    links = spark.createDataFrame([("http://a", "short"), ("http://a/api", "long"), ("http://b", "b")], "base_url string, target string")
    assert {r["id"]: r["target_service"] for r in linking.hinted(clients, links).collect()} == {"1": "long", "2": "b", "3": ""}
    assert linking.hinted(clients, links.limit(0)).filter("target_service <> ''").count() == 0
    sql = spark.createDataFrame([("q", "s", "select * from A.b"), ("w", "s", " Insert into c values (1)"), ("n", "s", "begin")], "id string, service string, sql string")
    assert {(r["dst"], r["type"]) for r in linking.tables_of_queries(sql).collect()} == {("s:table:a.b", "queries"), ("s:table:c", "persists")}


def test_evidence_makes_gaps_and_conflicts(spark):
    src = "struct<provider string, confidence string, ref string, observed_at bigint, code_file string, code_func string>"
    s = lambda p: (p, "", "r", 1, "", "")
    static = spark.createDataFrame([("1", "a", "b", "http_call", "get /x", "static", [s("static")])], f"id string, src string, dst string, type string, label string, confidence string, sources array<{src}>")
    facts = spark.createDataFrame([("q", "b", "http_call", "get /x", s("runtime")), ("a", "z", "http_call", "", s("runtime"))], f"src string, dst string, type string, label string, source {src}")
    rows = {r["id"]: [x["provider"] for x in r["sources"]] for r in evidence.fused(static, facts).collect()}
    assert rows == {"1": ["runtime", "static"], "gap:http_call::a->z": ["runtime"]}
    edges_ = evidence.fused(static, facts).unionByName(spark.createDataFrame([("g", "q", "b", "http_call", "get /x", "", [s("runtime")])], static.schema))
    assert {r["id"]: r["state"] for r in evidence.recomputed(edges_).collect()} == {"1": "verified", "gap:http_call::a->z": "observed_only_gap", "g": "conflicting"}


def test_channel_roles(spark):
    rows = spark.createDataFrame([("a", ""), ("a", "producer"), ("b", "producer"), ("b", "consumer"), ("c", "both"), ("c", "consumer"), ("d", "")], "id string, role string")
    assert {r["id"]: r["role"] for r in rollups.channel_roles(rows, ["id"]).collect()} == {"a": "producer", "b": "both", "c": "both", "d": ""}


def test_similar_within_links_all_sources(spark):
    r = random.Random(3)
    sets = []
    for _ in range(40):
        base = [f"w{r.randrange(60)}" for _ in range(r.randrange(1, 30))]
        sets += [base, base[::-1], [*base, "x"], base[: len(base) * 9 // 10]]
    rows = [(str(i), r.choice(["docs", "a", "b", "", None]), s) for i, s in enumerate(sets)] + [("none", "a", None), ("one", "a", ["w1"])]
    docs = spark.createDataFrame(rows, "id string, source string, items array<string>")
    near = lambda a, b: len(a) > 1 and len(b) > 1 and len(a & b) >= 2 and len(a & b) / len(a | b) >= 0.8 - 1e-12
    plain = [(i, s or "", set(x or [])) for i, s, x in rows]
    want = {i: (sum(near(x, y) for j, _, y in plain if j != i), sum(near(x, y) for j, t, y in plain if j != i and s == t)) for i, s, x in plain}
    got = linking.similar_within(docs, "source").collect()
    assert len(got) == len(rows) and {g["id"]: (g["n_links"], g["n_own"]) for g in got} == want
    assert len({g["class"] for g in got}) == len({frozenset(x) for _, _, x in plain})


def test_no_bound_on_links_lengths_levels_or_groups(spark, monkeypatch):
    """More of each than the limits that once stood here: 1,200 base lengths and 11,000 links, groups 40 deep, chains of 120 levels, 50 ancestors."""
    from flowskein import session
    from flowskein.operators import answers

    links = [("h" * n, f"t{n}") for n in range(1, 1_201)] + [(f"http://x{i}/", f"x{i}") for i in range(11_000)]
    clients = spark.createDataFrame([("1", "h" * 1_200 + "/a"), ("2", "http://x10999/b"), ("3", "nothing"), ("4", None), ("5", "h")], "id string, url string")
    found = linking.hinted(clients, spark.createDataFrame([*links, (None, "n"), ("", "e")], "base_url string, target string")).collect()
    assert {r["id"]: r["target_service"] for r in found} == {"1": "t1200", "2": "x10999", "3": "", "4": "", "5": "t1"}
    monkeypatch.setattr(session.Levels, "COMPACT", 5)
    groups = [("g0", None, "/g0")] + [(f"g{i}", f"g{i - 1}", f"/g{i}") for i in range(1, 40)] + [("a", "b", "/a"), ("b", "a", "/b"), ("c", "gone", "/c")]
    rows = {r["id"]: (r["full"], r["depth"]) for r in linking.group_prefixes(spark.createDataFrame(groups, "id string, parent_id string, prefix string")).collect()}
    assert rows["g39"] == ("".join(f"/g{i}" for i in range(40)), 39) and rows["a"] == rows["b"] == rows["c"] == (None, -1)
    chain = spark.createDataFrame([(f"e{i}", f"n{i}", f"n{i + 1}", "calls") for i in range(40)], "id string, src string, dst string, type string")
    hits = T.traverse(chain, spark.createDataFrame([("n0", "n0")], "root_id string, node_id string")).collect()
    assert {r["node_id"]: r["depth"] for r in hits} == {f"n{i}": i for i in range(1, 41)}
    parents = spark.createDataFrame([(f"C{i}", f"C{i + 1}") for i in range(40)], "class string, parent string")
    calls = spark.createDataFrame([("1", "C0", "m")], "id string, class string, name string")
    assert answers.inherited(calls, parents, spark.createDataFrame([("C40", "m", "x")], "class string, name string, method_id string")).first()["depth"] == 40


def test_similar_sets_are_numbered(spark, monkeypatch):
    """Sets of both sides are written once, by number, and so are the pairs that hold; one in both sides is its own pair."""
    tried, materialize = [], linking.materialize
    rows = lambda k: spark.createDataFrame([(f"{k}{i}", ["x", "y", *(f"{k}{i}-{j}" for j in range(2 + i % 3))]) for i in range(30)], "id string, items array<string>")
    near = spark.createDataFrame([("n", ["x", "y", "l0-0", "l0-1"])], "id string, items array<string>")
    monkeypatch.setattr(linking, "materialize", lambda df, name: tried.append(name) or materialize(df, name))
    pairs, lm, rm = linking.similar_sets(rows("l"), rows("r").unionByName(near))
    got = pairs.join(lm.withColumnsRenamed({"class": "l", "id": "a"}), "l").join(rm.withColumnsRenamed({"class": "r", "id": "b"}), "r").select("a", "b", "shared", "jaccard").collect()
    assert [tuple(r) for r in got] == [("l0", "n", 4, 1.0)] and tried == ["sets", "pairs"]


def test_hints_cut_each_url_once(spark):
    """Clients of one URL are not exploded by the lengths of the bases; each client of an id has its own URL's target."""
    links = spark.createDataFrame([("http://a.test" + "/x" * k, f"t{k}") for k in range(30)], "base_url string, target string")
    rows = [(str(i), "http://a.test/x/x/y") for i in range(200)] + [("0", "http://b.test"), ("n", None)]
    got = linking.hinted(spark.createDataFrame(rows, "id string, url string"), links)
    assert got.columns == ["id", "url", "target_service"] and got.count() == len(rows)
    assert {(r["url"], r["target_service"]) for r in got.collect()} == {("http://a.test/x/x/y", "t2"), ("http://b.test", ""), (None, "")}


def test_pairs_of_sets_are_compared_by_number(spark, monkeypatch):
    """What is brought to a candidate pair are the numbers of its items, whatever the items' length."""
    word = lambda k: f"{k:04}" + "x" * 200
    sets = [(i, [word(k) for k in range(i % 5, 20 + i % 3)] + [word(100 + i)]) for i in range(12)]
    docs = spark.createDataFrame([(str(i), items, "s") for i, items in sets], "id string, items array<string>, source string")
    written, materialize = {}, linking.materialize
    monkeypatch.setattr(linking, "materialize", lambda df, name: written.setdefault(name, materialize(df, name)))
    links = {int(r["id"]): r["n_links"] for r in linking.similar_within(docs, "source").collect()}
    same = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    assert links == {i: sum(same(a, b) >= 0.8 - 1e-12 for j, b in sets if i != j) for i, a in sets}
    assert "items" not in written["sets"][0].columns and dict(written["sets"][0].dtypes)["nos"] == "array<bigint>"
