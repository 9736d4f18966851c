"""Queries over the graph tables, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowskein.functions import predicates as P
from flowskein.operators import graph_store as G
from flowskein.operators import linking, rollups
from flowskein.operators import traversal as T
from flowskein.session import stored, table, table_version
from flowskein.sources import patterns

HUB = "shared-kit:pkg/util/mixed.go:function:Sundry:227"
SPAN_HUB = "shared-kit:pkg/flow/sinkhole.go:function:sink:162"


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current nodes, stored once a session; sorted by type, so that a type's rows lie together."""
    made = lambda: G.current_nodes(table(spark, sf_dir, "nodes"), table(spark, sf_dir, "shared_nodes")).sortWithinPartitions("type")
    return stored(spark, "current-nodes", tuple(table_version(spark, sf_dir, n) for n in ("nodes", "shared_nodes")), made)


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current edges, stored once a session; sorted by type and source, so that filters on them skip most row groups."""
    made = lambda: G.current_edges(table(spark, sf_dir, "edges")).sortWithinPartitions("type", "src")
    return stored(spark, "current-edges", (table_version(spark, sf_dir, "edges"),), made)


def http_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the current edges the HTTP calls that tell a path and a route, stored once a session."""
    made = lambda: G.current_edges_where(table(spark, sf_dir, "edges"), "type = 'http_call' AND http_path <> '' AND label LIKE '% %'").drop("sources")
    return stored(spark, "http-calls", (table_version(spark, sf_dir, "edges"),), made)


def both(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return nodes(spark, sf_dir), edges(spark, sf_dir)


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event-type transitions: a small cyclic graph for path operators."""
    from pyspark.sql import Window as W

    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    steps = table(spark, sf_dir, "events").select(F.col("event_type").alias("src"), F.lead("event_type").over(order).alias("dst")).filter("dst IS NOT NULL")
    pairs = steps.groupBy("src", "dst").agg(F.count("*").alias("n"))
    return pairs.select(F.concat("src", F.lit("->"), "dst").alias("id"), "src", "dst", F.lit("next").alias("type"), "n")


def _seed(spark: SparkSession, *ids: str) -> DataFrame:
    return spark.createDataFrame([(i, i) for i in ids], "root_id string, node_id string")


def graph_stats(spark, sf_dir):
    """Nodes and edges in all."""
    n, e = both(spark, sf_dir)
    return n.agg(F.count("*").alias("n")).withColumn("what", F.lit("nodes")).unionByName(e.agg(F.count("*").alias("n")).withColumn("what", F.lit("edges")))


def current_edge_states(spark, sf_dir):
    """Upsert: the last state of every edge."""
    return edges(spark, sf_dir).select("id", "src", "dst", "type", "confidence", "verification_state")


def current_node_rows(spark, sf_dir):
    """Upsert: the last sighting of every node."""
    return nodes(spark, sf_dir).select("id", "type", "label", "service", "file", "line")


def point_lookup(spark, sf_dir):
    return G.by_id(nodes(spark, sf_dir), HUB).select("id", "type", "label", "file")


def edge_scan(spark, sf_dir):
    return G.edges_of(edges(spark, sf_dir), HUB, "out").select("id", "type", "dst")


def nodes_by_type_ranked(spark, sf_dir):
    """A feature of the listing: the first 50 functions."""
    return G.nodes_of_type(nodes(spark, sf_dir), "function", limit=50).select("id", "label", "service")


def delete_cascade(spark, sf_dir):
    """Edges left after all elements are deleted, by type."""
    n, e = both(spark, sf_dir)
    _, left = G.without_nodes(n, e, n.filter("type = 'element'").select("id"))
    return left.groupBy("type").agg(F.count("*").alias("n"))


def graph_page(spark, sf_dir):
    """Third page of 100 nodes: edges that leave it."""
    _, out = G.page(*both(spark, sf_dir), 3, 100)
    return out.select("id", "src", "dst")


def ledger_replace(spark, sf_dir):
    """One ledger row for each unresolved end by service of the other end and name."""
    e = table(spark, sf_dir, "edges").filter("dst = 'unresolved' OR startswith(dst, 'unresolved:')")
    return G.replaced(e.select("src", "type", "dst"), ["src", "type", "dst"])


def _runs(spark, sf_dir):
    e = table(spark, sf_dir, "edges")
    return e.groupBy(F.to_date("indexed_at").alias("run_at"), "type").agg(F.count("*").alias("count"))


def history_latest_runs(spark, sf_dir):
    """Rows of the newest five days of index runs."""
    return G.kept_runs(_runs(spark, sf_dir), 5).select(F.col("run_at").cast("string").alias("run_at"), "type", F.col("count").alias("n"))


def audit_page(spark, sf_dir):
    """Second page of failed calls, newest first."""
    calls = G.latest(table(spark, sf_dir, "tool_calls").select("id", "source", "tool", "status", "received_at"), ["id"], ["received_at", "tool", "source", "status"])
    return G.audit_page(calls, status="error", offset=50, limit=50).select("id")


def audit_retention(spark, sf_dir):
    """The newest 20 calls of every tool: the retention rule."""
    calls = table(spark, sf_dir, "tool_calls").select("id", F.lower(F.trim("tool")).alias("tool")).distinct()
    return G.kept_newest(calls, ["tool"], "id", 20)


def edge_union(spark, sf_dir):
    """Edges of two passes, each id once."""
    e = edges(spark, sf_dir).select("id", "src", "dst", "type")
    return G.edge_union(e.filter("type IN ('calls', 'imports')"), e.filter("type IN ('calls', 'reads')")).groupBy("type").agg(F.count("*").alias("n"))


def descendants_bfs(spark, sf_dir):
    """What the hub reaches within three hops."""
    return T.traverse(edges(spark, sf_dir), _seed(spark, HUB), "out", 3).select("node_id", F.col("depth").cast("bigint").alias("depth"))


def _locals(n: DataFrame) -> DataFrame:
    return n.filter((F.col("type") == "variable") & (P.meta("meta", "scope") == "captured")).select("id")


def _backward_seed(spark, sf_dir):
    # the node that most edge rows point to
    counts = table(spark, sf_dir, "edges").filter("trim(dst) <> '' AND dst <> 'unresolved'").groupBy("dst").count()
    most = counts.agg(F.max(F.struct("count", "dst"))["dst"].alias("node_id"))
    return most.select(F.col("node_id").alias("root_id"), "node_id")


def impact_backward(spark, sf_dir):
    """What depends on the node that most edges point to, within four hops."""
    n, e = both(spark, sf_dir)
    return T.traverse(e, _backward_seed(spark, sf_dir), "in", 4, T.BLAST_RADIUS, _locals(n)).select("node_id", F.col("depth").cast("bigint").alias("depth"))


def impact_both(spark, sf_dir):
    """Backward and forward impact; a node found backward counts there."""
    n, e = both(spark, sf_dir)
    return T.both_ways(e, _backward_seed(spark, sf_dir), 2, T.BLAST_RADIUS, _locals(n)).select("node_id", "direction", F.col("depth").cast("bigint").alias("depth"))


def impact_terminal_policy(spark, sf_dir):
    """Containment is reported, but not walked on."""
    n, e = both(spark, sf_dir)
    hits = T.traverse(e, _seed(spark, HUB), "out", 3, T.CONTAINMENT_TERMINAL, _locals(n))
    return hits.select("node_id", F.col("depth").cast("bigint").alias("depth"), "terminal")


def impact_multi_root(spark, sf_dir):
    """Nearest of two roots for every node that they reach."""
    hits = T.traverse(edges(spark, sf_dir), _seed(spark, HUB, SPAN_HUB), "out", 2)
    return T.best_hits(hits).select("node_id", F.col("depth").cast("bigint").alias("depth"), "root_id")


def file_impact(spark, sf_dir):
    """Impact rolled up to files."""
    n, e = both(spark, sf_dir)
    hits = T.traverse(e, _seed(spark, HUB), "out", 2)
    seed = n.filter(F.col("id") == HUB).select("service", "file")
    return rollups.file_impact(hits, n, seed).select("service", "file", "n_nodes", "min_depth")


def entry_points_hit(spark, sf_dir):
    """Dependants that nothing enters."""
    e = edges(spark, sf_dir)
    return rollups.entry_points_hit(T.traverse(e, _backward_seed(spark, sf_dir), "in", 4), e).select("node_id")


def related_files(spark, sf_dir):
    """Files around the hub's file."""
    n, e = both(spark, sf_dir)
    return rollups.related_files(e, n, n.filter(F.col("id") == HUB).select("service", "file"))


def noise_classes(spark, sf_dir):
    """Edges by noise class and type."""
    n, e = both(spark, sf_dir)
    joined = e.join(n.select(F.col("id").alias("dst"), F.col("type").alias("dst_type")), "dst", "left")
    return joined.groupBy("type", P.noise_class(F.col("type"), F.lit(""), F.col("dst_type")).alias("noise")).agg(F.count("*").alias("n"))


def test_files(spark, sf_dir):
    """Nodes by both test-file predicates."""
    return nodes(spark, sf_dir).groupBy(P.is_test_file(F.col("file")).alias("is_test"), P.test_rank_penalty(F.col("file")).cast("bigint").alias("penalty")).agg(F.count("*").alias("n"))


def min_verification(spark, sf_dir):
    """Edges that pass each least verification."""
    e = edges(spark, sf_dir)
    passes = [F.count_if(P.passes_verification(F.col("verification_state"), v)).alias(v) for v in ("any", "observed", "declared", "verified")]
    return e.groupBy("type").agg(*passes)


def _hunks(n: DataFrame) -> DataFrame:
    held = n.filter("file <> '' AND line > 0").groupBy("service", "file").agg(F.min("line").alias("least"))
    return held.select("service", "file", (F.col("least") + 5).alias("start"), (F.col("least") + 60).alias("end"))


def diff_spans(spark, sf_dir):
    """Nodes that a changed span of their file meets."""
    n = nodes(spark, sf_dir)
    return linking.overlapping(_hunks(n), n).select("service", "file", "start", "end", "node_id")


def diff_impact(spark, sf_dir):
    """Dependants of the nodes in changed spans of shared files, within two hops."""
    n, e = both(spark, sf_dir)
    hit = linking.overlapping(_hunks(n.filter("service = 'shared-kit'")), n)
    seeds = hit.select(F.lit("diff").alias("root_id"), "node_id").distinct()
    return T.traverse(e, seeds, "in", 2).join(seeds.select("node_id"), "node_id", "left_anti").select("node_id", F.col("depth").cast("bigint").alias("depth"))


def enclosing_functions(spark, sf_dir):
    """The function that starts last at or before each client call in its file."""
    n = nodes(spark, sf_dir).filter("file <> ''")
    points = n.filter("type = 'http_client'").select("service", "file", "line", F.col("id").alias("call_id"))
    spans = n.filter("type = 'function'").select("service", "file", "line", F.col("id").alias("fn"))
    return linking.enclosing(points, spans, ["service", "file"], "line", "line", "fn").select("call_id", F.coalesce("enclosing", F.lit("")).alias("fn"))


def nearest_below(spark, sf_dir):
    """The first subscriber that starts at or after each publisher in its file."""
    n = nodes(spark, sf_dir).filter("file <> ''")
    points = n.filter("type = 'publisher'").select("service", "file", "line", F.col("id").alias("pub_id"))
    spans = n.filter("type = 'subscriber'").select("service", "file", "line", F.col("id").alias("sub"))
    near = linking.nearest_after(points, spans, ["service", "file"], "line", "line", "sub")
    line = spans.select(F.col("sub").alias("nearest"), F.col("line").alias("sub_line"))
    return near.join(line, "nearest", "left").select("pub_id", F.coalesce("sub_line", F.lit(-1)).cast("bigint").alias("sub_line"))


def k_shortest_paths(spark, sf_dir):
    """Five shortest ways from view to purchase."""
    return T.shortest_paths(transitions(spark, sf_dir), "view", "purchase", 5, 4).select(F.array_join("nodes", ">").alias("path"), F.col("hops").cast("bigint").alias("hops"))


def chain_enumeration(spark, sf_dir):
    """First 30 chains from view, three hops at most."""
    c = T.chains(transitions(spark, sf_dir), _seed(spark, "view").select("node_id"), 3, 30)
    return c.select(F.array_join("nodes", ">").alias("path"))


def longest_chain(spark, sf_dir):
    """Longest simple chain from every event type."""
    t = transitions(spark, sf_dir)
    return T.longest_chains(t, t.select(F.col("src").alias("node_id")).distinct(), 4, "out").select("node_id", F.col("hops").cast("bigint").alias("hops"), F.array_join("nodes", ">").alias("path"))


def flow_walk_rollup(spark, sf_dir):
    """Edges for flow walks, hubs rolled up."""
    n, e = both(spark, sf_dir)
    flow = T.rolled_up(e.filter(P.is_resolution(F.col("type"))), n)
    return flow.groupBy("type", (F.col("n") > 1).alias("is_rollup")).agg(F.count("*").alias("n_hops"), F.sum("n").alias("n_edges"))


def seam(spark, sf_dir):
    """Producers and consumers of the channel of the least labelled call."""
    e = edges(spark, sf_dir)
    first = e.filter("label <> ''").agg(F.min("id")).first()[0]
    return T.seam_sides(e, first)


def link_explorer(spark, sf_dir):
    """First page of what links to the hub, two hops."""
    n, e = both(spark, sf_dir)
    return T.link_page(e, n, HUB, "out", 2, 0, 50).select("node_id", F.col("depth").cast("bigint").alias("depth"), "total")


def cross_service_edges(spark, sf_dir):
    n, e = both(spark, sf_dir)
    return T.cross_service(e, n).groupBy("src_service", "dst_service", "type").agg(F.count("*").alias("n"))


def scope_graph(spark, sf_dir):
    """Edges inside and at the border of the shared library."""
    n, e = both(spark, sf_dir)
    return T.within(n, e, n.filter("service = 'shared-kit'").select("id")).groupBy("type", "stub").agg(F.count("*").alias("n"))


def _of_both(name, f, doc):
    def query(spark, sf_dir):
        return f(*both(spark, sf_dir))

    query.__name__, query.__doc__ = name, doc
    return query


def _of_nodes(name, f, doc):
    def query(spark, sf_dir):
        return f(nodes(spark, sf_dir))

    query.__name__, query.__doc__ = name, doc
    return query


def contract_coverage(spark, sf_dir):
    return rollups.contract_coverage(edges(spark, sf_dir))


def verification_summary(spark, sf_dir):
    """Edges by state and type, and stale ones as of mid-June 2025."""
    return rollups.verification_summary(edges(spark, sf_dir), F.lit(1_750_000_000), ("type",))


def file_folding(spark, sf_dir):
    """Edges after the shared library's files became one node each."""
    n, e = both(spark, sf_dir)
    files = n.filter("service = 'shared-kit' AND file <> ''").select("service", "file").distinct()
    return rollups.folded_files(e, n, files).groupBy("type").agg(F.count("*").alias("n"))


def unparsed_files(spark, sf_dir):
    return rollups.unparsed(nodes(spark, sf_dir).filter("file <> ''"), ("go", "ts"))


def channel_roles(spark, sf_dir):
    """Role of every node that publishes or subscribes."""
    e = edges(spark, sf_dir)
    role = F.when(F.col("type") == "publishes", "producer").otherwise("consumer")
    rows = e.filter("type IN ('publishes', 'subscribes')").select(F.col("src").alias("node_id"), role.alias("role"))
    return rollups.channel_roles(rows, ["node_id"]).groupBy("role").agg(F.count("*").alias("n"))


def containment_links(spark, sf_dir):
    """Containment edges derived from columns, by kind of source."""
    out = linking.containment(nodes(spark, sf_dir))
    kind = F.when(F.col("src").startswith("service:"), "service").when(F.col("src").endswith(":file"), "file").otherwise("class")
    return out.groupBy(kind.alias("src_kind")).agg(F.countDistinct("id").alias("n"))


def datastore_links(spark, sf_dir):
    """Clients to the tables of their service, by confidence."""
    out = linking.datastores(nodes(spark, sf_dir), ("http_client",), "table")
    return out.groupBy("confidence").agg(F.count("*").alias("n"))


def handshake_outcomes(spark, sf_dir):
    """Publishers by how many subscribers elsewhere bear their label."""
    n = nodes(spark, sf_dir)
    pick = lambda t: n.filter(F.col("type") == t).select("id", "service", F.col("label").alias("field"))
    return linking.handshakes(pick("publisher"), pick("subscriber")).groupBy("outcome").agg(F.count("*").alias("n"), F.sum("n_matches").alias("n_matches"))


def convention_links(spark, sf_dir):
    """Publishers to functions of their name: own file, else service, else the only one anywhere."""
    n = nodes(spark, sf_dir)
    calls = n.filter("type = 'publisher'").select("id", "service", "file", F.col("label").alias("name"))
    decls = n.filter("type IN ('function', 'method')").select("id", "service", "file", "label")
    return linking.by_convention(calls, decls).groupBy("scope").agg(F.count("*").alias("n"), F.countDistinct("id").alias("n_calls"))


def route_handlers(spark, sf_dir):
    """Handlers to the function of their label, by the receiver that their file's class gives."""
    n = nodes(spark, sf_dir)
    routes = n.filter("type = 'http_handler'").select("id", "service", F.col("label").alias("handler"))
    return linking.routes_to_handlers(routes, n.filter("type IN ('function', 'method')")).select("id", "fn", F.col("rank").cast("bigint").alias("rank"))


def shared_channel_keys(spark, sf_dir):
    """Labels of clients that several services share."""
    rows = nodes(spark, sf_dir).filter("type = 'http_client'").select("service", F.col("label").alias("key"))
    return linking.shared_channels(rows)


def similar_documents(spark, sf_dir):
    """Word sets of chunks against those of other sources: class and number of links of every chunk that has one."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.lower(F.trim("source")).alias("source"), F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "").alias("items"))
    left, right = docs.filter("source = 'docs'").select("id", "items"), docs.filter("source <> 'docs'").select("id", "items")
    pairs, lm, rm = linking.similar_sets(left, right)
    size = rm.groupBy(F.col("class").alias("r")).agg(F.count("*").alias("n"))
    links = pairs.join(size, "r").groupBy(F.col("l").alias("class")).agg(F.sum("n").alias("n_links"))
    return lm.join(links, "class").select("id", "class", "n_links")


def similar_documents_all(spark, sf_dir):
    """Every chunk with its class of equal word sets, and its links to chunks of any source and of its own (blank is one)."""
    items = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.lower(F.trim("source")).alias("source"), items.alias("items"))
    return linking.similar_within(docs, "source")


def _ledger(spark, sf_dir):
    """Unresolved references: edges to the sentinel, with their source's service and file."""
    rows = table(spark, sf_dir, "edges").filter("dst = 'unresolved' OR startswith(dst, 'unresolved:')").select(F.col("src").alias("id"), F.col("type").alias("kind"), F.col("dst").alias("name"))
    return rows.join(nodes(spark, sf_dir).select("id", "service", "file"), "id").select("service", "file", "name", "kind")


def health_report(spark, sf_dir):
    """Counts of the whole graph."""
    return rollups.health(*both(spark, sf_dir), _ledger(spark, sf_dir))


def ledger_filter(spark, sf_dir):
    """Unresolved calls that name or lie in something with 'web'."""
    return rollups.ledger_rows(_ledger(spark, sf_dir), kind="calls", q="web").groupBy("service", "file").agg(F.count("*").alias("n"))


def file_nodes(spark, sf_dir):
    """Nodes of every file whose path ends in that of the shared barrel."""
    return linking.nodes_in_file(nodes(spark, sf_dir), "barrel/index.ts").select("id", "file")


def scanned_files(spark, sf_dir):
    """Documents' paths that declare no node, by service."""
    scanned = table(spark, sf_dir, "documents").select(P.given(F.col("service")).alias("service"), F.col("path").alias("file")).distinct()
    return linking.scanned_files(nodes(spark, sf_dir), scanned).groupBy("service").agg(F.count("*").alias("n"))


def flows_through(spark, sf_dir):
    """Chains from view or signup through purchase, three hops at most."""
    starts = spark.createDataFrame([("view",), ("signup",)], "node_id string")
    return T.flows_through(transitions(spark, sf_dir), starts, "purchase", 3, 25).select(F.array_join("nodes", ">").alias("path"))


#: Extensions that the chunks get in turn, so that every language's patterns meet all kinds of text.
PATTERN_EXTS = ("go", "py", "ts", "rb", "html", "css", "sql", "proto", "graphql", "templ")


def pattern_nodes(spark, sf_dir):
    """What all packs find in all chunks, each read as a file of one of the languages in turn."""
    ext = F.element_at(F.array(*(F.lit(x) for x in PATTERN_EXTS)), (F.pmod("doc_id", F.lit(len(PATTERN_EXTS))) + 1).cast("int"))
    docs = table(spark, sf_dir, "documents").select(F.concat_ws(".", F.col("doc_id").cast("string"), ext).alias("path"), "text")
    return patterns.extract(docs, "docs").groupBy(F.col("meta")["pattern"].alias("pattern"), "type").agg(F.count("*").alias("n"), F.countDistinct("label").alias("n_labels"))


#: A line of code for a node, by extension and node type; the label takes the place of %.
CODE_LINES = {
    "go": {"function": "func %(x int) {", "struct": "type % struct {", "class": "type % interface {", "method": "func (s *Srv) %(x int) {", "http_handler": 'r.GET("/%", h); r.POST("/%/new", h)', "http_client": 'http.Get("http://h/%")',
           "publisher": 'nc.Publish("%", b)', "subscriber": 'nc.Subscribe("%", f)', "table": 'db.Query("select a from %")', "variable": 'x := os.Getenv("%")'},
    "py": {"function": "def %(x):", "class": "class %(Base):", "method": "    def %(self):", "http_handler": '@app.get("/%")', "http_client": 'requests.post("http://h/%")', "publisher": "%.delay(1)", "variable": 'os.environ["X"]', "table": '__tablename__ = "%"'},
    "ts": {"function": "export function %(x) {", "class": "export class % {", "struct": "export interface % {", "http_handler": "router.get('/%', h)", "http_client": "fetch(`/api/%`)", "subscriber": 'socket.on("message", %)', "element": 'document.getElementById("%")',
           "component": "export const % = (props) => {", "variable": "export type % = string"},
    "rb": {"method": "  def %", "class": "class % < Base", "struct": "module %", "http_handler": "  get '/%'", "http_client": "Faraday.get('/%')", "publisher": "%.perform_later(1)", "table": "  has_many :%", "variable": "  before_action :%"},
}


def _code_line() -> str:
    """SQL for the line of a node, '' for types that have none; runs on both engines."""
    cases = " ".join(f"WHEN ext = '{ext}' AND type = '{kind}' THEN replace('" + line.replace("'", "''") + "', '%', label)" for ext, kinds in CODE_LINES.items() for kind, line in kinds.items())
    return f"CASE {cases} ELSE '' END"


def pattern_sources(spark, sf_dir):
    """What the packs find in files that hold a line of code for each of their nodes."""
    n = nodes(spark, sf_dir).filter("service <> '' AND file LIKE '%.%' AND label <> ''").withColumn("ext", F.regexp_extract("file", r"\.([^./]+)$", 1))
    line = n.select("service", "file", "id", F.expr(_code_line()).alias("line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "line"))), lambda x: x["line"]), "\n")
    made = line.groupBy("service", "file").agg(text.alias("text")).select(F.concat_ws("/", "service", "file").alias("path"), "text")
    found = patterns.extract(made, "src")
    return found.groupBy("lang", F.col("meta")["pattern"].alias("pattern"), "type").agg(F.count("*").alias("n"), F.countDistinct("label").alias("n_labels"), F.count_if(F.col("meta")["is_test"] == "true").alias("n_tests"))


QUERIES = {
    f.__name__: f
    for f in (
        health_report, ledger_filter, file_nodes, scanned_files, flows_through, pattern_nodes, pattern_sources,
        graph_stats, current_edge_states, current_node_rows, point_lookup, edge_scan, nodes_by_type_ranked, delete_cascade, graph_page, ledger_replace,
        history_latest_runs, audit_page, audit_retention, edge_union, descendants_bfs, impact_backward, impact_both, impact_terminal_policy, impact_multi_root,
        file_impact, entry_points_hit, related_files, noise_classes, test_files, min_verification, diff_spans, diff_impact, enclosing_functions, nearest_below,
        k_shortest_paths, chain_enumeration, longest_chain, flow_walk_rollup, seam, link_explorer, cross_service_edges, scope_graph, contract_coverage,
        verification_summary, file_folding, unparsed_files, channel_roles, containment_links, datastore_links, handshake_outcomes, convention_links,
        route_handlers, shared_channel_keys, similar_documents, similar_documents_all,
        _of_both("stack_profile", rollups.stack_profile, "Profile of every service."),
        _of_both("type_counts", rollups.type_counts, "Nodes and edges by service and type."),
        _of_both("service_channels", lambda n, e: rollups.service_channels(e, n), "Channels between services."),
        _of_both("root_classes", rollups.root_classes, "Why nothing calls a function."),
        _of_both("dead_ends", rollups.dead_ends, "Entry points that lead nowhere."),
        _of_both("variable_flow", rollups.variable_flow, "Who reads and writes variables."),
        _of_both("node_degrees", rollups.degrees, "Edges in and out of every node."),
        _of_both("service_view", lambda n, e: rollups.service_view(e, n), "Service pairs."),
        _of_both("cross_links", lambda n, e: rollups.cross_links(e, n), "Edges across services by type."),
        _of_nodes("list_files", rollups.files, "Files with their nodes."),
        _of_nodes("entrypoints_catalog", rollups.entrypoints, "All entry points."),
        _of_nodes("outline_tree", rollups.outline, "Folders of every service."),
        _of_nodes("hierarchy_levels", rollups.hierarchy_levels, "Services, folders and files with their children."),
    )
}

GRAPH_SQL = """
n0 AS (SELECT id, coalesce(type, '') AS type, coalesce(label, '') AS label, coalesce(service, '') AS service, coalesce(file, '') AS file, line, end_line, coalesce(lang, '') AS lang, meta, indexed_at
  FROM (SELECT * FROM nodes UNION ALL SELECT * FROM shared_nodes) WHERE id IS NOT NULL),
n AS (SELECT * FROM n0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC, type DESC, label DESC, service DESC, file DESC, line DESC, coalesce(meta['class'], '') DESC) = 1),
e0 AS (SELECT id, src, dst, coalesce(type, '') AS type, coalesce(label, '') AS label, coalesce(confidence, '') AS confidence, coalesce(http_method, '') AS http_method, coalesce(http_path, '') AS http_path, sources,
  coalesce(verification_state, '') AS verification_state, coalesce(verified_granularity, '') AS verified_granularity, indexed_at FROM edges
  WHERE id IS NOT NULL AND trim(src) <> '' AND trim(dst) <> '' AND src <> 'unresolved' AND dst <> 'unresolved' AND NOT starts_with(src, 'unresolved:') AND NOT starts_with(dst, 'unresolved:')),
e AS (SELECT * FROM e0 QUALIFY row_number() OVER (PARTITION BY id ORDER BY indexed_at DESC, confidence DESC, http_method DESC, verification_state DESC, verified_granularity DESC, sources DESC) = 1)
"""
W = "WITH " + GRAPH_SQL
WR = "WITH RECURSIVE " + GRAPH_SQL
_STRUCT = "('contains', 'declares', 'instantiates', 'uses_type', 'imports')"
_NONRES = "('contains','declares','reads','writes','captures','flows_to','uses_type','inherits','implements','instantiates','imports','defined_in','component_impl','datastar_bind','navigates_to','dom_read','dom_write','dom_create','dom_remove','dom_listen')"
_ENTRY = "('http_handler', 'route', 'worker', 'subscriber', 'grpc_handler', 'graphql_resolver')"
_SIDES = ", x AS (SELECT e.*, a.service AS src_service, a.file AS src_file, b.service AS dst_service, b.file AS dst_file FROM e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst)"
_LIST = "array_to_string(list_sort(list_distinct(list({}))), ',')"


def _walk(seed: str, depth: int, near: str = "src", far: str = "dst", name: str = "walk") -> str:
    """Least depth of what a seed query (root_id, node_id) reaches: levels unrolled by recursion with duplicates removed."""
    return f""", s_{name} AS ({seed}), w_{name} AS (
  SELECT root_id, node_id, 0 AS depth FROM s_{name}
  UNION SELECT w.root_id, e.{far}, w.depth + 1 FROM w_{name} w JOIN e ON e.{near} = w.node_id WHERE w.depth < {depth}),
{name} AS (SELECT root_id, node_id, min(depth) AS depth FROM w_{name} GROUP BY root_id, node_id HAVING min(depth) > 0)"""


_HUB = f"SELECT '{HUB}' AS root_id, '{HUB}' AS node_id"
_BACK = "SELECT arg_max(dst, (k, dst)) AS root_id, arg_max(dst, (k, dst)) AS node_id FROM (SELECT dst, count(*) AS k FROM edges WHERE trim(dst) <> '' AND dst <> 'unresolved' GROUP BY dst)"
_T = """WITH RECURSIVE st AS (SELECT event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events),
t AS (SELECT src || '->' || dst AS id, src, dst FROM st WHERE dst IS NOT NULL GROUP BY src, dst)"""


def _paths(seed: str, depth: int, stop: str = "true") -> str:
    return f""", p AS (
  SELECT [{seed}] AS nodes, '' AS key, 0 AS hops {'FROM (SELECT DISTINCT src FROM t)' if seed == 'src' else ''}
  UNION ALL SELECT list_append(p.nodes, t.dst), p.key || '|' || t.dst, p.hops + 1 FROM p JOIN t ON t.src = p.nodes[-1] WHERE p.hops < {depth} AND NOT list_contains(p.nodes, t.dst) AND {stop})"""


_LEDGER = W + ", lg AS (SELECT n.service, n.file, x.dst AS name, x.type AS kind FROM edges x JOIN n ON n.id = x.src WHERE x.dst = 'unresolved' OR starts_with(x.dst, 'unresolved:'))"


def _pattern_sql() -> str:
    """One branch for each pattern over the lines of its extensions, every match; a label is the group named so, else all groups joined."""
    parts = []
    for rank, p in enumerate(patterns.PACKS):
        if not set(p.exts) & (set(PATTERN_EXTS) | set(CODE_LINES)):
            continue
        regex = p.regex.replace("'", "''")
        groups = ", ".join(f"unnest(regexp_extract_all(line, '{regex}', {i + 1})) AS g{i}" for i in range(len(p.fields)))
        label = f"coalesce(g{p.fields.index('label')}, '')" if "label" in p.fields else "trim(" + " || ' ' || ".join(f"coalesce(g{i}, '')" for i in range(len(p.fields))) + ")"
        exts = ", ".join(f"'{x}'" for x in p.exts)
        parts.append(f"SELECT {rank} AS rank, '{p.lang}' AS lang, '{p.name}' AS pattern, '{p.node_type}' AS type, doc_id, pos, {label} AS label FROM (SELECT doc_id, pos, {groups} FROM l WHERE ext IN ({exts}))")
    return " UNION ALL ".join(parts)


ORACLES = {
    "health_report": _LEDGER + """SELECT 'nodes' AS what, '' AS kind, count(*) AS n FROM n UNION ALL SELECT 'edges', verification_state, count(*) FROM e GROUP BY 2 UNION ALL SELECT 'ledger', kind, count(*) FROM lg GROUP BY 2""",
    "ledger_filter": _LEDGER + "SELECT service, file, count(*) AS n FROM lg WHERE kind = 'calls' AND (contains(lower(name), 'web') OR contains(lower(file), 'web')) GROUP BY 1, 2",
    "file_nodes": W + "SELECT id, file FROM n WHERE file = 'barrel/index.ts' OR file LIKE '%/barrel/index.ts' OR file = 'index.ts'",
    "scanned_files": W + "SELECT service, count(*) AS n FROM (SELECT DISTINCT coalesce(service, '') AS service, path FROM documents) d WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.service = d.service AND n.file = d.path) GROUP BY service",
    "flows_through": _T
    + _paths("src", 3)
    + """SELECT array_to_string(nodes, '>') AS path FROM p WHERE nodes[1] IN ('view', 'signup') AND hops > 0 AND list_contains(nodes, 'purchase')
  AND (hops = 3 OR NOT EXISTS (SELECT 1 FROM t WHERE t.src = p.nodes[-1] AND NOT list_contains(p.nodes, t.dst))) ORDER BY nodes[1], key LIMIT 25""",
    "pattern_nodes": "WITH l AS (SELECT doc_id, ext, unnest(x) AS line, generate_subscripts(x, 1) AS pos FROM (SELECT doc_id, ["
    + ", ".join(f"'{x}'" for x in PATTERN_EXTS)
    + f"][doc_id % {len(PATTERN_EXTS)} + 1] AS ext, regexp_split_to_array(text, '\\r?\\n') AS x FROM documents)), f AS ("
    + _pattern_sql()
    + "), d AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, pos, type, label ORDER BY rank) = 1) SELECT pattern, type, count(*) AS n, count(DISTINCT label) AS n_labels FROM d GROUP BY 1, 2",
    "pattern_sources": W
    + ", c AS (SELECT *, regexp_extract(file, '\\.([^./]+)$', 1) AS ext FROM n WHERE service <> '' AND file LIKE '%.%' AND label <> ''), l AS (SELECT service || '/' || file AS doc_id, ext, "
    + _code_line()
    + " AS line, row_number() OVER (PARTITION BY service, file ORDER BY id) AS pos FROM c), f AS ("
    + _pattern_sql()
    + "), d AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY doc_id, pos, type, label ORDER BY rank) = 1) SELECT lang, pattern, type, count(*) AS n, count(DISTINCT label) AS n_labels, "
    + "count(*) FILTER (regexp_matches(regexp_extract(lower(doc_id), '[^/]*$'), '\\.test\\.|\\.spec\\.|_test\\.go$|_test\\.rb$|_spec\\.rb$|^test_')) AS n_tests FROM d GROUP BY 1, 2, 3",
    "graph_stats": W + "SELECT 'nodes' AS what, count(*) AS n FROM n UNION ALL SELECT 'edges', count(*) FROM e",
    "current_edge_states": W + "SELECT id, src, dst, type, confidence, verification_state FROM e",
    "current_node_rows": W + "SELECT id, type, label, service, file, line FROM n",
    "point_lookup": W + f"SELECT id, type, label, file FROM n WHERE id = '{HUB}'",
    "edge_scan": W + f"SELECT id, type, dst FROM e WHERE src = '{HUB}'",
    "nodes_by_type_ranked": W
    + """SELECT id, label, service FROM n WHERE type = 'function' ORDER BY CASE WHEN regexp_matches(lower(file),
  '_test\\.go$|_test\\.py$|^test_|/test_|_spec\\.rb$|_test\\.rb$|\\.test\\.|\\.spec\\.|^spec/|/spec/|^test/|/test/|^tests/|/tests/|/__tests__/') THEN 1 ELSE 0 END, label, id LIMIT 50""",
    "delete_cascade": W + "SELECT type, count(*) AS n FROM e WHERE src NOT IN (SELECT id FROM n WHERE type = 'element') AND dst NOT IN (SELECT id FROM n WHERE type = 'element') GROUP BY type",
    "graph_page": W + "SELECT id, src, dst FROM e WHERE src IN (SELECT id FROM n ORDER BY id LIMIT 100 OFFSET 200)",
    "ledger_replace": "SELECT DISTINCT src, type, dst FROM edges WHERE dst = 'unresolved' OR starts_with(dst, 'unresolved:')",
    "history_latest_runs": """WITH h AS (SELECT CAST(indexed_at AS DATE) AS run_at, type, count(*) AS n FROM edges GROUP BY 1, 2)
SELECT CAST(run_at AS VARCHAR) AS run_at, type, n FROM h QUALIFY dense_rank() OVER (ORDER BY run_at DESC) <= 5""",
    "audit_page": """WITH c AS (SELECT * FROM tool_calls QUALIFY row_number() OVER (PARTITION BY id ORDER BY received_at DESC, tool DESC, source DESC, status DESC) = 1)
SELECT id FROM c WHERE lower(trim(status)) = 'error' ORDER BY id DESC LIMIT 50 OFFSET 50""",
    "audit_retention": """SELECT id, tool FROM (SELECT DISTINCT id, lower(trim(tool)) AS tool FROM tool_calls) QUALIFY row_number() OVER (PARTITION BY tool ORDER BY id DESC) <= 20""",
    "edge_union": W + "SELECT type, count(DISTINCT id) AS n FROM e WHERE type IN ('calls', 'imports', 'reads') GROUP BY type",
    "descendants_bfs": WR + _walk(_HUB, 3) + f"SELECT node_id, CAST(depth AS BIGINT) AS depth FROM walk WHERE node_id <> '{HUB}'",
    "impact_backward": WR + _walk(_BACK, 4, "dst", "src") + "SELECT node_id, CAST(depth AS BIGINT) AS depth FROM walk WHERE node_id <> root_id",
    "impact_both": WR
    + _walk(_BACK, 2, "dst", "src", "bk")
    + _walk(_BACK, 2, "src", "dst", "fw")
    + """SELECT node_id, 'in' AS direction, CAST(depth AS BIGINT) AS depth FROM bk
UNION ALL SELECT node_id, 'out', CAST(depth AS BIGINT) FROM fw WHERE node_id NOT IN (SELECT node_id FROM bk)""",
    "impact_terminal_policy": WR
    + f""", w AS (SELECT '{HUB}' AS node_id, 0 AS depth, false AS terminal
  UNION SELECT e.dst, w.depth + 1, e.type IN ('contains', 'declares') FROM w JOIN e ON e.src = w.node_id WHERE w.depth < 3 AND NOT w.terminal),
best AS (SELECT node_id, min(depth) AS depth FROM w GROUP BY node_id)
SELECT b.node_id, CAST(b.depth AS BIGINT) AS depth, bool_and(w.terminal) AS terminal FROM best b JOIN w ON w.node_id = b.node_id AND w.depth = b.depth WHERE b.depth > 0 GROUP BY b.node_id, b.depth""",
    "impact_multi_root": WR
    + _walk(f"{_HUB} UNION ALL SELECT '{SPAN_HUB}', '{SPAN_HUB}'", 2)
    + "SELECT node_id, CAST(min(depth) AS BIGINT) AS depth, arg_min(root_id, (depth, root_id)) AS root_id FROM walk GROUP BY node_id",
    "file_impact": WR
    + _walk(_HUB, 2)
    + f"""SELECT n.service, n.file, count(*) AS n_nodes, CAST(min(w.depth) AS BIGINT) AS min_depth FROM walk w JOIN n ON n.id = w.node_id
WHERE n.file <> '' AND (n.service, n.file) NOT IN (SELECT (service, file) FROM n WHERE id = '{HUB}') GROUP BY 1, 2""",
    "entry_points_hit": WR + _walk(_BACK, 4, "dst", "src") + "SELECT node_id FROM walk WHERE node_id NOT IN (SELECT dst FROM e)",
    "related_files": W
    + _SIDES
    + f""", h AS (SELECT service, file FROM n WHERE id = '{HUB}'),
y AS (SELECT id, type, verification_state, dst_service AS service, dst_file AS file FROM x SEMI JOIN h ON x.src_service = h.service AND x.src_file = h.file
  UNION ALL SELECT id, type, verification_state, src_service, src_file FROM x SEMI JOIN h ON x.dst_service = h.service AND x.dst_file = h.file)
SELECT service, file, count(DISTINCT id) AS n_refs, {_LIST.format('type')} AS edge_types,
  list_extract(['verified', 'observed_only_gap', 'candidate', 'conflicting', ''], min(CASE verification_state WHEN 'verified' THEN 1 WHEN 'observed_only_gap' THEN 2 WHEN 'candidate' THEN 3 WHEN 'conflicting' THEN 4 ELSE 5 END)) AS best_state
FROM y WHERE file <> '' AND (service, file) NOT IN (SELECT (service, file) FROM h) GROUP BY service, file""",
    "noise_classes": W
    + f"""SELECT e.type, CASE WHEN e.type = 'inherits' THEN 'mixin' WHEN e.type IN {_STRUCT} THEN 'containment' WHEN d.type = 'element' THEN 'render_tree' ELSE '' END AS noise, count(*) AS n
FROM e LEFT JOIN n d ON d.id = e.dst GROUP BY 1, 2""",
    "test_files": W
    + """SELECT regexp_matches(regexp_extract(lower(file), '[^/]*$'), '\\.test\\.|\\.spec\\.|_test\\.go$|_test\\.rb$|_spec\\.rb$|^test_') OR regexp_matches(lower(file), '/__tests__/|/spec/|^spec/') AS is_test,
  CAST(regexp_matches(lower(file), '_test\\.go$|_test\\.py$|^test_|/test_|_spec\\.rb$|_test\\.rb$|\\.test\\.|\\.spec\\.|^spec/|/spec/|^test/|/test/|^tests/|/tests/|/__tests__/') AS BIGINT) AS penalty, count(*) AS n FROM n GROUP BY 1, 2""",
    "min_verification": W
    + """SELECT type, count(*) AS "any", count(*) FILTER (verification_state IN ('verified', 'observed_only_gap')) AS observed, count(*) FILTER (verification_state = 'verified') AS declared,
  count(*) FILTER (verification_state = 'verified') AS verified FROM e GROUP BY type""",
    "diff_spans": W
    + """, h AS (SELECT service, file, min(line) + 5 AS "start", min(line) + 60 AS "end" FROM n WHERE file <> '' AND line > 0 GROUP BY 1, 2)
SELECT h.service, h.file, h."start", h."end", n.id AS node_id FROM h JOIN n ON n.service = h.service AND n.file = h.file AND n.line > 0 AND n.line <= h."end" AND greatest(n.end_line, n.line) >= h."start\"""",
    "diff_impact": WR
    + """, h AS (SELECT service, file, min(line) + 5 AS a, min(line) + 60 AS b FROM n WHERE service = 'shared-kit' AND file <> '' AND line > 0 GROUP BY 1, 2),
sd AS (SELECT DISTINCT n.id AS node_id FROM h JOIN n ON n.service = h.service AND n.file = h.file AND n.line > 0 AND n.line <= h.b AND greatest(n.end_line, n.line) >= h.a)"""
    + _walk("SELECT 'diff' AS root_id, node_id FROM sd", 2, "dst", "src")
    + "SELECT node_id, CAST(depth AS BIGINT) AS depth FROM walk WHERE node_id NOT IN (SELECT node_id FROM sd)",
    "enclosing_functions": W
    + """SELECT c.id AS call_id, coalesce(arg_max(f.id, (f.line, f.id)), '') AS fn FROM n c LEFT JOIN n f ON f.type = 'function' AND f.service = c.service AND f.file = c.file AND f.line <= c.line
WHERE c.type = 'http_client' AND c.file <> '' GROUP BY c.id""",
    "nearest_below": W
    + """SELECT c.id AS pub_id, CAST(coalesce(min(f.line), -1) AS BIGINT) AS sub_line FROM n c LEFT JOIN n f ON f.type = 'subscriber' AND f.service = c.service AND f.file = c.file AND f.line >= c.line
WHERE c.type = 'publisher' AND c.file <> '' GROUP BY c.id""",
    "k_shortest_paths": _T + _paths("'view'", 4, "p.nodes[-1] <> 'purchase'") + "SELECT array_to_string(nodes, '>') AS path, CAST(hops AS BIGINT) AS hops FROM p WHERE nodes[-1] = 'purchase' ORDER BY hops, key LIMIT 5",
    "chain_enumeration": _T
    + _paths("'view'", 3)
    + """SELECT array_to_string(nodes, '>') AS path FROM p WHERE hops > 0 AND (hops = 3 OR NOT EXISTS (SELECT 1 FROM t WHERE t.src = p.nodes[-1] AND NOT list_contains(p.nodes, t.dst))) ORDER BY key LIMIT 30""",
    "longest_chain": _T
    + _paths("src", 4)
    + "SELECT nodes[1] AS node_id, CAST(hops AS BIGINT) AS hops, array_to_string(nodes, '>') AS path FROM p WHERE hops > 0 QUALIFY row_number() OVER (PARTITION BY nodes[1] ORDER BY hops DESC, key) = 1",
    "flow_walk_rollup": W
    + f""", g AS (SELECT e.src, e.type, b.service, count(*) AS n FROM e JOIN n b ON b.id = e.dst WHERE e.type NOT IN {_NONRES} GROUP BY 1, 2, 3),
h AS (SELECT type, n, CASE WHEN n > 8 THEN 1 ELSE n END AS hops FROM g)
SELECT type, n > 8 AS is_rollup, CAST(sum(hops) AS BIGINT) AS n_hops, CAST(sum(n) AS BIGINT) AS n_edges FROM h GROUP BY 1, 2""",
    "seam": W
    + """, o AS (SELECT type, label FROM e WHERE id = (SELECT min(id) FROM e WHERE label <> '')), c AS (SELECT e.* FROM e JOIN o ON o.type = e.type AND o.label = e.label)
SELECT DISTINCT 'producer' AS side, src AS node_id FROM c UNION SELECT DISTINCT 'consumer', dst FROM c""",
    "link_explorer": WR + _walk(_HUB, 2) + ", k AS (SELECT * FROM walk) SELECT node_id, CAST(depth AS BIGINT) AS depth, (SELECT count(*) FROM k) AS total FROM k ORDER BY depth, node_id LIMIT 50",
    "cross_service_edges": W
    + "SELECT a.service AS src_service, b.service AS dst_service, e.type, count(*) AS n FROM e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst WHERE a.type <> 'service' AND b.type <> 'service' AND a.service <> b.service AND a.service <> '' AND b.service <> '' GROUP BY 1, 2, 3",
    "scope_graph": W
    + """, s AS (SELECT id FROM n WHERE service = 'shared-kit'), m AS (SELECT type, src IN (SELECT id FROM s) AS a, dst IN (SELECT id FROM s) AS b FROM e)
SELECT type, NOT (a AND b) AS stub, count(*) AS n FROM m WHERE a OR b GROUP BY 1, 2""",
    "contract_coverage": W + "SELECT type, count(*) FILTER (confidence <> 'unknown') AS n_matched, count(*) FILTER (confidence = 'unknown') AS n_unresolved FROM e WHERE label <> '' GROUP BY type",
    "verification_summary": W
    + """, r AS (SELECT *, list_filter(sources, lambda s: s.provider = 'runtime') AS rt FROM e)
SELECT type, count(*) FILTER (verification_state = 'verified') AS n_verified, count(*) FILTER (verification_state = 'candidate') AS n_candidate,
  count(*) FILTER (verification_state = 'observed_only_gap') AS n_gap, count(*) FILTER (verification_state = 'conflicting') AS n_conflicting,
  count(*) FILTER (verification_state = 'verified' AND len(rt) > 0 AND list_max(list_transform(rt, lambda s: s.observed_at)) < 1750000000 - 2592000) AS n_stale FROM r GROUP BY type""",
    "file_folding": W
    + """, f AS (SELECT id, CASE WHEN service = 'shared-kit' AND file <> '' THEN service || ':' || file || ':group' ELSE id END AS g FROM n),
m AS (SELECT DISTINCT coalesce(a.g, e.src) AS s, coalesce(b.g, e.dst) AS d, e.type FROM e LEFT JOIN f a ON a.id = e.src LEFT JOIN f b ON b.id = e.dst)
SELECT type, count(*) AS n FROM m WHERE s <> d GROUP BY type""",
    "unparsed_files": W
    + """, x AS (SELECT file, regexp_extract(regexp_extract(file, '[^/]*$'), '\\.([^.]+)$', 1) AS ext FROM n WHERE file <> '')
SELECT count(DISTINCT file) AS n_files, coalesce(array_to_string(list_slice(list_sort(list_distinct(list(ext))), 1, 3), ','), '') AS first_exts FROM x WHERE ext NOT IN ('go', 'ts')""",
    "channel_roles": W
    + """, r AS (SELECT src, count(DISTINCT type) AS k, min(type) AS t FROM e WHERE type IN ('publishes', 'subscribes') GROUP BY src)
SELECT CASE WHEN k = 2 THEN 'both' WHEN t = 'publishes' THEN 'producer' ELSE 'consumer' END AS role, count(*) AS n FROM r GROUP BY 1""",
    "containment_links": W
    + """, h AS (SELECT * FROM n WHERE service <> '' AND file <> '' AND type NOT IN ('service', 'file'))
SELECT 'service' AS src_kind, count(DISTINCT (service, file)) AS n FROM h UNION ALL SELECT 'file', count(*) FROM h
UNION ALL SELECT 'class', count(DISTINCT (c.id, m.id)) FROM n m JOIN n c ON c.type IN ('class', 'struct') AND c.service = m.service AND c.file = m.file AND c.label = regexp_replace(m.meta['class'], '^\\*', '') WHERE m.type = 'method' AND c.label <> '' HAVING count(*) > 0""",
    "datastore_links": W
    + """, s AS (SELECT service, count(*) AS k FROM n WHERE type = 'table' GROUP BY 1), c AS (SELECT service, count(*) AS k FROM n WHERE type = 'http_client' GROUP BY 1)
SELECT CASE WHEN s.k > 1 THEN 'partial' ELSE 'static' END AS confidence, CAST(sum(s.k * c.k) AS BIGINT) AS n FROM s JOIN c ON c.service = s.service GROUP BY 1""",
    "handshake_outcomes": W
    + """, m AS (SELECT p.id, count(DISTINCT c.id) AS k FROM n p LEFT JOIN n c ON c.type = 'subscriber' AND c.label = p.label AND c.service <> p.service WHERE p.type = 'publisher' GROUP BY 1)
SELECT CASE k WHEN 0 THEN 'ledger' WHEN 1 THEN 'resolved' ELSE 'candidates' END AS outcome, count(*) AS n, CAST(sum(k) AS BIGINT) AS n_matches FROM m GROUP BY 1""",
    "convention_links": W
    + """, d AS (SELECT * FROM n WHERE type IN ('function', 'method')), u AS (SELECT label FROM d GROUP BY 1 HAVING count(*) = 1),
h AS (SELECT c.id, d.id AS d_id, CASE WHEN d.service = c.service AND d.file = c.file THEN 0 WHEN d.service = c.service THEN 1 WHEN d.label IN (SELECT label FROM u) THEN 2 END AS scope
  FROM n c JOIN d ON d.label = c.label WHERE c.type = 'publisher'),
b AS (SELECT id, min(scope) AS scope FROM h GROUP BY 1)
SELECT h.scope, count(*) AS n, count(DISTINCT h.id) AS n_calls FROM h JOIN b ON b.id = h.id AND b.scope = h.scope GROUP BY 1""",
    "route_handlers": W
    + """SELECT r.id, min(f.id) AS fn, CAST(1 AS BIGINT) AS rank FROM n r JOIN n f ON f.type IN ('function', 'method') AND f.service = r.service AND f.label = r.label WHERE r.type = 'http_handler' GROUP BY r.id""",
    "shared_channel_keys": W
    + f"SELECT label AS key, count(DISTINCT service) AS n_services, {_LIST.format('service')} AS services FROM n WHERE type = 'http_client' GROUP BY label HAVING count(DISTINCT service) > 1",
    "stack_profile": W
    + """, l AS (SELECT service, arg_min(lang, (-k, lang)) AS language FROM (SELECT service, lang, count(*) AS k FROM n WHERE lang <> '' GROUP BY 1, 2) GROUP BY 1),
o AS (SELECT a.service, count(*) AS k FROM e JOIN n a ON a.id = e.src GROUP BY 1)
SELECT n.service, count(*) AS n_nodes, count(DISTINCT n.file) FILTER (n.file <> '') AS n_files, count(DISTINCT n.type) AS n_types, coalesce(any_value(l.language), '') AS language, coalesce(any_value(o.k), 0) AS n_edges
FROM n LEFT JOIN l ON l.service = n.service LEFT JOIN o ON o.service = n.service GROUP BY n.service""",
    "type_counts": W + "SELECT service, type, count(*) AS n, 'node' AS what FROM n GROUP BY 1, 2 UNION ALL SELECT a.service, e.type, count(*), 'edge' FROM e JOIN n a ON a.id = e.src GROUP BY 1, 2",
    "service_channels": W
    + _SIDES
    + f"""SELECT src_service, dst_service, type, CASE WHEN label <> '' THEN label ELSE dst END AS channel, min(id) AS edge_id,
  list_extract(['observed_only_gap', 'conflicting', 'candidate', 'verified'], min(CASE verification_state WHEN 'observed_only_gap' THEN 1 WHEN 'conflicting' THEN 2 WHEN 'candidate' THEN 3 ELSE 4 END)) AS worst_state,
  count(DISTINCT src) AS n_producers, count(DISTINCT dst) AS n_consumers, count(*) AS n_edges
FROM x WHERE src_service <> dst_service AND src_service <> '' AND dst_service <> '' AND type NOT IN {_STRUCT} GROUP BY 1, 2, 3, 4""",
    "root_classes": W
    + """SELECT id, label, CASE WHEN label IN ('main', 'init', '(module)') THEN 'entrypoint' WHEN id IN (SELECT dst FROM e WHERE type IN ('reads', 'uses_type', 'imports')) THEN 'callback' ELSE 'unreachable' END AS root_kind
FROM n WHERE type IN ('function', 'method') AND id NOT IN (SELECT dst FROM e WHERE type <> 'contains')""",
    "dead_ends": W + f"SELECT id AS node_id, type AS kind FROM n WHERE type IN {_ENTRY} AND id NOT IN (SELECT src FROM e WHERE type NOT IN ('contains', 'declares'))",
    "variable_flow": W
    + """, r AS (SELECT dst AS id, type, src AS o FROM e WHERE type IN ('reads', 'writes', 'captures') UNION ALL SELECT src, type, dst FROM e WHERE type = 'flows_to')
SELECT id, count(DISTINCT o) FILTER (type = 'reads') AS n_readers, count(DISTINCT o) FILTER (type = 'writes') AS n_writers, count(DISTINCT o) FILTER (type = 'captures') AS n_captors, count(DISTINCT o) FILTER (type = 'flows_to') AS n_targets
FROM r WHERE id IN (SELECT id FROM n WHERE type = 'variable') GROUP BY id""",
    "node_degrees": W
    + """, i AS (SELECT dst AS id, count(*) AS k FROM e GROUP BY 1), o AS (SELECT src AS id, count(*) AS k FROM e GROUP BY 1)
SELECT n.id, coalesce(i.k, 0) AS n_in, coalesce(o.k, 0) AS n_out FROM n LEFT JOIN i ON i.id = n.id LEFT JOIN o ON o.id = n.id""",
    "service_view": W
    + _SIDES
    + f"""SELECT least(src_service, dst_service) AS service_a, greatest(src_service, dst_service) AS service_b, count(*) AS n_edges, {_LIST.format('type')} AS types,
  count(*) FILTER (src_service < dst_service) AS n_forward, count(*) FILTER (src_service > dst_service) AS n_backward FROM x WHERE src_service <> dst_service AND src_service <> '' AND dst_service <> '' GROUP BY 1, 2""",
    "cross_links": W + _SIDES + "SELECT type, count(*) AS total, count(*) FILTER (src_service <> dst_service) AS across FROM x GROUP BY type",
    "list_files": W + f"SELECT service, file, count(*) AS n_nodes, {_LIST.format('type')} AS types FROM n WHERE file <> '' GROUP BY 1, 2",
    "entrypoints_catalog": W + f"SELECT id AS node_id, type AS kind, label, service, file, line FROM n WHERE type IN {_ENTRY}",
    "outline_tree": W
    + """, p AS (SELECT service, file, id, string_split(file, '/') AS parts FROM n WHERE contains(file, '/')), q AS (SELECT *, unnest(range(1, len(parts))) AS depth FROM p)
SELECT service, array_to_string(parts[1:depth], '/') AS folder, depth, count(DISTINCT file) AS n_files, count(*) AS n_nodes FROM q GROUP BY 1, 2, 3""",
    "hierarchy_levels": W
    + """, h AS (SELECT service, file, id, CASE WHEN contains(file, '/') THEN regexp_replace(file, '/[^/]*$', '') ELSE '' END AS folder FROM n WHERE file <> '')
SELECT service, service AS name, count(DISTINCT folder) AS n_children, 'service' AS level FROM h GROUP BY 1, 2
UNION ALL SELECT service, folder, count(DISTINCT file), 'folder' FROM h GROUP BY 1, 2 UNION ALL SELECT service, file, count(DISTINCT id), 'file' FROM h GROUP BY 1, 2""",
    "similar_documents": """WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS id, lower(trim(source)) AS source, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) AS items FROM documents),
l AS (SELECT * FROM d WHERE source = 'docs' AND len(items) >= 2), r AS (SELECT * FROM d WHERE source <> 'docs' AND len(items) >= 2),
p AS (SELECT l.id, l.items, count(*) AS n_links FROM l JOIN r ON len(r.items) BETWEEN len(l.items) * 0.79 AND len(l.items) * 1.26
  WHERE len(list_intersect(l.items, r.items)) >= 2 AND len(list_intersect(l.items, r.items)) / (len(l.items) + len(r.items) - len(list_intersect(l.items, r.items))) >= 0.8 - 1e-12 GROUP BY 1, 2)
SELECT id, sha256(array_to_string(list_sort(items), chr(1))) AS class, n_links FROM p""",
    "similar_documents_all": """WITH d AS (SELECT row_number() OVER () AS k, CAST(doc_id AS VARCHAR) AS id, coalesce(lower(trim(source)), '') AS source,
  coalesce(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')), []) AS items FROM documents),
p AS (SELECT a.k, count(*) AS n_links, count(*) FILTER (a.source = b.source) AS n_own FROM d a JOIN d b ON a.k <> b.k AND len(a.items) >= 2 AND len(b.items) BETWEEN len(a.items) * 0.79 AND len(a.items) * 1.26
  WHERE len(list_intersect(a.items, b.items)) >= 2 AND len(list_intersect(a.items, b.items)) / (len(a.items) + len(b.items) - len(list_intersect(a.items, b.items))) >= 0.8 - 1e-12 GROUP BY 1)
SELECT id, source, sha256(array_to_string(list_sort(items), chr(1))) AS class, coalesce(n_links, 0) AS n_links, coalesce(n_own, 0) AS n_own FROM d LEFT JOIN p USING (k)""",
}
