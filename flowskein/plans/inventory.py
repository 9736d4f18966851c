"""Queries of the operators that no other query runs, with their oracle SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowskein import model
from flowskein.functions import normalize as N
from flowskein.functions import predicates as P
from flowskein.functions import scalars as S
from flowskein.operators import answers, contracts, evaluation, evidence, graph_store, linking, rollups, search
from flowskein.operators import spans as SP
from flowskein.operators import traversal as T
from flowskein.plans import analysis, dealt
from flowskein.plans.graph import HUB, W, both, edges, http_calls, nodes
from flowskein.session import materialize, shared_dir, table
from flowskein.sources import files as sources
from flowskein.streaming import spans as streaming

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# ---- contract rules ---------------------------------------------------------------------------------------------------


def _ends(spark, sf_dir, ids: str, **fields: str) -> DataFrame:
    """Nodes with a new id prefix and type, and meta fields by SQL."""
    pairs = ", ".join(f"'{k}', {v}" for k, v in fields.items() if k != "type")
    kind = fields["type"]
    return nodes(spark, sf_dir).filter("service <> ''").selectExpr(f"concat('{ids}:', id) AS id", f"'{kind}' AS type", "label", "service", "file", "line", "lang", f"map({pairs}) AS meta", "type AS __of")


def _http_nodes(spark, sf_dir) -> DataFrame:
    """Clients by the method and path of their call, handlers by its label; every third client does not tell its method."""
    n, calls = nodes(spark, sf_dir), http_calls(spark, sf_dir)
    method = F.expr("CASE WHEN line % 3 = 0 THEN '' ELSE lower(http_method) END")
    place = n.filter("service <> ''").select("id", "service", "file", "line", "lang")

    def side(end: str, kind: str, prefix: str, m: Column, p: Column) -> DataFrame:
        rows = calls.join(place.withColumnRenamed("id", end), end).select(F.col(end).alias("of"), "service", "file", "line", "lang", m.alias("m"), p.alias("p")).distinct()
        return rows.select(
            F.concat(F.lit(prefix), F.concat_ws("|", "of", "m", "p")).alias("id"), F.lit(kind).alias("type"), F.lit("").alias("label"), "service", "file", "line", "lang",
            F.create_map(F.lit("method"), F.col("m"), F.lit("path"), F.col("p")).alias("meta"),
        )

    handler = side("dst", "http_handler", "h:", F.substring_index("label", " ", 1), F.substring_index("label", " ", -1))
    return side("src", "http_client", "c:", method, F.col("http_path")).unionByName(handler)


_HTTP = replace(contracts.RULES[0], tiers=("exact", "normalized"))
_TEST = "(regexp_matches(regexp_extract(lower(file), '[^/]*$'), '\\.test\\.|\\.spec\\.|_test\\.go$|_test\\.rb$|_spec\\.rb$|^test_') OR contains(lower(file), '/__tests__/') OR contains(lower(file), '/spec/') OR starts_with(lower(file), 'spec/'))"


def _wild(path: str) -> str:
    stars = f"regexp_replace(regexp_replace(string_split(lower({path}), '?')[1], ':[^/]+', '*', 'g'), '\\{{[^}}]+\\}}', '*', 'g')"
    cut = f"CASE WHEN {stars} = '' THEN '' WHEN regexp_replace({stars}, '/+$', '') = '' THEN '/' ELSE regexp_replace({stars}, '/+$', '') END"
    return f"regexp_replace({cut}, '^/*\\*(/+\\*)*/*$', '')"


_HTTP_ENDS = (
    W
    + f""", calls AS (SELECT * FROM e WHERE type = 'http_call' AND http_path <> '' AND contains(label, ' ')),
pl AS (SELECT id, service, file, line, lang FROM n WHERE service <> ''),
pr AS (SELECT DISTINCT src AS of_, service, file, line, lang, CASE WHEN line % 3 = 0 THEN '' ELSE lower(http_method) END AS m, http_path AS p FROM calls JOIN pl ON pl.id = src),
cr AS (SELECT DISTINCT dst AS of_, service, file, line, lang, string_split(label, ' ')[1] AS m, string_split(label, ' ')[-1] AS p FROM calls JOIN pl ON pl.id = dst),
p0 AS (SELECT 'c:' || concat_ws('|', of_, m, p) AS id, service, file, line, m || ' ' || p AS raw, lower(m) AS head, {_wild("p")} AS tail, '' AS ceiling, 0 AS cand,
  lang IN ('javascript', 'typescript', 'vue', 'svelte', 'html') AND starts_with(p, '/') AND NOT starts_with(p, '//') AS local FROM pr WHERE NOT {_TEST}),
p AS (SELECT * FROM p0 WHERE tail <> '' QUALIFY row_number() OVER (PARTITION BY service, file, line, raw ORDER BY id) = 1),
c0 AS (SELECT 'h:' || concat_ws('|', of_, m, p) AS id, service, m || ' ' || p AS raw, lower(m) || ' ' || {_wild("p")} AS norm, {_wild("p")} AS tail, lower(m) AS head FROM cr WHERE NOT {_TEST}),
c AS (SELECT * FROM c0 WHERE tail <> '')"""
)


def _linked(policy: str = "true", methods: bool = True, prefix: str = "link", exchange: bool = False) -> str:
    """Hits of the equality tiers over ``p`` and ``c``, the first tier that hits, own origin, fan-out guard, edges."""
    tries = "CASE WHEN head = '' THEN ['get', 'post', 'put', 'patch', 'delete', ''] ELSE [head] END" if methods else "[head]"
    norm = "tm || ' ' || tail" if methods else "norm"
    shown = "norm"
    open_ = "regexp_replace({}, '[*#. ]', '', 'g') = ''"
    third = f" UNION ALL SELECT k.*, c.id AS c_id, c.service AS cs, 3 AS t FROM k JOIN c ON k.head = c.head AND ({open_.format('k.tail')} OR {open_.format('c.tail')})" if exchange else ""
    return f"""
, tr AS (SELECT p.*, unnest({tries}) AS tm, generate_subscripts({tries}, 1) - 1 AS try FROM p),
k AS (SELECT * EXCLUDE (raw{'' if methods else ', norm'}), CASE WHEN try = 0 THEN raw ELSE {norm} END AS raw, {norm} AS norm FROM tr),
h0 AS (SELECT k.*, c.id AS c_id, c.service AS cs, 0 AS t FROM k JOIN c ON k.raw = c.raw UNION ALL SELECT k.*, c.id AS c_id, c.service AS cs, 1 AS t FROM k JOIN c ON k.norm = c.norm{third}),
h AS (SELECT * FROM h0 WHERE id <> c_id AND {policy}),
b AS (SELECT id, cand, min((try, t)) AS b FROM h GROUP BY id, cand),
w0 AS (SELECT h.* FROM h JOIN b ON b.id = h.id AND b.cand = h.cand AND h.try = b.b[1] AND h.t = b.b[2]),
ow AS (SELECT DISTINCT id, cand FROM w0 WHERE local AND cs = service),
w AS (SELECT w0.* FROM w0 LEFT JOIN ow ON ow.id = w0.id AND ow.cand = w0.cand WHERE ow.id IS NULL OR w0.cs = w0.service),
f AS (SELECT id, cand, count(DISTINCT cs) AS fan FROM w GROUP BY id, cand),
ed AS (SELECT DISTINCT '{prefix}:' || w.id || '->' || w.c_id AS id, CASE WHEN fan > 1 OR t = 3 OR ceiling = 'partial' THEN 'partial' WHEN t = 0 AND ceiling = '' AND w.cand = 0 THEN 'static' ELSE 'inferred' END AS confidence,
  CASE t WHEN 0 THEN 'exact' WHEN 1 THEN 'normalized' ELSE 'exchange_only' END AS tier, {shown} AS label FROM w JOIN f ON f.id = w.id AND f.cand = w.cand
  WHERE NOT (fan > 1 AND contains(tail, '*') AND len(list_filter(string_split(tail, '/'), lambda s: s <> '' AND NOT contains(s, '*') AND NOT ends_with(s, ':'))) = 1))
"""


@query(_HTTP_ENDS + _linked() + "SELECT id, confidence, tier, label FROM ed")
def contract_methods(spark, sf_dir):
    """Clients to handlers by equality: methods tried in turn, own origin first, weak paths over several services dropped."""
    return contracts.link(_http_nodes(spark, sf_dir), _HTTP).edges.select("id", "confidence", "tier", "label")


@query(_HTTP_ENDS + _linked() + "SELECT p.id, p.service, p.file, p.raw AS name FROM p WHERE (p.id, p.cand) NOT IN (SELECT (id, cand) FROM w)")
def contract_unmatched(spark, sf_dir):
    """Clients that no handler answers."""
    return contracts.link(_http_nodes(spark, sf_dir), _HTTP).unmatched.select("id", "service", "file", "name")


@query(_HTTP_ENDS + _linked() + "SELECT 'link:' || p.id || '->unresolved' AS id, 'unresolved' AS dst, 'unknown' AS confidence FROM p WHERE (p.id, p.cand) NOT IN (SELECT (id, cand) FROM w)")
def contract_unknown_edges(spark, sf_dir):
    """Edges of unanswered clients to the unresolved node."""
    lost = contracts.link(_http_nodes(spark, sf_dir), _HTTP).unmatched
    return contracts.unknown_edges(lost, _HTTP).select("id", "dst", "confidence")


@query(_HTTP_ENDS + _linked("service = cs") + "SELECT id, confidence, tier FROM ed")
def contract_same_service(spark, sf_dir):
    """As contract_methods, within services only."""
    return contracts.link(_http_nodes(spark, sf_dir), replace(_HTTP, same_service="same_service_only")).edges.select("id", "confidence", "tier")


@query(_HTTP_ENDS + _linked("service <> cs") + "SELECT id, confidence, tier FROM ed")
def contract_other_services(spark, sf_dir):
    """As contract_methods, between services only."""
    return contracts.link(_http_nodes(spark, sf_dir), replace(_HTTP, same_service="skip")).edges.select("id", "confidence", "tier")


@query(_HTTP_ENDS.replace("p0 AS (SELECT", "p0 AS (SELECT CASE WHEN line % 4 = 0 THEN service WHEN line % 4 = 1 THEN 'shared-kit' ELSE '' END AS target,") + _linked("(target = '' OR cs = target)") + "SELECT id, confidence, tier FROM ed")
def contract_targets(spark, sf_dir):
    """As contract_methods, where half of the clients tell the service they ask."""
    n = _http_nodes(spark, sf_dir)
    told = F.expr("CASE WHEN line % 4 = 0 THEN service WHEN line % 4 = 1 THEN 'shared-kit' ELSE '' END")
    return contracts.link(n.withColumn("meta", F.map_concat("meta", F.create_map(F.lit("target_service"), told))), _HTTP).edges.select("id", "confidence", "tier")


@query("""SELECT DISTINCT repo, repo || '/' || lower(trim(case_id)) AS case_id, coalesce(max(exhaustive), false) AS exhaustive, CAST(2 AS BIGINT) AS n_expected, CAST(1 AS BIGINT) AS n_must FROM eval_baseline WHERE case_id IS NOT NULL AND repo IS NOT NULL GROUP BY repo, lower(trim(case_id))""")
def manifest_cases(spark, sf_dir):
    """Cases read from a manifest for each repository."""
    cases = table(spark, sf_dir, "eval_baseline").filter("case_id IS NOT NULL AND repo IS NOT NULL").groupBy("repo", F.lower(F.trim("case_id")).alias("c")).agg(F.coalesce(F.max("exhaustive"), F.lit(False)).alias("x"))
    one = F.concat(F.lit("  - id: '"), "repo", F.lit("/"), "c", F.lit("'\n    kind: node\n    exhaustive: "), F.col("x").cast("string"), F.lit("\n    expected_impacted: [a/b.go, '"), "c", F.lit("']\n    must_not_miss:\n      - a/b.go\n"))
    made = cases.groupBy("repo").agg(F.concat(F.lit("cases:\n"), F.array_join(F.collect_list(one), "")).alias("text"))
    read = evaluation.manifest_cases(made)
    return read.select("repo", "case_id", "exhaustive", F.size("expected").cast("bigint").alias("n_expected"), F.size("must").cast("bigint").alias("n_must"))


@query(W + """SELECT 'out' AS direction, e.type, e.dst AS other, coalesce(n.label, '') AS label, coalesce(n.service, '') AS service FROM e LEFT JOIN n ON n.id = e.dst WHERE e.src = '""" + HUB + """' UNION ALL SELECT 'in', e.type, e.src, coalesce(n.label, ''), coalesce(n.service, '') FROM e LEFT JOIN n ON n.id = e.src WHERE e.dst = '""" + HUB + """'""")
def node_neighbours(spark, sf_dir):
    """Edges of the hub in both directions with the nodes at their other ends."""
    return rollups.neighbours(*both(spark, sf_dir), HUB).select("direction", "type", "other", P.given(F.col("label")).alias("label"), P.given(F.col("service")).alias("service"))


@query(W + """, k AS (SELECT id FROM n WHERE type IN ('class', 'function') AND service LIKE '%-web-%') SELECT 'node' AS what, count(*) AS n FROM k UNION ALL SELECT 'edge', count(*) FROM e WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k) AND type <> 'contains' AND verification_state <> 'conflicting'""")
def filtered_view(spark, sf_dir):
    """Nodes and edges that pass the filters of a view."""
    n, e = both(spark, sf_dir)
    services = [r[0] for r in n.filter("service LIKE '%-web-%'").select("service").distinct().collect()]  # what a user ticked
    kept = sorted(r[0] for r in e.select("verification_state").distinct().collect() if r[0] != "conflicting")
    types = sorted(r[0] for r in e.select("type").distinct().collect() if r[0] != "contains")
    shown, left = rollups.filtered(n, e, ["class", "function"], services, types, kept)
    return shown.agg(F.count("*").alias("n")).select(F.lit("node").alias("what"), "n").unionByName(left.agg(F.count("*").alias("n")).select(F.lit("edge").alias("what"), "n"))


@query(W + """SELECT service, count(*) AS n_lines, CAST(sum(length(id)) AS BIGINT) AS n_chars FROM n WHERE service <> '' GROUP BY 1""")
def source_tree(spark, sf_dir):
    """Files of a tree on disk, read whole: one folder for each service, a line for each node."""
    root = f"{shared_dir(spark)}/tree-{uuid.uuid4().hex}"
    nodes(spark, sf_dir).filter("service <> ''").select("service", "id").write.partitionBy("service").text(root)
    read = sources.texts(spark, root, "*.txt").select(F.regexp_extract("path", "service=([^/]+)/", 1).alias("service"), F.explode(F.split("text", "\n")).alias("line")).filter("line <> ''")
    assert sources.tree(spark, root, "*.txt").filter("content_hash IS NULL OR ext <> 'txt'").count() == 0
    return read.groupBy("service").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


def _broker_nodes(spark, sf_dir) -> DataFrame:
    """Channels as ends of a broker: exchange by language, routing key by label, every tenth one open; publishers produce, subscribers consume."""
    made = _ends(spark, sf_dir, "q", type="channel", exchange="lang", routing_key="CASE WHEN line % 10 = 0 THEN '#' ELSE lower(label) END", role="CASE WHEN type = 'subscriber' THEN 'consumer' ELSE '' END")
    return made.filter("__of IN ('publisher', 'subscriber')")


_BROKER_ENDS = (
    W
    + f""", q AS (SELECT 'q:' || id AS id, type, service, file, line, lang AS head, CASE WHEN line % 10 = 0 THEN '#' ELSE lower(label) END AS rk FROM n WHERE service <> '' AND type IN ('publisher', 'subscriber') AND NOT {_TEST}),
q2 AS (SELECT id, type, service, file, line, head, CASE WHEN rk = '#' THEN '*' ELSE rk END AS tail, head || ' ' || rk AS raw, head || ' ' || CASE WHEN rk = '#' THEN '*' ELSE rk END AS norm, '' AS ceiling, 0 AS cand, false AS local FROM q),
p AS (SELECT * FROM q2 WHERE type = 'publisher' QUALIFY row_number() OVER (PARTITION BY service, file, line, raw ORDER BY id) = 1), c AS (SELECT * FROM q2 WHERE type = 'subscriber')"""
)


@query(_BROKER_ENDS + _linked("service <> cs", False, "broker", True) + "SELECT id, confidence, tier FROM ed")
def contract_exchanges(spark, sf_dir):
    """Publishers to subscribers of a broker: by key, else by the exchange alone where a side is open."""
    return contracts.link(_broker_nodes(spark, sf_dir), contracts.RULES[2]).edges.select("id", "confidence", "tier")


def _candidate_nodes(spark, sf_dir) -> DataFrame:
    """Publishers that may call one of two operations, subscribers that resolve one."""
    ops = "concat('[\"', label, '\",\"', lower(label), '\"]')"
    p = _ends(spark, sf_dir, "g", type="graphql_client", operation="''", key_candidates=ops).filter("__of = 'publisher'")
    return p.unionByName(_ends(spark, sf_dir, "g", type="graphql_resolver", operation="CASE WHEN line % 2 = 0 THEN label ELSE lower(label) END").filter("__of = 'subscriber'"))


_CANDIDATES = (
    W
    + f""", g AS (SELECT 'g:' || id AS id, type, service, file, line, label FROM n WHERE service <> '' AND type IN ('publisher', 'subscriber') AND NOT {_TEST}),
p0 AS (SELECT id, service, file, line, unnest([label, lower(label)]) AS raw, unnest([1, 2]) AS cand FROM g WHERE type = 'publisher'),
p AS (SELECT *, raw AS norm, raw AS head, raw AS tail, '' AS ceiling, false AS local FROM p0 WHERE raw <> '' QUALIFY row_number() OVER (PARTITION BY service, file, line, raw ORDER BY id, cand) = 1),
c0 AS (SELECT id, service, CASE WHEN line % 2 = 0 THEN label ELSE lower(label) END AS raw FROM g WHERE type = 'subscriber'), c AS (SELECT *, raw AS norm FROM c0 WHERE raw <> '')"""
)


@query(_CANDIDATES + _linked("service <> cs", False, "graphql") + "SELECT DISTINCT id, confidence, tier FROM ed")
def contract_candidates(spark, sf_dir):
    """Callers of several possible operations, each matched by itself."""
    return contracts.link(_candidate_nodes(spark, sf_dir), contracts.RULES[3]).edges.select("id", "confidence", "tier").distinct()


@query(
    W
    + """, v AS (SELECT id, service, file, line, label AS raw, '/' || lower(label) AS tail, CASE WHEN line % 2 = 0 THEN 'partial' ELSE '' END AS ceiling, CASE WHEN line % 5 = 0 THEN 'w' ELSE '' END AS wrapper, 0 AS cand FROM n WHERE type = 'http_client'
  UNION ALL SELECT id || '#2', service, file, line, label, '/' || lower(label) || '/*', '', '', 0 FROM n WHERE type = 'http_client')
SELECT id FROM v QUALIFY row_number() OVER (PARTITION BY service, file, line, raw ORDER BY -(CASE WHEN contains(tail, '*') THEN 0 ELSE 4 END + CASE WHEN ceiling = '' THEN 2 ELSE 0 END + CASE WHEN wrapper = '' THEN 1 ELSE 0 END), id) = 1"""
)
def contract_deduped(spark, sf_dir):
    """Of two readings of one call the one with most evidence."""
    n = nodes(spark, sf_dir).filter("type = 'http_client'")
    one = n.selectExpr("id", "service", "file", "line", "label AS raw", "concat('/', lower(label)) AS tail", "CASE WHEN line % 2 = 0 THEN 'partial' ELSE '' END AS ceiling", "CASE WHEN line % 5 = 0 THEN 'w' ELSE '' END AS wrapper", "0 AS cand")
    two = n.selectExpr("concat(id, '#2') AS id", "service", "file", "line", "label AS raw", "concat('/', lower(label), '/*') AS tail", "'' AS ceiling", "'' AS wrapper", "0 AS cand")
    return contracts.deduped(one.unionByName(two)).select("id")


# ---- linking ----------------------------------------------------------------------------------------------------------


def _sql_text(spark, sf_dir) -> DataFrame:
    text = """concat(CASE line % 4 WHEN 0 THEN 'SELECT a, b FROM ' WHEN 1 THEN 'insert into ' WHEN 2 THEN '  UPDATE ' ELSE 'DELETE FROM ' END, CASE WHEN line % 3 = 0 THEN '"' ELSE '' END, label, CASE WHEN line % 3 = 0 THEN '"' ELSE '' END,
      ' WHERE x = 1; SELECT 1 FROM other')"""
    return nodes(spark, sf_dir).filter("type = 'table'").select("id", "service", F.expr(text).alias("sql"))


@query(W + """SELECT 'table:' || id || '->' || service || ':table:' || lower(label) AS id, service || ':table:' || lower(label) AS dst, CASE WHEN line % 4 = 0 THEN 'queries' ELSE 'persists' END AS type FROM n WHERE type = 'table'""")
def table_links(spark, sf_dir):
    """Tables that SQL texts name, as reads or writes."""
    return linking.tables_of_queries(_sql_text(spark, sf_dir)).select("id", "dst", "type")


@query(W + """, l AS (SELECT DISTINCT 'http://' || service || '.test' AS b, service AS t FROM n WHERE service <> '' UNION SELECT DISTINCT 'http://' || service || '.test/' || type, service || '/' || type FROM n WHERE service <> '')
SELECT n.id, coalesce((SELECT arg_max(t, length(b)) FROM l WHERE starts_with('http://' || n.service || '.test/' || n.type || '/x', b)), '') AS target_service FROM n""")
def hinted_targets(spark, sf_dir):
    """Target of each node's URL by the longest base URL that begins it."""
    n = nodes(spark, sf_dir)
    named = n.filter("service <> ''")
    links = named.selectExpr("concat('http://', service, '.test') AS base_url", "service AS target").unionByName(named.selectExpr("concat('http://', service, '.test/', type) AS base_url", "concat(service, '/', type) AS target")).distinct()
    return linking.hinted(n.selectExpr("id", "concat('http://', service, '.test/', type, '/x') AS url"), links).select("id", "target_service")


@query(W + """, c AS (SELECT id, service, upper(type) AS var, '/' || label AS path FROM n WHERE service <> ''), v AS (SELECT DISTINCT service, upper(type) AS var, '/' || lang AS base FROM n WHERE service <> ''),
a AS (SELECT service, var, min(base) AS base FROM v GROUP BY 1, 2 HAVING count(DISTINCT base) = 1)
SELECT c.id, CASE WHEN coalesce(a.base, '/') = '/' THEN CASE WHEN a.base = '/' THEN c.path ELSE c.path END ELSE a.base || c.path END AS path FROM c LEFT JOIN a ON a.service = c.service AND a.var = c.var""")
def base_url_paths(spark, sf_dir):
    """Paths of clients behind the path of their base URL, where all values of the variable agree."""
    n = nodes(spark, sf_dir).filter("service <> ''")
    values = n.selectExpr("service", "upper(type) AS var", "concat('http://host/', lang, CASE WHEN line % 2 = 0 THEN '/' ELSE '' END) AS value").distinct()
    return answers.base_paths(n.selectExpr("id", "service", "upper(type) AS var", "concat('/', label) AS path"), values)


@query(W + """, v AS (SELECT DISTINCT service, upper(label) AS var, lang AS value FROM n WHERE type = 'variable')
SELECT r.id, coalesce(v.value, '') AS value, CASE WHEN v.value IS NULL THEN 'config_not_found' ELSE '' END AS problem FROM n r LEFT JOIN v ON v.service = r.service AND v.var = upper(r.label) WHERE r.type IN ('function', 'variable')""")
def configured_references(spark, sf_dir):
    """References to configuration with every value, or the miss."""
    n = nodes(spark, sf_dir)
    values = n.filter("type = 'variable'").selectExpr("service", "upper(label) AS var", "lang AS value")
    refs = n.filter("type IN ('function', 'variable')").selectExpr("id", "service", "upper(label) AS var")
    return answers.configured(refs, values).select("id", P.given(F.col("value")).alias("value"), "problem")


@query(
    W.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, pa AS (SELECT DISTINCT src AS class, dst AS parent FROM e WHERE type = 'inherits'), me AS (SELECT id AS class, 'm' AS name, id AS method_id FROM n WHERE line % 3 = 0),
ca AS (SELECT DISTINCT class AS id, class, 'm' AS name FROM pa),
up AS (SELECT class, class AS owner, 0 AS d FROM (SELECT DISTINCT class FROM ca) UNION SELECT u.class, p.parent, u.d + 1 FROM up u JOIN pa p ON p.class = u.owner WHERE u.d < 60),
r AS (SELECT class, owner, min(d) AS d FROM up GROUP BY 1, 2),
f AS (SELECT ca.id, me.method_id, r.d FROM ca JOIN r ON r.class = ca.class JOIN me ON me.class = r.owner AND me.name = ca.name), m AS (SELECT id, min(d) AS d FROM f GROUP BY 1)
SELECT DISTINCT f.id, f.method_id, f.d AS depth FROM f JOIN m ON m.id = f.id AND m.d = f.d"""
)
def inherited_definitions(spark, sf_dir):
    """The nearest of what a class inherits from, however far up, that defines a method: every third does."""
    n, e = both(spark, sf_dir)
    methods = n.filter("line % 3 = 0").selectExpr("id AS class", "'m' AS name", "id AS method_id")
    calls = e.filter("type = 'inherits'").selectExpr("src AS id", "src AS class", "'m' AS name").distinct()
    found = answers.inherited(calls, e.filter("type = 'inherits'").selectExpr("src AS class", "dst AS parent").distinct(), methods)
    return found.select("id", "method_id", F.col("depth").cast("bigint").alias("depth")).distinct()


@query(W + """SELECT DISTINCT file, CASE WHEN lang = 'typescript' THEN 'next-pages' ELSE 'remix' END AS dialect, '/' || regexp_replace(regexp_replace(regexp_extract(file, '([^/]*)$'), '\\.[^./]+$', ''), CASE WHEN lang = 'typescript' THEN '^index$' ELSE '^$' END, '') AS route
FROM (SELECT CASE WHEN lang = 'typescript' THEN 'web/pages/' ELSE 'app/routes/' END || regexp_replace(regexp_extract(file, '([^/]*)$'), '\\.[^./]+$', '.ts') AS file, lang FROM n WHERE file <> '' AND lang IN ('typescript', 'python'))""")
def file_routes(spark, sf_dir):
    """Routes that the files' places imply."""
    n = nodes(spark, sf_dir).filter("file <> '' AND lang IN ('typescript', 'python')")
    made = n.select(F.expr("concat(CASE WHEN lang = 'typescript' THEN 'web/pages/' ELSE 'app/routes/' END, regexp_replace(substring_index(file, '/', -1), '\\\\.[^./]+$', '.ts'))").alias("file")).distinct()
    return linking.file_routes(made)


@query(
    W.replace("WITH ", "WITH RECURSIVE ", 1)
    + """, g AS (SELECT dst AS id, min(src) AS parent FROM e WHERE type = 'contains' GROUP BY 1), a AS (SELECT id, parent FROM g UNION ALL SELECT DISTINCT parent, '' FROM g WHERE parent NOT IN (SELECT id FROM g)),
w AS (SELECT id, '/' || length(id) AS p, 0 AS d FROM a WHERE parent = '' UNION ALL SELECT a.id, w.p || '/' || length(a.id), w.d + 1 FROM w JOIN a ON a.parent = w.id)
SELECT a.id, coalesce(w.p, '-') AS prefix, coalesce(w.d, -1) AS depth FROM a LEFT JOIN w ON w.id = a.id"""
)
def group_prefixes(spark, sf_dir):
    """Prefixes composed along containment, of any depth; what hangs on a cycle has none."""
    e = edges(spark, sf_dir)
    g = e.filter("type = 'contains'").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent_id"))
    roots = g.select(F.col("parent_id").alias("id")).distinct().join(g.select("id"), "id", "left_anti").withColumn("parent_id", F.lit(""))
    rows = linking.group_prefixes(g.unionByName(roots).withColumn("prefix", F.concat(F.lit("/"), F.length("id").cast("string"))))
    return rows.select("id", F.coalesce("full", F.lit("-")).alias("prefix"), F.col("depth").cast("bigint").alias("depth"))


@query(W + """SELECT 'dom:' || a.id || '->' || b.id AS id FROM n a JOIN n b ON b.service = a.service AND b.type = 'element' AND b.lang = a.lang AND lower(b.label[:4]) = lower(a.label[:4]) WHERE a.type = 'component'""")
def dom_links(spark, sf_dir):
    """Selectors in components to elements of their service."""
    n = nodes(spark, sf_dir)
    side = lambda kind: n.filter(F.col("type") == kind).selectExpr("id", "service", "lang AS attr", "lower(substr(label, 1, 4)) AS value")
    return linking.dom_contracts(side("component"), side("element")).select("id")


@query(W + """SELECT l.id FROM n l WHERE l.type = 'function' AND (l.service, l.file, l.line, l.label) NOT IN (SELECT (service, file, line, label) FROM n WHERE type = 'method')""")
def ledger_cleared(spark, sf_dir):
    """Ledger rows that no provider claims: functions as references, methods as claims."""
    row = lambda kind: nodes(spark, sf_dir).filter(F.col("type") == kind).select("id", "service", "file", "line", F.col("label").alias("name"))
    return evidence.cleared(row("function"), row("method")).select("id")


@query(W + """, p AS (SELECT id, service, lang || lower(label) AS field FROM n WHERE type = 'publisher'), c AS (SELECT id, service, lang || lower(label) AS field FROM n WHERE type = 'subscriber'),
h AS (SELECT p.id, count(DISTINCT c.id) FILTER (c.service <> p.service) AS k FROM p LEFT JOIN c ON c.field = p.field GROUP BY 1)
SELECT id, k AS n_matches, CASE WHEN k = 0 THEN 'ledger' WHEN k = 1 THEN 'resolved' ELSE 'candidates' END AS outcome FROM h""")
def handshakes_by_field(spark, sf_dir):
    """Publishers and the subscribers of other services that share their field."""
    side = lambda kind: nodes(spark, sf_dir).filter(F.col("type") == kind).selectExpr("id", "service", "concat(lang, lower(label)) AS field")
    return linking.handshakes(side("publisher"), side("subscriber"))


# ---- predicates and scalars -------------------------------------------------------------------------------------------


@query(W + """, x AS (SELECT id, ['render_tree'] AS gen FROM n LIMIT 0)
SELECT e.type, CASE WHEN v = 'f' THEN 'filter_chain' WHEN e.type = 'inherits' THEN 'mixin' WHEN e.type IN ('contains', 'declares', 'instantiates', 'uses_type', 'imports') THEN 'containment' WHEN n.type = 'element' THEN 'render_tree' ELSE '' END AS noise, count(*) AS n
FROM (SELECT *, CASE WHEN length(id) % 7 = 0 THEN 'f' ELSE '' END AS v FROM e) e LEFT JOIN n ON n.id = e.dst GROUP BY 1, 2""")
def noise_with_filters(spark, sf_dir):
    """Noise classes where every seventh edge comes from a middleware."""
    n, e = both(spark, sf_dir)
    joined = e.join(n.select(F.col("id").alias("dst"), F.col("type").alias("dst_type")), "dst", "left")
    via = F.when(F.length("id") % 7 == 0, model.FILTER_VIAS[1]).otherwise("")
    return joined.groupBy("type", P.noise_class(F.col("type"), via, F.col("dst_type")).alias("noise")).agg(F.count("*").alias("n"))


@query(W + """, x AS (SELECT e.type, CASE WHEN e.type = 'inherits' THEN 'mixin' WHEN e.type IN ('contains', 'declares', 'instantiates', 'uses_type', 'imports') THEN 'containment' WHEN n.type = 'element' THEN 'render_tree' ELSE '' END AS c FROM e LEFT JOIN n ON n.id = e.dst)
SELECT m AS mode, count(*) FILTER (c = '' OR list_contains(k, c)) AS n_shown FROM x, (VALUES ('default', []), ('generate', ['render_tree']), ('all', ['filter_chain', 'mixin', 'containment', 'render_tree']), ('mixin', ['mixin']), ('none', [])) v(m, k) GROUP BY m""")
def noise_included(spark, sf_dir):
    """Edges shown by each choice of noise classes."""
    n, e = both(spark, sf_dir)
    noise = P.noise_class(F.col("type"), F.lit(""), F.col("dst_type"))
    rows = e.join(n.select(F.col("id").alias("dst"), F.col("type").alias("dst_type")), "dst", "left").select(noise.alias("noise"))
    modes = {"default": P.noise_included([]), "generate": P.noise_included([], "generate"), "all": P.noise_included(["all"]), "mixin": P.noise_included(["mixin"]), "none": P.noise_included(["none"])}
    counts = rows.agg(*(F.count_if(F.col("noise").isin("", *kept)).alias(mode) for mode, kept in modes.items()))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(m).alias("mode"), F.col(m).alias("n_shown")) for m in modes))).alias("r")).select("r.*")


@query(W + """SELECT CASE WHEN type IN ('class', 'struct', 'function', 'method', 'component', 'variable') THEN type ELSE 'other' END AS kind, count(*) AS n FROM n GROUP BY 1""")
def tree_kinds(spark, sf_dir):
    """Nodes by their kind in an outline."""
    return nodes(spark, sf_dir).groupBy(P.tree_kind(F.col("type")).alias("kind")).agg(F.count("*").alias("n"))


@query(W + """SELECT service, count(*) FILTER (file = 'src' OR starts_with(file, 'src/')) AS n_src, count(*) FILTER (file = 'app' OR starts_with(file, 'app/')) AS n_app FROM n GROUP BY 1""")
def nodes_under_paths(spark, sf_dir):
    """Nodes of every service below two folders."""
    return nodes(spark, sf_dir).groupBy("service").agg(F.count_if(P.under_path(F.col("file"), "src")).alias("n_src"), F.count_if(P.under_path(F.col("file"), "app")).alias("n_app"))


@query(W + """SELECT n.lang, starts_with(e.http_path, '/') AND NOT starts_with(e.http_path, '//') AS relative, n.lang IN ('javascript', 'typescript', 'vue', 'svelte', 'html') AS browser, count(*) AS n FROM e JOIN n ON n.id = e.src WHERE e.type = 'http_call' GROUP BY 1, 2, 3""")
def browser_calls(spark, sf_dir):
    """Calls by whether a browser makes them and whether their URL is relative."""
    n, e = both(spark, sf_dir)
    calls = e.filter("type = 'http_call'").join(n.select(F.col("id").alias("src"), "lang"), "src")
    return calls.groupBy("lang", P.is_relative_url(F.col("http_path")).alias("relative"), P.is_browser_executed(F.col("lang"), F.lit("")).alias("browser")).agg(F.count("*").alias("n"))


@query(W + """, x AS (SELECT http_path AS p, list_filter(string_split(http_path, '/'), lambda s: s <> '' AND NOT contains(s, '*') AND NOT ends_with(s, ':')) AS l FROM e WHERE http_path <> '')
SELECT CASE WHEN len(l) = 0 THEN 'none' WHEN len(l) >= 2 OR NOT contains(p, '*') THEN 'strong' ELSE 'weak' END AS evidence, count(*) AS n FROM x GROUP BY 1""")
def path_evidence(spark, sf_dir):
    """How much the paths of calls say."""
    return edges(spark, sf_dir).filter("http_path <> ''").groupBy(P.path_evidence(F.col("http_path")).alias("evidence")).agg(F.count("*").alias("n"))


_CONF = "CASE confidence WHEN 'static' THEN 3 WHEN 'inferred' THEN 2 WHEN 'partial' THEN 1 ELSE 0 END"


@query(W + f"SELECT type, {_CONF} AS rank, count(*) AS n FROM e GROUP BY 1, 2")
def confidence_ranks(spark, sf_dir):
    return edges(spark, sf_dir).groupBy("type", P.confidence_rank(F.col("confidence")).cast("bigint").alias("rank")).agg(F.count("*").alias("n"))


@query(W + """SELECT id, CASE WHEN line % 3 = 0 THEN label ELSE '"' || label || '''' END AS unquoted, CASE WHEN service <> '' AND starts_with('/' || service || '/' || label, '/' || service) THEN '/' || label ELSE '/' || service || '/' || label END AS stripped,
  CASE WHEN line % 2 = 0 THEN 'a.*.b' ELSE 'a#b.*' END AS topic, CASE WHEN line % 2 = 0 THEN '' ELSE '/' || label || '/*' END AS anchored FROM n""")
def key_normalizers(spark, sf_dir):
    """Quotes, base URLs, topic wildcards and keys without anchor, by name from the registry."""
    use = lambda name, key, env=N.Env(): N.NORMALIZERS[name](key, env)
    quoted = F.when(F.col("line") % 3 == 0, F.concat(F.lit("`"), "label", F.lit("`"))).otherwise(F.concat(F.lit('"'), "label", F.lit("'")))
    topic = F.when(F.col("line") % 2 == 0, "a.#.b").otherwise("a#b.#")
    lone = F.when(F.col("line") % 2 == 0, "/*/*/").otherwise(F.concat(F.lit("/"), "label", F.lit("/*")))
    base = N.Env(F.when(F.col("service") != "", F.concat(F.lit("/"), "service")))
    return nodes(spark, sf_dir).select(
        "id", use("quote_strip", quoted).alias("unquoted"), use("base_url_strip", F.concat_ws("/", F.lit(""), "service", "label"), base).alias("stripped"),
        use("amqp_topic_wildcard", topic).alias("topic"), use("shared_anchor_guard", lone).alias("anchored"),
    )


@query("""SELECT doc_id, array_to_string(list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda t: t <> ''), ' ') AS tokens FROM documents""")
def search_tokens(spark, sf_dir):
    """Search tokens of every chunk."""
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(S.search_tokens(P.given(F.col("text"))), " ").alias("tokens"))


@query("""WITH w AS (SELECT doc_id, coalesce(lower(trim(source)), '') AS q FROM documents)
SELECT doc_id, CASE WHEN list_contains(string_split_regex(q, '\\s+'), 'docs') AND list_contains(string_split_regex(q, '\\s+'), 'runbooks') THEN q || ' manual handbook guide'
  WHEN list_contains(string_split_regex(q, '\\s+'), 'docs') THEN q || ' manual handbook' WHEN list_contains(string_split_regex(q, '\\s+'), 'runbooks') THEN q || ' guide' ELSE q END AS expanded FROM w""")
def expanded_queries(spark, sf_dir):
    """Sources as queries, with the synonyms of their words."""
    q = F.coalesce(F.lower(F.trim("source")), F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", search.expanded(q, {"docs": ["manual", "handbook"], "runbooks": ["guide"]}).alias("expanded"))


@query("""SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 4) AS norm, CAST(1 AS DOUBLE) AS unit, round(CAST(embedding[1] AS DOUBLE) / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 3) + 0.0 AS first,
  round(CAST(label AS DOUBLE) / 7, 3) AS score FROM embeddings""")
def unit_vectors(spark, sf_dir):
    """Vectors of unit length, and rounded scores."""
    v = table(spark, sf_dir, "embeddings").withColumn("u", S.l2_normalized(F.col("embedding")))
    length = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return v.select("vec_id", F.round(length("embedding"), 4).alias("norm"), F.round(length("u"), 4).alias("unit"), (F.round(F.get("u", F.lit(0)), 3) + 0.0).alias("first"), S.rounded_score(F.col("label") / F.lit(7.0)).alias("score"))


@query(W + """SELECT 'n' AS type, id AS entity_id, concat_ws(' ', nullif(label, ''), nullif(type, ''), nullif(service, ''), nullif(file, '')) AS card FROM n""")
def node_cards(spark, sf_dir):
    """Search texts of nodes, without extra fields."""
    n = nodes(spark, sf_dir).withColumn("meta", F.expr("cast(map() AS map<string,string>)"))
    return answers.node_cards(n).select(F.lit("n").alias("type"), "entity_id", F.col("text").alias("card"))


@query(W + """SELECT id, lower(label) AS table_name, CASE WHEN line % 3 = 0 THEN '' ELSE lower(label) END AS json_name, CASE WHEN line % 6 = 5 THEN '' ELSE upper(type) || '_KEY' END AS env_var, CASE WHEN line % 2 = 0 THEN lower(type) ELSE '' END AS hint FROM n WHERE label <> '' AND type <> 'service'""")
def code_extractions(spark, sf_dir):
    """Tables in SQL, names in struct tags, variables read from the environment, services that variables point to."""
    n = nodes(spark, sf_dir).filter("label <> '' AND type <> 'service'")
    sql = F.concat(F.lit("  \"select x from `"), "label", F.lit("` join y\""))
    tag = F.when(F.col("line") % 3 == 0, 'json:"-"').otherwise(F.concat(F.lit('db:"z" json:"'), F.lower("label"), F.lit(',omitempty"')))
    var = F.concat(F.upper("type"), F.lit("_KEY"))
    forms = ["os.Getenv(\"{}\")", "process.env.{}", "ENV.fetch('{}')", "os.environ[\"{}\"]", "ENV['{}']", "print({})"]
    code = F.coalesce(*(F.when(F.col("line") % 6 == i, F.concat(F.lit(f.split("{}")[0]), var, F.lit(f.split("{}")[1]))) for i, f in enumerate(forms)))
    hint = F.when(F.col("line") % 2 == 0, F.concat(F.upper("type"), F.lit("_SERVICE_URL"))).otherwise(F.upper("type"))
    return n.select("id", S.sql_table(sql).alias("table_name"), S.json_tag_name(tag).alias("json_name"), S.env_var_name(code).alias("env_var"), S.service_hint(hint).alias("hint"))


@query(W + """SELECT id, CASE WHEN type IN ('publishes', 'kafka_publish') THEN trim('ex ' || src) WHEN label <> '' THEN label ELSE trim(http_method || ' ' || http_path) END AS channel FROM e""")
def channel_labels(spark, sf_dir):
    """Labels of channels: broker names, else the label, else method and path."""
    broker = F.col("type").isin("publishes", "kafka_publish")
    label = S.channel_label(F.when(broker, "ex"), F.when(broker, F.col("src")), F.col("label"), F.col("http_method"), F.col("http_path"))
    return edges(spark, sf_dir).select("id", label.alias("channel"))


@query("""SELECT doc_id, array_to_string(string_split(coalesce(text, ''), chr(10))[2:4], chr(10)) AS snippet FROM documents""")
def snippets(spark, sf_dir):
    """Lines two to four of every chunk."""
    return table(spark, sf_dir, "documents").select("doc_id", S.snippet(P.given(F.col("text")), F.lit(2), 3).alias("snippet"))


@query("""WITH c AS (SELECT DISTINCT id, error, status FROM tool_calls) SELECT CASE WHEN lower(coalesce(error, '')) = '' THEN '' WHEN regexp_matches(lower(error), 'quota|rate.?limit|429|credit') THEN 'quota'
  WHEN regexp_matches(lower(error), 'timeout|timed out|unavailable|502|503|504|reset|temporar|overloaded|locked') THEN 'transient' ELSE 'fatal' END AS class, count(*) AS n FROM c GROUP BY 1""")
def failure_classes(spark, sf_dir):
    """Failed calls by the kind of failure."""
    calls = table(spark, sf_dir, "tool_calls").select("id", "error", "status").distinct()
    return calls.groupBy(S.failure_class(F.col("error")).alias("class")).agg(F.count("*").alias("n"))


@query("""SELECT DISTINCT repo, case_id, trim(regexp_replace(lower(repo || ' ' || case_id), '[^a-z0-9]+', '-', 'g'), '-') AS slug, trim(regexp_replace(regexp_replace(lower('`' || case_id || '`  is'), '[`''"]', '', 'g'), '\\s+', ' ', 'g')) AS fact FROM eval_baseline""")
def case_slugs(spark, sf_dir):
    """Slugs and normal facts of eval cases."""
    cases = table(spark, sf_dir, "eval_baseline").select("repo", "case_id").distinct()
    return cases.select("repo", "case_id", S.slug(F.concat_ws(" ", "repo", "case_id")).alias("slug"), S.normal_fact(F.concat(F.lit("`"), "case_id", F.lit("`  is"))).alias("fact"))


# ---- sources and sinks ------------------------------------------------------------------------------------------------

_Q3 = "chr(39)"


@query(W + """, v AS (SELECT service, type, count(*) AS k, row_number() OVER (PARTITION BY service ORDER BY type) AS r FROM n WHERE service <> '' GROUP BY 1, 2)
SELECT service || '/.env' AS path, CAST(r + 1 AS INT) AS line, 'N_' || upper(type) AS var, CAST(k AS VARCHAR) AS value FROM v""")
def config_values(spark, sf_dir):
    """Variables of a settings file for each service: a comment, then one line for each type."""
    counts = nodes(spark, sf_dir).filter("service <> ''").groupBy("service", "type").agg(F.count("*").alias("k"))
    line = F.when(F.col("k") % 2 == 0, F.concat(F.lit("export N_"), F.upper("type"), F.lit('="'), "k", F.lit('" # note'))).otherwise(F.concat(F.lit("  N_"), F.upper("type"), F.lit(" = "), "k"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("type", line.alias("l")))), lambda x: x["l"]), "\n")
    made = counts.groupBy(F.concat("service", F.lit("/.env")).alias("path")).agg(F.concat(F.lit("# settings\n"), text).alias("text"))
    return sources.config_values(made)


@query(W + """SELECT service || ':' || file AS diff_id, file, line AS "start", line + 2 AS "end", false AS deleted FROM n WHERE service <> '' AND file <> '' AND line > 0""")
def diff_hunks(spark, sf_dir):
    """Changed spans of one diff for each file, with a hunk of three lines at each of its nodes."""
    n = nodes(spark, sf_dir).filter("service <> '' AND file <> '' AND line > 0")
    hunk = F.concat(F.lit("@@ -"), "line", F.lit(",1 +"), "line", F.lit(",3 @@ f\n-a\n+b\n+c\n d\n"))
    text = F.concat(F.lit("diff --git a/"), "file", F.lit(" b/"), "file", F.lit("\n--- a/"), "file", F.lit("\n+++ b/"), "file", F.lit("\n"), F.array_join(F.collect_list(hunk), ""))
    return sources.diff_hunks(n.groupBy("service", "file").agg(text.alias("text")).select(F.concat_ws(":", "service", "file").alias("diff_id"), "text"))


@query(W + """, c AS (SELECT DISTINCT e.type, n.service, e.label FROM e JOIN n ON n.id = e.dst WHERE e.type = 'http_call' AND n.service <> '' AND contains(e.label, ' '))
SELECT service || '.json' AS path, 'http' AS kind, string_split(label, ' ')[1] || ' /v1' || string_split(label, ' ')[-1] AS key, '' AS problem FROM c
UNION ALL SELECT service || '.proto', 'grpc', 'pkg.' || upper(type) || '/' || label, '' FROM (SELECT DISTINCT service, type, label FROM n WHERE type = 'subscriber' AND service <> '' AND label <> '')
UNION ALL SELECT service || '.graphql', 'graphql', label, '' FROM (SELECT DISTINCT service, label FROM n WHERE type = 'publisher' AND service <> '' AND label <> '')
UNION ALL SELECT service || '.bad.json', '', '', 'ValueError: neither OpenAPI nor AsyncAPI' FROM (SELECT DISTINCT service FROM n WHERE service <> '')""")
def spec_channels(spark, sf_dir):
    """Operations of an OpenAPI, a protobuf and a GraphQL file for each service, and of a file that is none."""
    n, e = both(spark, sf_dir)
    calls = e.filter("type = 'http_call' AND label LIKE '% %'").join(n.filter("service <> ''").select(F.col("id").alias("dst"), "service"), "dst")
    paths = calls.select("service", F.substring_index("label", " ", -1).alias("p"), F.substring_index("label", " ", 1).alias("m")).distinct()
    by_path = paths.groupBy("service", "p").agg(F.map_from_entries(F.collect_list(F.struct("m", F.create_map(F.lit("x"), F.lit("y"))))).alias("ops"))
    spec = by_path.groupBy("service").agg(F.to_json(F.struct(F.lit("3.0").alias("openapi"), F.lit("/v1/").alias("basePath"), F.map_from_entries(F.collect_list(F.struct("p", "ops"))).alias("paths"))).alias("text"))
    named = n.filter("service <> '' AND label <> ''")
    joined = lambda pattern: F.array_join(F.collect_list(pattern), "\n")
    rpc = named.filter("type = 'subscriber'").select("service", "label").distinct().groupBy("service").agg(
        F.concat(F.lit('syntax = "proto3";\npackage pkg;\nservice SUBSCRIBER {\n'), joined(F.concat(F.lit("  rpc "), "label", F.lit(" (A) returns (B);"))), F.lit("\n}\n")).alias("text")
    )
    gql = named.filter("type = 'publisher'").select("service", "label").distinct().groupBy("service").agg(F.concat(F.lit("type Query {\n"), joined(F.concat(F.lit("  "), "label", F.lit("(a: Int): B"))), F.lit("\n}\n")).alias("text"))
    bad = n.filter("service <> ''").select("service").distinct().withColumn("text", F.lit('{"a": 1}'))
    made = None
    for df, ext in ((spec, ".json"), (rpc, ".proto"), (gql, ".graphql"), (bad, ".bad.json")):
        part = df.select(F.concat("service", F.lit(ext)).alias("path"), "text")
        made = part if made is None else made.unionByName(part)
    return sources.spec_channels(made)


@query("""WITH c AS (SELECT DISTINCT id, duration_ms, result_bytes, lower(trim(tool)) AS tool FROM tool_calls) SELECT CAST(id AS VARCHAR) AS task_id, duration_ms, result_bytes AS output_tokens, 'docs/' || tool || '.md,src/a/' || tool || '.go' AS files FROM c""")
def transcripts(spark, sf_dir):
    """Usage and named files of a transcript for each call."""
    calls = table(spark, sf_dir, "tool_calls").select("id", "duration_ms", "result_bytes", F.lower(F.trim("tool")).alias("tool")).distinct()
    said = F.concat(F.lit("see src/a/"), "tool", F.lit(".go and docs/"), "tool", F.lit(".md, again src/a/"), "tool", F.lit(".go"))
    body = F.to_json(F.struct(said.alias("result"), "duration_ms", F.struct(F.col("result_bytes").alias("output_tokens")).alias("usage")))
    read = sources.transcripts(calls.select(F.col("id").cast("string").alias("task_id"), body.alias("text")))
    return read.select("task_id", "duration_ms", "output_tokens", F.array_join("files", ",").alias("files"))


@query(W + """SELECT 'nodes' AS part, '{"data":' || to_json({'id': id, 'label': label, 'type': type, 'service': service}) || '}' AS element FROM n UNION ALL SELECT 'edges', '{"data":' || to_json({'id': id, 'source': src, 'target': dst, 'type': type}) || '}' FROM e""")
def ui_elements(spark, sf_dir):
    """Nodes and edges as elements of the UI."""
    return sources.cytoscape(*both(spark, sf_dir))


def _lines(spark, text: str) -> DataFrame:
    return spark.createDataFrame([(i + 1, line) for i, line in enumerate(text.split("\n"))], "line int, text string")


_PAIRS = """, pa AS (SELECT a.service AS s, b.service AS d, count(*) AS k FROM e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst WHERE a.service <> b.service AND a.service <> '' AND b.service <> '' AND a.type <> 'service' AND b.type <> 'service' GROUP BY 1, 2),
sv AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS i FROM (SELECT s FROM pa UNION SELECT d FROM pa)),
li AS (SELECT 0 AS o, '' AS o1, '' AS o2, 'graph LR' AS t UNION ALL SELECT 1, lpad(CAST(i AS VARCHAR), 9, '0'), '', '  n' || i || '["' || s || '"]' FROM sv
  UNION ALL SELECT 2, pa.s, pa.d, '  n' || a.i || ' -->|' || k || '| n' || b.i FROM pa JOIN sv a ON a.s = pa.s JOIN sv b ON b.s = pa.d UNION ALL SELECT 3, '', '', '')"""


@query(W + _PAIRS + " SELECT CAST(row_number() OVER (ORDER BY o, o1, o2) AS INT) AS line, t AS text FROM li")
def service_diagram(spark, sf_dir):
    """The services and the edges between them as a diagram."""
    n, e = both(spark, sf_dir)
    pairs = T.cross_service(e, n).groupBy(F.col("src_service").alias("src"), F.col("dst_service").alias("dst")).agg(F.count("*").cast("string").alias("label"))
    return _lines(spark, sources.mermaid(pairs, most=100_000))


@query(W + """, f AS (SELECT service, file, count(*) AS k, row_number() OVER (ORDER BY least(count(*), 3), file, service) AS r, count(*) OVER () AS t FROM n WHERE file <> '' GROUP BY 1, 2),
l AS (SELECT r, '| ' || file || ' | ' || service || ' | ' || k || ' | ' || least(k, 3) || ' |' AS s, t FROM f),
b AS (SELECT *, sum(strlen(s) + 1) OVER (ORDER BY r) AS used FROM l)
SELECT CAST(r AS INT) AS line, s AS text FROM b WHERE used + strlen('### Impact: ' || t || ' files') + 2 + strlen('| file | service | nodes | depth |') + 1 + strlen('|---|---|---|---|') + 1 + 40 <= 20000""")
def comment_lines(spark, sf_dir):
    """Rows of a review comment over all files, as many whole lines as 20,000 bytes hold."""
    n = nodes(spark, sf_dir).filter("file <> ''").groupBy("service", "file").agg(F.count("*").alias("n_nodes"))
    text = sources.review_comment(n.withColumn("min_depth", F.least("n_nodes", F.lit(3))), 20_000)
    shown = [x for x in text.split("\n")[4:] if x.startswith("|")]
    return spark.createDataFrame([(i + 1, x) for i, x in enumerate(shown)], "line int, text string")


@query("SELECT session, count(*) AS n_exports, count(DISTINCT export_id) AS n_distinct, CAST(min(received_at) AS VARCHAR) AS first_at FROM otlp_exports GROUP BY session")
def session_listing(spark, sf_dir):
    """Capture sessions with their exports."""
    rows = table(spark, sf_dir, "otlp_exports").groupBy("session").agg(F.count("*").alias("n_exports"), F.countDistinct("export_id").alias("n_distinct"), F.min("received_at").alias("f"))
    return rows.select("session", "n_exports", "n_distinct", F.regexp_replace(F.col("f").cast("string"), r"\.0+$", "").alias("first_at"))


@query("SELECT lower(trim(tool)) AS key, arg_max(status, (received_at, id, status)) AS value FROM tool_calls WHERE trim(tool) <> '' GROUP BY 1")
def kv_meta(spark, sf_dir):
    """Key-value table: the last value set for each key, here the last status of each tool."""
    rows = table(spark, sf_dir, "tool_calls").select(F.lower(F.trim("tool")).alias("key"), F.col("status").alias("value"), "received_at", "id").filter("key <> ''")
    return graph_store.latest(rows, ["key"], ["received_at", "id", "value"]).select("key", "value")


@query("SELECT CAST(vec_id AS VARCHAR) AS entity_id, round(CASE WHEN vec_id % 2 = 0 THEN -1 ELSE 1 END * CAST(embedding[1] AS DOUBLE), 4) AS first, len(embedding) AS dims, CASE WHEN vec_id % 2 = 0 THEN 'b' ELSE 'a' END AS embedder FROM embeddings")
def embedding_sink(spark, sf_dir):
    """Vectors written, half of them written again by another embedder: what is stored."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("entity_id"), F.col("embedding").alias("vector"), F.lit("a").alias("embedder"), F.lit(1).alias("version"))
    again = v.filter("cast(entity_id AS bigint) % 2 = 0").select("entity_id", F.transform("vector", lambda x: -x).alias("vector"), F.lit("b").alias("embedder"), F.lit(2).alias("version"))
    stored, _ = materialize(graph_store.latest(v.unionByName(again), ["entity_id"], ["version"]), "vectors")
    return stored.select("entity_id", F.round(F.get("vector", F.lit(0)).cast("double"), 4).alias("first"), F.size("vector").cast("bigint").alias("dims"), "embedder")


@query("SELECT 2 AS n_embedders, false AS consistent")
def embedder_conflicts(spark, sf_dir):
    """More than one embedder behind the stored vectors is found."""
    stored = table(spark, sf_dir, "embeddings").select(F.when(F.col("vec_id") % 2 == 0, "b").otherwise("a").alias("embedder"))
    return search.embedder_conflict(stored)


@query("SELECT count(DISTINCT path) FILTER (indexed_at > TIMESTAMP '2025-04-01') AS n_changed, true AS same, true AS differs FROM documents WHERE path IS NOT NULL")
def freshness_and_fingerprints(spark, sf_dir):
    """Files changed since an index run; the fingerprint is that of the rows in any order, and another once one is gone."""
    docs = table(spark, sf_dir, "documents").filter("path IS NOT NULL").groupBy("path").agg(F.max("indexed_at").alias("modificationTime"), F.max(F.sha2(P.given(F.col("text")), 256)).alias("content_hash"))
    changed = sources.changed_since(docs, F.lit("2025-04-01").cast("timestamp"))
    prints = [sources.fingerprint(d).withColumn("__i", F.lit(1)) for d in (docs, docs.orderBy(F.desc("path")), docs.filter(F.col("path") != docs.agg(F.min("path")).first()[0]))]
    a, b, c = (p.withColumnRenamed("fingerprint", f"f{i}") for i, p in enumerate(prints))
    return changed.withColumn("__i", F.lit(1)).join(a, "__i").join(b, "__i").join(c, "__i").selectExpr("n_changed", "f0 = f1 AS same", "f0 <> f2 AS differs")


# ---- answers ----------------------------------------------------------------------------------------------------------

_TASKS = ("impact", "generate", "")


@query(
    W
    + f""", d AS (SELECT dst AS x, 1 AS k FROM e WHERE src = '{HUB}' AND dst <> '{HUB}'), o AS (SELECT DISTINCT x, 1 AS k FROM d UNION SELECT DISTINCT e.dst, 2 FROM d JOIN e ON e.src = d.x WHERE e.dst <> '{HUB}'),
i1 AS (SELECT DISTINCT src AS x FROM e WHERE dst = '{HUB}' AND src <> '{HUB}'), i AS (SELECT x, 1 AS k FROM i1 UNION SELECT DISTINCT e.src, 2 FROM i1 JOIN e ON e.dst = i1.x WHERE e.src <> '{HUB}'),
om AS (SELECT x, min(k) AS k FROM o GROUP BY x), im AS (SELECT x, min(k) AS k FROM i GROUP BY x),
r AS (SELECT 'impact' AS task, x, k, 'in' AS dir FROM im UNION ALL SELECT 'generate', x, k, 'out' FROM om UNION ALL SELECT 'both', x, k, 'in' FROM im UNION ALL SELECT 'both', x, k, 'out' FROM om WHERE x NOT IN (SELECT x FROM im))
SELECT r.task, r.x AS node_id, r.k AS depth, r.dir AS direction, coalesce(n.label, '') AS label, coalesce(n.service, '') AS service FROM r LEFT JOIN n ON n.id = r.x"""
)
def context_neighbourhoods(spark, sf_dir):
    """The hub's neighbourhood by task: up for impact, down for generate, else both."""
    n, e = both(spark, sf_dir)
    out = None
    for task in _TASKS:
        part = answers.context(n, e, HUB, task).select(F.lit(task or "both").alias("task"), "node_id", F.col("depth").cast("bigint").alias("depth"), "direction", P.given(F.col("label")).alias("label"), P.given(F.col("service")).alias("service"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    W
    + f""", d AS (SELECT dst AS x, 1 AS k FROM e WHERE src = '{HUB}' UNION SELECT e2.dst, 2 FROM e JOIN e e2 ON e2.src = e.dst WHERE e.src = '{HUB}'), m AS (SELECT x, min(k) AS k FROM d WHERE x <> '{HUB}' GROUP BY x)
SELECT n.service, n.type, count(*) AS n_nodes, CAST(min(m.k) AS BIGINT) AS min_depth FROM m JOIN n ON n.id = m.x GROUP BY 1, 2"""
)
def context_summary(spark, sf_dir):
    """Context of the hub rolled up by service and type."""
    rows = answers.context(*both(spark, sf_dir), HUB, "generate")
    return rows.filter("type IS NOT NULL").groupBy("service", "type").agg(F.count("*").alias("n_nodes"), F.min("depth").cast("bigint").alias("min_depth"))


@query(
    W
    + f""", t AS (SELECT id FROM n WHERE lower(label) = 'sundry' ORDER BY id LIMIT 3),
c AS (SELECT e.dst AS id, e.src AS other, 'caller' AS role FROM e JOIN t ON t.id = e.dst WHERE e.type = 'calls' UNION ALL SELECT e.src, e.dst, 'callee' FROM e JOIN t ON t.id = e.src WHERE e.type = 'calls')
SELECT id, other, role FROM c QUALIFY row_number() OVER (PARTITION BY id, role ORDER BY other) <= 4"""
)
def hook_contexts(spark, sf_dir):
    """A few callers and callees of the nodes of a name."""
    return answers.symbol_context(*both(spark, sf_dir), "Sundry").select("id", "other", "role")


@query(W + """SELECT 'nodes' AS "check", count(*) AS n, count(*) = 0 AS is_problem FROM n UNION ALL SELECT 'edges', count(*), count(*) = 0 FROM e
UNION ALL SELECT 'cross_service_edges', count(*), count(*) = 0 FROM e JOIN n a ON a.id = e.src JOIN n b ON b.id = e.dst WHERE a.service <> b.service
UNION ALL SELECT 'ledger', count(*), count(*) > 0 FROM edges WHERE dst = 'unresolved' OR starts_with(dst, 'unresolved:')
UNION ALL SELECT 'services_without_entrypoint', count(DISTINCT service), count(DISTINCT service) > 0 FROM n WHERE service <> '' AND service NOT IN (SELECT service FROM n WHERE type IN ('http_handler', 'route', 'worker', 'subscriber', 'grpc_handler', 'graphql_resolver'))""")
def onboarding_checks(spark, sf_dir):
    """What a first look at the graph should find."""
    ledger = table(spark, sf_dir, "edges").filter("dst = 'unresolved' OR startswith(dst, 'unresolved:')")
    return answers.doctor(*both(spark, sf_dir), ledger)


def _walks(name: str, seed: str, depth: int) -> str:
    """Simple paths over rolled-up flow edges by recursion: node and edge lists, keys of each hop."""
    return f""", kn AS (SELECT e.*, n.service AS ds FROM e JOIN n ON n.id = e.dst WHERE {_FLOW}), sz AS (SELECT src, type, ds, count(*) AS k, min(dst) AS ld, min(id) AS li FROM kn GROUP BY 1, 2, 3),
fe AS (SELECT kn.id, kn.src, kn.dst, kn.type FROM kn JOIN sz ON sz.src = kn.src AND sz.type = kn.type AND sz.ds = kn.ds WHERE sz.k <= 8 UNION ALL SELECT 'rollup:' || li, src, 'rollup:' || type || ':' || ds, type FROM sz WHERE k > 8),
{name} AS (SELECT [s] AS ns, CAST([] AS VARCHAR[]) AS es, CAST([] AS VARCHAR[]) AS ks, s AS last FROM ({seed})
  UNION ALL SELECT list_append(w.ns, fe.dst), list_append(w.es, fe.id), list_append(w.ks, fe.type || chr(1) || fe.dst || chr(1) || fe.id), fe.dst FROM {name} w JOIN fe ON fe.src = w.last WHERE len(w.es) < {depth} AND NOT list_contains(w.ns, fe.dst)),
lf AS (SELECT * FROM {name} w WHERE len(es) = {depth} OR NOT EXISTS (SELECT 1 FROM fe WHERE fe.src = w.last AND NOT list_contains(w.ns, fe.dst)))"""


_WRC = "WITH RECURSIVE " + W[len("WITH ") :]
_FLOW = "e.type NOT IN ('contains', 'declares', 'imports', 'reads', 'writes', 'uses_type')"
#: Where chains begin: the hub, and all nodes that spawn something.
_START = f"SELECT '{HUB}' AS s UNION SELECT src FROM e WHERE type = 'spawns'"


def _path_edges(spark, sf_dir) -> DataFrame:
    """Flow edges, what fans out to many nodes of one kind and service rolled up to one hop: the hubs stay in."""
    n, e = both(spark, sf_dir)
    return materialize(T.rolled_up(e.filter("type NOT IN ('contains', 'declares', 'imports', 'reads', 'writes', 'uses_type')"), n), "path-edges")[0]


def _start(spark, sf_dir) -> DataFrame:
    spawning = edges(spark, sf_dir).filter("type = 'spawns'").select(F.col("src").alias("node_id"))
    return spawning.unionByName(spark.createDataFrame([(HUB,)], "node_id string")).distinct()


@query(_WRC + _walks("wk", _START, 3) + "SELECT array_to_string(ns, ' > ') AS path, len(es) AS hops FROM lf ORDER BY array_to_string(ks, chr(2)) LIMIT 40")
def chains_of_graph(spark, sf_dir):
    """The first forty flow chains from the hub and all spawning nodes, in depth-first order."""
    out = T.chains(_path_edges(spark, sf_dir), _start(spark, sf_dir), 3, 40)
    return out.select(F.array_join("nodes", " > ").alias("path"), F.size("edge_ids").cast("bigint").alias("hops"))


@query(_WRC + _walks("wk", _START, 3) + "SELECT count(*) AS n_chains, count(*) - 40 AS n_hidden, max(len(es)) AS longest FROM lf")
def chain_totals(spark, sf_dir):
    """How many chains there are, and how many a page of forty hides."""
    leaves = T.leaf_chains(_path_edges(spark, sf_dir), _start(spark, sf_dir), 3)
    return leaves.agg(F.count("*").alias("n_chains"), (F.count("*") - 40).alias("n_hidden"), F.max(F.size("edge_ids")).cast("bigint").alias("longest"))


_HUB_START = f"SELECT '{HUB}' AS s"
#: The least node that is two hops from the hub.
_TARGET = ", far AS (SELECT min(last) AS t FROM (SELECT last, min(len(es)) AS d FROM wk GROUP BY last) WHERE d = 2)"


def _two_hops_off(spark, sf_dir) -> tuple[DataFrame, str | None]:
    """Flow edges, and the least node that is two hops from the hub; none if there is no such node, as in a graph without the hub."""
    e = _path_edges(spark, sf_dir)
    hits = T.traverse(e, spark.createDataFrame([(HUB, HUB)], "root_id string, node_id string"), "out", 2)
    return e, hits.filter("depth = 2").agg(F.min("node_id")).first()[0]


@query(_WRC + _walks("wk", _HUB_START, 4) + _TARGET + """ SELECT array_to_string(ns, ' > ') AS path, len(es) AS hops FROM wk, far WHERE last = far.t ORDER BY len(es), array_to_string(es, ',') LIMIT 5""")
def k_shortest_of_graph(spark, sf_dir):
    """Five shortest simple paths from the hub to a node that is two hops off."""
    e, target = _two_hops_off(spark, sf_dir)
    return T.shortest_paths(e, HUB, target, 5, 4).select(F.array_join("nodes", " > ").alias("path"), F.col("hops").cast("bigint").alias("hops"))


@query(_WRC + _walks("wk", _HUB_START, 3) + _TARGET + """ SELECT array_to_string(ns, ' > ') AS path FROM lf, far WHERE list_contains(ns, far.t) ORDER BY array_to_string(list_concat([ns[1]], ks), chr(2)) LIMIT 20""")
def flows_through_node(spark, sf_dir):
    """Chains from the hub that pass a given node."""
    e, target = _two_hops_off(spark, sf_dir)
    if target is None:
        return spark.createDataFrame([], "path string")
    return T.flows_through(e, spark.createDataFrame([(HUB,)], "node_id string"), target, 3, 20).select(F.array_join("nodes", " > ").alias("path"))


@query(_WRC + _walks("wk", _START, 3) + """, r AS (SELECT ns[1] AS node_id, ns, es, row_number() OVER (PARTITION BY ns[1] ORDER BY len(es) DESC, array_to_string(ks, chr(2))) AS r FROM wk) SELECT node_id, len(es) AS hops, array_to_string(ns, ' > ') AS path FROM r WHERE r = 1""")
def longest_of_graph(spark, sf_dir):
    """The longest simple chain, of three hops at most, from every start."""
    out = T.longest_chains(_path_edges(spark, sf_dir), _start(spark, sf_dir), 3, "out")
    return out.select("node_id", F.col("hops").cast("bigint").alias("hops"), F.array_join("nodes", " > ").alias("path"))


@query(_WRC + _walks("wk", _START, 3) + """, bad AS (SELECT id FROM e WHERE verification_state <> 'verified')
SELECT array_to_string(ns, ' > ') AS path FROM lf WHERE NOT EXISTS (SELECT 1 FROM bad WHERE list_contains(es, bad.id))""")
def verified_chains(spark, sf_dir):
    """Chains of which every hop is verified."""
    leaves = T.leaf_chains(_path_edges(spark, sf_dir), _start(spark, sf_dir), 3)
    return answers.verified_chains(materialize(leaves, "leaves")[0], edges(spark, sf_dir), "verified").select(F.array_join("nodes", " > ").alias("path"))


@query(_WRC + _walks("wk", _START, 3) + """, m AS (SELECT DISTINCT ns FROM lf), x AS (SELECT ns, unnest(ns) AS id, generate_subscripts(ns, 1) AS k FROM m)
SELECT 'chain:' || ns[1] || ':' || sha256(array_to_string(ns, chr(1)))[:12] AS entity_id, string_agg(coalesce(n.label, ''), ' ' ORDER BY k) AS text FROM x LEFT JOIN n ON n.id = x.id GROUP BY ns""")
def chain_corpus(spark, sf_dir):
    """Chains as search entities: id by members, text by labels."""
    return answers.chain_entities(nodes(spark, sf_dir), _path_edges(spark, sf_dir), _start(spark, sf_dir), 3).select("entity_id", "text")


@query(
    _WRC
    + _walks("wk", _START, 2)
    + """, h AS (SELECT ks, es, unnest(ns) AS id, generate_subscripts(ns, 1) AS at_ FROM lf),
p AS (SELECT h.ks, at_, CASE WHEN at_ = 1 THEN '' ELSE ' -[' || coalesce(e.type, '') || CASE WHEN e.confidence IN ('partial', 'unknown') THEN '?' ELSE '' END || ']-> ' END || '(' || coalesce(n.service, '') || ') ' || coalesce(n.file, '') || ':' || coalesce(n.line, 0) || ' ' || coalesce(n.label, '') AS s
  FROM h LEFT JOIN n ON n.id = h.id LEFT JOIN e ON e.id = h.es[at_ - 1])
SELECT string_agg(s, '' ORDER BY at_) AS line FROM p GROUP BY ks"""
)
def rendered_chains(spark, sf_dir):
    """Chains as one line each."""
    n, e = both(spark, sf_dir)
    leaves, _ = materialize(T.leaf_chains(_path_edges(spark, sf_dir), _start(spark, sf_dir), 2), "leaves")
    return answers.rendered(leaves, n, e).select("line")


@query(
    _WRC
    + """, w1 AS (SELECT min(dst) AS t FROM e WHERE type = 'kafka_publish'),
lp AS (SELECT [t] AS p FROM w1 UNION ALL SELECT list_prepend(x.s, lp.p) FROM lp, LATERAL (SELECT min(src) AS s FROM e WHERE dst = lp.p[1] AND type NOT IN ('contains', 'declares', 'instantiates', 'uses_type', 'imports') AND NOT list_contains(lp.p, src)) x WHERE x.s IS NOT NULL AND len(lp.p) <= 6)
SELECT array_to_string(p, ' > ') AS path FROM lp ORDER BY len(p) DESC LIMIT 1"""
)
def launch_path(spark, sf_dir):
    """How a consumer is reached, the least source at each hop."""
    e = materialize(edges(spark, sf_dir), "edges")[0]
    target = e.filter("type = 'kafka_publish'").agg(F.min("dst")).first()[0]
    return spark.createDataFrame([(" > ".join(answers.launch_prefix(e, target)),)], "path string")


@query(_WRC + _walks("wk", _HUB_START, 2) + _TARGET + """, two AS (SELECT ns, es FROM wk, far WHERE last = far.t AND len(es) = 2 ORDER BY array_to_string(es, ',') LIMIT 1), one AS (SELECT w.ns FROM wk w, two WHERE len(w.es) = 1 AND w.ns[2] = two.ns[2] ORDER BY array_to_string(w.es, ',') LIMIT 1)
SELECT array_to_string(list_append(one.ns, two.ns[3]), ' > ') AS path FROM one, two""")
def waypoint_route(spark, sf_dir):
    """The shortest path through given stops: the hub, one of its neighbours, and a node beyond."""
    e, target = _two_hops_off(spark, sf_dir)
    if target is None:
        return spark.createDataFrame([], "path string")
    middle = T.shortest_paths(e, HUB, target, 1, 4).first()["nodes"][1]
    return spark.createDataFrame([(" > ".join(T.waypoints(e, [HUB, middle, target])),)], "path string")


# ---- search and evaluation --------------------------------------------------------------------------------------------


@query(W + """, c AS (SELECT id, service, file, regexp_matches(regexp_extract(lower(file), '[^/]*$'), '\\.test\\.|\\.spec\\.|_test\\.go$|_test\\.rb$|_spec\\.rb$|^test_') AS t FROM n WHERE lower(label) = 'section' ORDER BY t, service, file, id LIMIT 20),
r AS (SELECT *, row_number() OVER (ORDER BY t, service, file, id) AS pick FROM c)
SELECT id, service FROM r QUALIFY row_number() OVER (PARTITION BY service ORDER BY pick) = 1""")
def roots_per_service(spark, sf_dir):
    """One root for each service that has the name."""
    return search.roots_per_service(search.resolve_target(nodes(spark, sf_dir), "section")).select("id", "service")


@query(W + f"""SELECT '{HUB}' AS query, '' AS note, count(*) AS n FROM n WHERE id = '{HUB}' UNION ALL SELECT 'sundry', '', count(*) FROM n WHERE lower(label) = 'sundry' UNION ALL SELECT 'sundr', 'no exact match for ''sundr'': the nearest name is used', 1""")
def resolution_notes(spark, sf_dir):
    """How three spellings of one target resolve, and what is said of it."""
    n = materialize(nodes(spark, sf_dir), "nodes")[0]
    out = []
    for text in (HUB, "sundry", "sundr"):
        found = search.resolve_target(n, text)
        exact = n.filter((F.col("id") == text) | (F.lower("label") == text.lower())).limit(1).count() > 0
        out.append((text, search.resolution_note(text, exact), found.count() if exact else 1))
    return spark.createDataFrame(out, "query string, note string, n bigint")


@query(
    """WITH d AS (SELECT doc_id, coalesce(lower(trim(source)), '') AS type, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda w: w <> '') AS t FROM documents),
c AS (SELECT doc_id, type, len(t) AS len, len(list_filter(t, lambda w: starts_with(w, 'session'))) AS a FROM d), k AS (SELECT count(*) AS n, avg(len) AS av, count(*) FILTER (a > 0) AS na FROM c),
s AS (SELECT doc_id, type, round(greatest(ln((n - na + 0.5) / (na + 0.5)), 1e-6) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * len / av)), 6) AS score FROM c, k WHERE a > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY score DESC, doc_id) AS rank FROM s)
SELECT doc_id, type, rank FROM r WHERE rank <= CASE WHEN type = 'docs' THEN 3 ELSE 5 END"""
)
def capped_sections(spark, sf_dir):
    """Hits cut to the caps of their sections."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", P.given(F.lower(F.trim("source"))).alias("type"))
    scored = search.bm25(docs, ["session"]).withColumn("score", F.round("score", 6)).withColumn("match", F.lit("lexical"))
    return search.capped(scored, docs.select("doc_id", "type"), {"docs": 3}, 5).select("doc_id", "type", F.col("rank").cast("bigint").alias("rank"))


@query(W + """, q AS (SELECT DISTINCT node_id FROM (SELECT src AS node_id FROM e WHERE type = 'spawns' UNION ALL SELECT dst FROM e WHERE type = 'spawns'))
SELECT q.node_id AS entity_id, coalesce(n.label, '') AS label, coalesce(n.service, '') AS service, coalesce(concat_ws(' ', nullif(n.label, ''), nullif(n.type, ''), nullif(n.service, ''), nullif(n.file, '')), '') AS text FROM q LEFT JOIN n ON n.id = q.node_id""")
def enriched_entities(spark, sf_dir):
    """Entities of a result with their texts and the nodes behind them."""
    n, e = both(spark, sf_dir)
    n = n.withColumn("meta", F.expr("cast(map() AS map<string,string>)"))
    spawn = e.filter("type = 'spawns'")
    ids = spawn.select(F.col("src").alias("entity_id")).unionByName(spawn.select(F.col("dst").alias("entity_id"))).distinct()
    return search.enriched(ids, answers.node_cards(n), n).select("entity_id", P.given(F.col("label")).alias("label"), P.given(F.col("service")).alias("service"), P.given(F.col("text")).alias("text"))


@query("""WITH c AS (SELECT DISTINCT id, duration_ms, lower(trim(tool)) AS tool, lower(trim(source)) AS source, strftime(ts, '%Y-%m-%d %H') AS hour FROM tool_calls WHERE duration_ms >= 0),
p AS (SELECT tool, hour, avg(duration_ms) FILTER (source = 'ui') AS a, avg(duration_ms) FILTER (source = 'mcp') AS b FROM c GROUP BY 1, 2), q AS (SELECT 100.0 * (a - b) / a AS cut FROM p WHERE a > 0 AND b IS NOT NULL)
SELECT count(*) AS n_pairs, median(cut) >= 80 AND true AS "pass" FROM q""")
def flow_gates(spark, sf_dir):
    """Whether the median reduction and the correctness pass the gate."""
    cols = ("id", "ts", "duration_ms")
    calls = table(spark, sf_dir, "tool_calls").select(*cols, F.lower(F.trim("tool")).alias("tool"), F.lower(F.trim("source")).alias("source")).distinct().filter("duration_ms >= 0")
    pairs = evaluation.pairing(calls.withColumn("hour", F.date_format("ts", "yyyy-MM-dd HH")), ["tool", "hour"], "source", "duration_ms", "ui", "mcp")
    return evaluation.flow_gate(pairs, 0.97).select("n_pairs", "pass")


@query("""WITH a AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents), b AS (SELECT doc_id, trim(regexp_replace(regexp_replace(t, '[`''"]', '', 'g'), '\\s+', ' ', 'g')) AS t FROM a)
SELECT CAST(doc_id AS VARCHAR) AS case_id, CAST(NOT contains(t, 'the ledger') AS BIGINT) + CAST(NOT contains(t, 'is') AS BIGINT) AS n_missing, CAST(contains(t, 'nobody knows') AS BIGINT) AS n_forbidden, contains(t, 'the ledger') AND contains(t, 'is') AND NOT contains(t, 'nobody knows') AS correct FROM b""")
def answer_facts(spark, sf_dir):
    """Chunks as answers: required and forbidden facts met."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("case_id"), P.given(F.col("text")).alias("answer"))
    facts = docs.select("case_id", F.explode(F.array(*(F.struct(F.lit(f).alias("fact"), F.lit(r).alias("required")) for f, r in (("The 'ledger'", True), ("is", True), ("nobody  knows", False))))).alias("f")).select("case_id", "f.*")
    return evaluation.facts_matched(docs, facts)


@query(W + """SELECT service, CASE WHEN count(*) FILTER (type = 'table') > 0 THEN 'unresolved_refs' ELSE '' END AS causes, count(*) AS n FROM n GROUP BY service""")
def answer_coverage(spark, sf_dir):
    """Why an answer over each service is a lower bound: unresolved references, here its tables."""
    none = F.lit(0)
    g = nodes(spark, sf_dir).groupBy("service").agg(F.count_if(F.col("type") == "table").alias("u"), F.count("*").alias("n"))
    return g.select("service", evidence.verdict(F.col("u"), F.lit(False), none, none, none, none).alias("causes"), "n")


# ---- streams ----------------------------------------------------------------------------------------------------------


def _source(spark, sf_dir, name: str) -> DataFrame:
    """A table of the data set as a stream."""
    return spark.readStream.schema(table(spark, sf_dir, name).schema).parquet(f"{sf_dir}/{name}.parque[t]")


def _run(out: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and reads what its batches wrote."""
    spark = out.sparkSession
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    out.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{base}/out").select(*out.columns)


@query(dealt.ORACLES["p1_found"])
def stream_ingested_spans(spark, sf_dir):
    """Spans of exports that come as a stream, each export once."""
    base = f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"
    streaming.ingest_spans(_source(spark, sf_dir, "otlp_exports"), f"{base}/spans", f"{base}/state").awaitTermination()
    return spark.read.parquet(f"{base}/spans").drop("batch")


@query("SELECT lower(trim(tool)) AS tool, count(DISTINCT id) AS n FROM tool_calls GROUP BY 1")
def stream_deduped_calls(spark, sf_dir):
    """Calls that are delivered again, counted once, as a stream."""
    calls = _source(spark, sf_dir, "tool_calls").select("id", F.lower(F.trim("tool")).alias("tool"), F.col("received_at").cast("timestamp").alias("at"))
    return _run(streaming.deduped(calls, "at", ["id"], "60 days")).groupBy("tool").agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT max(ts) - INTERVAL 1 DAY AS mark FROM events), w AS (SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01') AS s, event_type, count(*) AS n FROM events GROUP BY 1, 2)
SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS window_start, event_type, n FROM w, m WHERE s + INTERVAL 6 HOUR <= mark""")
def stream_closed_windows(spark, sf_dir):
    """Windows that the watermark has closed: none later can change."""
    ev = _source(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = _run(streaming.windowed_counts(ev, "ts", ["event_type"], "6 hours"))
    return out.select(F.col("window_start").cast("string").alias("window_start"), "event_type", "n")


@query(
    analysis._SPANS
    + """SELECT c.trace_id, c.span_id AS client_span, d.span_id AS server_span, c.service AS src_service, d.service AS dst_service FROM s c JOIN s d ON d.trace_id = c.trace_id AND d.parent_span_id = c.span_id
WHERE c.kind = 'CLIENT' AND d.kind = 'SERVER' AND c.span_id <> '' AND abs(CAST(d.start_ns AS BIGINT) - CAST(c.start_ns AS BIGINT)) <= 3600000000000"""
)
def stream_joined_spans(spark, sf_dir):
    """Client spans joined to server spans as two streams."""
    spans = materialize(SP.span_rows(table(spark, sf_dir, "otlp_exports")).withColumn("started_at", F.timestamp_micros(F.expr("start_ns div 1000"))), "spans")[0]

    def side(kind: str) -> DataFrame:
        own, path = materialize(spans.filter((F.col("kind") == kind) & (F.col("span_id") != "")), kind.lower())
        return spark.readStream.schema(own.schema).parquet(path)

    return _run(streaming.matched_spans(side("CLIENT"), side("SERVER")))


# ---- providers, bundles, sources of symbols ---------------------------------------------------------------------------


@query(W + """, s AS (SELECT e.type, x.provider AS p FROM (SELECT type, unnest(sources) AS x FROM e) e) SELECT p AS provider, type, count(*) AS n FROM s WHERE p IN ('runtime', 'contract') GROUP BY 1, 2 UNION ALL SELECT 'problem', 'config: ValueError: no settings', 1""")
def evidence_providers(spark, sf_dir):
    """Evidence that the providers give, and the one that fails."""
    def of(name: str):
        def provide(inputs: dict[str, DataFrame]) -> DataFrame:
            if name == "config":
                raise ValueError("no settings")
            return inputs["edges"].select("src", "dst", "type", "label", F.explode("sources").alias("source"))

        return provide

    found, _, problems = evidence.collected({p: of(p) for p in evidence.PROVIDERS}, {"edges": edges(spark, sf_dir)})
    rows = found.groupBy(F.col("source.provider").alias("provider"), "type").agg(F.count("*").alias("n"))
    return rows.unionByName(spark.createDataFrame([("problem", f"{k}: {v}", 1) for k, v in problems.items()], "provider string, type string, n bigint"))


@query("""WITH b AS (SELECT doc_id, '## ' || doc_id || chr(10) || chr(10) || coalesce(text, '') || chr(10) AS t FROM documents ORDER BY doc_id LIMIT 40), s AS (SELECT doc_id, sum(strlen(t)) OVER (ORDER BY doc_id) AS u, row_number() OVER (ORDER BY doc_id) AS r FROM b)
SELECT greatest(1, count(*) FILTER (u / 4.0 <= 3000)) AS n_kept, 40 - greatest(1, count(*) FILTER (u / 4.0 <= 3000)) AS n_dropped FROM s""")
def context_bundle(spark, sf_dir):
    """How many of forty blocks fit into a bundle of 3,000 tokens: one answer's blocks, a feature of the bundle."""
    rows = table(spark, sf_dir, "documents").orderBy("doc_id").limit(40).collect()
    text, dropped = answers.bundle([(str(r["doc_id"]), r["text"] or "") for r in rows], 3_000)
    return spark.createDataFrame([(len(rows) - dropped, dropped)], "n_kept bigint, n_dropped bigint")


@query(W + f"""SELECT '{HUB}' AS target, (SELECT count(*) FROM (SELECT dst AS x FROM e WHERE src = '{HUB}' UNION SELECT src FROM e WHERE dst = '{HUB}') WHERE x <> '{HUB}') AS n_near, 0 AS n_candidates""")
def investigation(spark, sf_dir):
    """What an investigation of the hub finds next to it, of all that there is."""
    n, e = (materialize(df, "graph")[0] for df in both(spark, sf_dir))
    found = answers.investigate(n, e, HUB, flows=5, depth=2)
    near = answers.context(n, e, found["target"], depth=1).count()
    assert len(found["context"]) <= found["totals"]["context"] and len(found["flows"]) <= found["totals"]["flows"]
    return spark.createDataFrame([(found["target"], near, found["totals"]["candidates"])], "target string, n_near bigint, n_candidates bigint")


@query(W + """, d AS (SELECT service || '/' || file AS k, string_agg('line ' || line || ' ' || label, chr(10) ORDER BY line, id) AS t, count(*) AS c FROM n WHERE service <> '' AND file <> '' GROUP BY 1),
x AS (SELECT id, service || '/' || file AS k, row_number() OVER (PARTITION BY service, file ORDER BY line, id) AS r FROM n WHERE service <> '' AND file <> '')
SELECT x.id, array_to_string(string_split(d.t, chr(10))[r : r + 1], chr(10)) AS source FROM x JOIN d ON d.k = x.k""")
def symbol_sources(spark, sf_dir):
    """The two lines of its file in which each node begins."""
    n = nodes(spark, sf_dir).filter("service <> '' AND file <> ''")
    line = F.concat_ws(" ", F.lit("line"), "line", "label")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "id", line.alias("t")))), lambda x: x["t"]), "\n")
    files = n.groupBy("service", "file").agg(text.alias("text"))
    from pyspark.sql import Window

    placed = n.withColumn("at", F.row_number().over(Window.partitionBy("service", "file").orderBy("line", "id")))
    return answers.symbol_text(placed.select("id", "service", "file", F.col("at").alias("line"), (F.col("at") + 1).alias("end_line")), files).select("id", "source")
