"""Queries of the linkers that work on node fields, with their oracle SQL.

The fields are made from the graph tables by rule, so that every linker meets
hits, misses and ties over all nodes.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowskein.operators import linkers as L
from flowskein.plans.graph import W, both, edges, nodes

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}
WR = "WITH RECURSIVE " + W[len("WITH ") :]


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = sql
        return f

    return add


def _made(n: DataFrame, of: str, kind: str, prefix: str, lang: str = "lang", file: str = "file", **fields: str) -> DataFrame:
    """Nodes of the types ``of`` as nodes of another type, with fields by SQL."""
    pairs = ", ".join(f"'{k}', {v}" for k, v in fields.items())
    return n.filter(F.col("type").isin(*of.split())).selectExpr(
        f"concat('{prefix}', id) AS id", f"'{kind}' AS type", "label", "service", f"{file} AS file", "line", f"{lang} AS lang", f"map({pairs}) AS meta"
    )


_GRPC = """, r AS (SELECT *, CASE WHEN line % 5 = 0 THEN '' ELSE label END AS t FROM n WHERE type IN ('class', 'struct')),
m AS (SELECT id, service, lower(meta['class']) AS c FROM n WHERE type = 'method' AND coalesce(meta['class'], '') <> ''),
j AS (SELECT r.*, m.id AS m_id FROM r LEFT JOIN m ON m.service = r.service AND m.c = lower(r.t) AND r.t <> '')"""


def _grpc(spark, sf_dir):
    n = nodes(spark, sf_dir)
    impl = "CASE line % 5 WHEN 0 THEN 'makeIt()' WHEN 1 THEN concat('&pkg.', label, '{db: db}') WHEN 2 THEN concat('new(', label, ')') ELSE concat(label, '{}') END"
    registered = _made(n, "class struct", "grpc_handler", "g:", pattern="'grpc_server_register'", impl=impl)
    return L.grpc_methods(registered.unionByName(_made(n, "method", "method", "", receiver="concat('*', meta['class'])")))


@query(W + _GRPC + " SELECT 'calls:g:' || id || '->' || m_id AS id FROM j WHERE m_id IS NOT NULL")
def grpc_handlers(spark, sf_dir):
    """Registered services to the methods of their type."""
    return _grpc(spark, sf_dir)[0].select("id")


@query(W + _GRPC + " SELECT service, file, CASE WHEN t = '' THEN 'makeIt()' ELSE t END AS name, count(*) AS n FROM j WHERE m_id IS NULL GROUP BY 1, 2, 3")
def grpc_unresolved(spark, sf_dir):
    """Registrations whose type has no methods."""
    return _grpc(spark, sf_dir)[1].groupBy("service", "file", "name").agg(F.count("*").alias("n"))


_ROUTE = """, t AS (SELECT service, label, min(id) AS t FROM n WHERE type IN ('function', 'method', 'component') GROUP BY 1, 2),
j AS (SELECT r.*, t.t FROM n r LEFT JOIN t ON t.service = r.service AND t.label = r.label WHERE r.type = 'http_handler' AND r.label <> '')"""


def _routes(spark, sf_dir):
    n = nodes(spark, sf_dir)
    return L.route_components(_made(n, "http_handler", "route", "r:", component="label").unionByName(n.filter("type IN ('function', 'method', 'component')").select("id", "type", "label", "service", "file", "line", "lang", "meta")))


@query(W + _ROUTE + " SELECT 'renders:r:' || id || '->' || t AS id FROM j WHERE t IS NOT NULL UNION ALL SELECT 'component_ref:' || service || ':' || file || ':' || line || ':' || label FROM j WHERE t IS NULL")
def route_components(spark, sf_dir):
    """Routes to their components, and the ledger of those without."""
    links, lost = _routes(spark, sf_dir)
    return links.select("id").unionByName(lost.select(F.concat_ws(":", "kind", "service", "file", "line", "name").alias("id")))


@query(W + """, c AS (SELECT *, regexp_replace(file, '\\.[^./]+$', '') AS stem FROM n WHERE type = 'component'), f AS (SELECT stem, label, min(id) AS f FROM c WHERE line % 2 = 0 GROUP BY 1, 2)
SELECT 'component_impl:f:' || f.f || '->t:' || c.id AS id FROM c JOIN f ON f.stem = c.stem AND f.label = c.label""")
def template_twins(spark, sf_dir):
    """Generated functions to the components that they come from; every other component has one."""
    n = nodes(spark, sf_dir)
    stem = "regexp_replace(file, '[.][^./]+$', '')"
    shown = _made(n, "component", "component", "t:", "'templ'", f"concat({stem}, '.templ')", x="''")
    return L.template_twins(shown.unionByName(_made(n.filter("line % 2 = 0"), "component", "function", "f:", "'go'", f"concat({stem}, '_templ.go')", x="''"))).select("id")


@query(W + """, f AS (SELECT service, file, label, min(id) AS f FROM n WHERE type IN ('function', 'method') GROUP BY 1, 2, 3), r AS (SELECT * FROM n WHERE type IN ('function', 'method') AND label <> '')
SELECT DISTINCT 'flows_to:' || e.dst || '->s:' || r.id AS id FROM r JOIN f ON f.service = r.service AND f.file = r.file AND f.label = r.label JOIN e ON e.src = f.f AND e.type = 'calls' JOIN n c ON c.id = e.dst AND c.type = 'http_client'""")
def resource_signals(spark, sf_dir):
    """Clients to the resources whose loaders call them."""
    n, e = both(spark, sf_dir)
    plain = n.select("id", "type", "label", "service", "file", "line", "lang", F.expr("cast(map() AS map<string,string>)").alias("meta"))
    return L.resource_signals(plain.unionByName(_made(n, "function method", "variable", "s:", resource_fn="label")), e).select("id")


def _streams(n: DataFrame) -> DataFrame:
    patterned = _made(n, "http_client", "http_client", "", pattern="CASE WHEN line % 3 = 0 THEN 'fetch' ELSE 'eventsource_connect' END")
    return patterned.unionByName(_made(n, "subscriber", "subscriber", "", pattern="CASE line % 3 WHEN 0 THEN 'kafka' WHEN 1 THEN 'ws_on_message' ELSE 'ws_onmessage_assign' END"))


@query(W + """SELECT 'sse:' || c.id || '->' || s.id AS id FROM n c JOIN n s ON s.file = c.file AND s.type = 'subscriber' AND s.line % 3 <> 0 WHERE c.type = 'http_client' AND c.line % 3 <> 0""")
def event_stream_handlers(spark, sf_dir):
    """Event sources to the message handlers of their files."""
    return L.event_stream_handlers(_streams(nodes(spark, sf_dir))).select("id")


@query(W + """SELECT DISTINCT 'sse_push:' || e.dst || '->' || e.src AS id FROM e JOIN n c ON c.id = e.src AND c.type = 'http_client' AND c.line % 3 <> 0 WHERE e.type = 'http_call'""")
def event_stream_pushes(spark, sf_dir):
    """Calls of event sources turned around."""
    n, e = both(spark, sf_dir)
    return L.event_stream_pushes(_streams(n), e).select("id")


_BROKER = """, en AS (SELECT id, type, service, file, line, label, CASE WHEN line % 4 = 0 THEN 'ex' || line % 3 ELSE '' END AS own, CASE WHEN line % 5 = 0 THEN '' ELSE lang || line % 7 END AS queue FROM n WHERE type IN ('publisher', 'subscriber') AND service <> ''),
ch AS (SELECT id, service, 'ex' || line % 4 AS ex, CASE WHEN line % 2 = 0 THEN 0 ELSE 1 END AS keyed FROM n WHERE type = 'channel' AND service <> ''),
qs AS (SELECT DISTINCT service, queue, own AS named FROM en WHERE queue <> '' AND own <> ''),
sv AS (SELECT service AS s, row_number() OVER (ORDER BY service) AS k FROM (SELECT DISTINCT service FROM n WHERE service <> '')),
li AS (SELECT DISTINCT a.s AS f, b.s AS t, 'ex' || a.k % 5 AS ex FROM sv a JOIN sv b ON b.k = a.k + 1),
el AS (SELECT en.*, li.* FROM en JOIN li ON li.f = en.service WHERE en.type = 'publisher' AND own = '' UNION ALL SELECT en.*, li.* FROM en JOIN li ON li.t = en.service WHERE en.type = 'subscriber'),
ev AS (SELECT id, own AS named FROM en WHERE own <> '' UNION SELECT en.id, qs.named FROM en JOIN qs ON qs.service = en.service AND qs.queue = en.queue),
ma AS (SELECT el.*, ev.named IS NOT NULL AS hit, el.id IN (SELECT id FROM ev) AS told FROM el LEFT JOIN ev ON ev.id = el.id AND ev.named = el.ex),
si AS (SELECT *, count(*) FILTER (hit) OVER (PARTITION BY id) AS hits, count(*) OVER (PARTITION BY id) AS al FROM ma),
ta AS (SELECT * FROM si WHERE hit OR (NOT told AND al = 1)),
re AS (SELECT * FROM ch QUALIFY keyed = min(keyed) OVER (PARTITION BY service, ex)),
cc AS (SELECT ta.*, re.id AS c, 0 AS r FROM ta JOIN re ON re.service = ta.f AND re.ex = ta.ex UNION ALL SELECT ta.*, re.id, 1 FROM ta JOIN re ON re.service = ta.t AND re.ex = ta.ex),
cb AS (SELECT * FROM cc QUALIFY r = min(r) OVER (PARTITION BY id, ex, f, t)),
fi AS (SELECT ta.id, ta.type, ta.hits, coalesce(cb.c, 'broker:channel:' || ta.ex) AS c FROM ta LEFT JOIN cb ON cb.id = ta.id AND cb.ex = ta.ex AND cb.f = ta.f AND cb.t = ta.t)"""


def _hints(spark, sf_dir):
    n = nodes(spark, sf_dir).filter("service <> ''")
    own, queue = "CASE WHEN line % 4 = 0 THEN concat('\"ex', line % 3, '\"') ELSE '' END", "CASE WHEN line % 5 = 0 THEN '' ELSE concat(lang, line % 7) END"
    ends = _made(n, "publisher", "publisher", "", pattern="'amqp_publish'", exchange=own, queue=queue).unionByName(_made(n, "subscriber", "subscriber", "", pattern="'amqp_consume'", exchange=own, queue=queue))
    channels = _made(n, "channel", "channel", "", exchange="concat('ex', line % 4)", routing_key="CASE WHEN line % 2 = 0 THEN '' ELSE 'k' END")
    named = n.select("service").distinct().orderBy("service").collect()  # one row a service: the settings of a workspace
    links = [(a["service"], b["service"], f"ex{(i + 1) % 5}") for i, (a, b) in enumerate(zip(named, named[1:]))]
    return L.broker_hints(ends.unionByName(channels), spark.createDataFrame(links, "src string, dst string, exchange string"))


@query(W + _BROKER + " SELECT DISTINCT CASE WHEN type = 'publisher' THEN id ELSE c END AS src, CASE WHEN type = 'publisher' THEN c ELSE id END AS dst, CASE WHEN type = 'publisher' THEN 'publishes' ELSE 'subscribes' END AS type, CASE WHEN hits > 1 THEN 'partial' ELSE 'static' END AS confidence FROM fi")
def broker_hints(spark, sf_dir):
    """Publishers and subscribers to the channels of the exchanges that a workspace says they use."""
    return _hints(spark, sf_dir)[1].select("src", "dst", "type", "confidence")


@query(W + _BROKER + " SELECT service, file, line, CASE WHEN label <> '' THEN label ELSE id END AS name FROM (SELECT DISTINCT id, service, file, line, label FROM el) WHERE id NOT IN (SELECT id FROM ta)")
def broker_unresolved(spark, sf_dir):
    """Those of which the exchange cannot be told."""
    return _hints(spark, sf_dir)[2].select("service", "file", "line", "name")


@query(W + """, s AS (SELECT 's:' || id AS id, list_distinct([lang, 'f' || line % 4, 'f' || (line + 1) % 4, 'f' || (line + 2) % 4, 'f' || line % 9]) AS x FROM n WHERE type = 'struct' AND id IN (SELECT dst FROM e WHERE type = 'uses_type')),
i AS (SELECT 'i:' || id AS id, list_distinct([lang, 'f' || line % 4, 'f' || (line + 1) % 4, 'f' || (line + 2) % 4]) AS x FROM n WHERE type = 'class' AND lang <> 'go')
SELECT s.id, count(*) AS n_shapes FROM s JOIN i ON len(list_intersect(s.x, i.x)) >= 2 AND CAST(len(list_intersect(s.x, i.x)) AS DOUBLE) / (len(s.x) + len(i.x) - len(list_intersect(s.x, i.x))) >= 0.8 GROUP BY 1""")
def response_shapes(spark, sf_dir):
    """Response structs and how many interfaces mirror their fields."""
    n, e = both(spark, sf_dir)
    tagged = "concat('[{\"name\":\"X\",\"tag\":\"json:\\\\\"', lang, ',omitempty\\\\\"\"},{\"name\":\"f', line % 4, '\"},{\"name\":\"f', (line + 1) % 4, '\"},{\"name\":\"f', (line + 2) % 4, '\"},{\"name\":\"f', line % 9, '\"},{\"name\":\"H\",\"tag\":\"json:\\\\\"-\\\\\"\"}]')"
    structs = _made(n, "struct", "struct", "s:", "'go'", fields=tagged)
    shapes = _made(n.filter("lang <> 'go'"), "class", "interface", "i:", methods="concat(lang, ', f', line % 4, ',f', (line + 1) % 4, ',f', (line + 2) % 4, ',')")
    returned = e.filter("type = 'uses_type'").select(F.concat(F.lit("s:"), "dst").alias("dst"), F.lit("returns").alias("type"))
    pairs, left, right = L.response_shapes(structs.unionByName(shapes), returned)
    sizes = right.groupBy(F.col("class").alias("r")).agg(F.count("*").alias("n"))
    by_class = pairs.join(sizes, "r").groupBy(F.col("l").alias("class")).agg(F.sum("n").alias("n_shapes"))
    return left.join(by_class, "class").select("id", "n_shapes")


@query(W + """, v AS (SELECT DISTINCT service, upper(string_split(label, '_')[1]) AS h, upper(string_split(label, '_')[1]) || '_SERVICE_URL' AS var FROM n WHERE type = 'file' AND service <> '' AND regexp_full_match(string_split(label, '_')[1], '[A-Za-z]+')),
s AS (SELECT DISTINCT service AS d FROM n WHERE service <> ''),
h AS (SELECT v.service AS src, s.d AS dst, 'http' AS via, min(v.var) AS hint FROM v JOIN s ON contains(regexp_replace(lower(s.d), '[^a-z0-9]', '', 'g'), lower(v.h)) OR contains(lower(v.h), regexp_replace(lower(s.d), '[^a-z0-9]', '', 'g')) WHERE s.d <> v.service GROUP BY 1, 2),
x AS (SELECT DISTINCT service, 'ex' || (line % 11) AS ex FROM n WHERE type = 'channel' AND service <> '' AND NOT regexp_matches(regexp_extract(lower(file), '[^/]*$'), '\\.test\\.|\\.spec\\.|_test\\.go$|_test\\.rb$|_spec\\.rb$|^test_') AND line % 3 = 0)
SELECT src, dst, via, hint FROM h UNION ALL SELECT a.service, b.service, 'broker', a.ex FROM x a JOIN x b ON b.ex = a.ex AND b.service <> a.service""")
def inferred_links(spark, sf_dir):
    """Links between services that variables and shared exchanges suggest."""
    n = nodes(spark, sf_dir)
    word = "upper(split(label, '_')[0])"
    ledger = n.filter("type = 'file' AND service <> '' AND split(label, '_')[0] RLIKE '^[A-Za-z]+$'").selectExpr("service", f"concat('os.Getenv(\"', {word}, '_SERVICE_URL\") + path') AS name", "'dynamic_url' AS kind")
    channels = _made(n.filter("line % 3 = 0"), "channel", "channel", "", exchange="concat('\"ex', line % 11, '\"')")
    return L.inferred_links(ledger, channels, n.filter("service <> ''").select(F.col("service").alias("name")).distinct())


@query(
    WR
    + """, ro AS (SELECT dst AS router, min(src) AS parent FROM e WHERE type = 'contains' GROUP BY 1), us AS (SELECT e.src AS holder, e.dst AS fn, coalesce(n.line, 0) AS ul FROM e LEFT JOIN n ON n.id = e.dst WHERE e.type IN ('calls', 'reads', 'writes')),
rt AS (SELECT ro.router AS id, ro.parent AS router, n.line FROM ro JOIN n ON n.id = ro.router WHERE n.type IN ('http_handler', 'function', 'class')),
ar AS (SELECT DISTINCT router, router AS holder, 0 AS d FROM rt UNION SELECT ar.router, ro.parent, 1 FROM ar JOIN ro ON ro.router = ar.holder WHERE ro.parent <> ar.router)
SELECT DISTINCT 'middleware:' || rt.id || '->' || us.fn AS id FROM rt JOIN ar ON ar.router = rt.router JOIN us ON us.holder = ar.holder WHERE ar.d > 0 OR us.ul < rt.line"""
)
def middleware_links(spark, sf_dir):
    """Routes to the middlewares of their router and of all that enclose it."""
    n, e = both(spark, sf_dir)
    routers = e.filter("type = 'contains'").groupBy(F.col("dst").alias("router")).agg(F.min("src").alias("parent"))
    uses = e.filter("type IN ('calls', 'reads', 'writes')").join(n.select(F.col("id").alias("dst"), "line"), "dst", "left").select(F.col("src").alias("router"), F.col("dst").alias("fn"), F.coalesce("line", F.lit(0)).alias("line"))
    routes = routers.join(n.filter("type IN ('http_handler', 'function', 'class')").select(F.col("id").alias("router"), "line"), "router").select(F.col("router").alias("id"), F.col("parent").alias("router"), "line")
    return L.middleware(routers, uses, routes).select("id")


@query(
    WR
    + """, pa AS (SELECT src AS c, min(dst) AS p FROM e WHERE type = 'inherits' GROUP BY 1), cl AS (SELECT c FROM pa UNION SELECT p FROM pa), l AS (SELECT cl.c, coalesce(n.line, length(cl.c)) AS line FROM cl LEFT JOIN n ON n.id = cl.c),
ac AS (SELECT c, unnest(['show', 'index']) AS a FROM cl), fi AS (SELECT c, 'cb' || line % 3 AS cb, CASE WHEN line % 8 = 0 THEN ['show'] ELSE [] END AS o, CASE WHEN line % 12 = 0 THEN ['show'] ELSE [] END AS x FROM l WHERE line % 4 = 0),
sk AS (SELECT c, 'cb' || line % 3 AS cb, CASE WHEN line % 2 = 0 THEN ['index'] ELSE [] END AS o FROM l WHERE line % 5 = 0),
ch AS (SELECT c, c AS h FROM cl UNION SELECT ch.c, pa.p FROM ch JOIN pa ON pa.c = ch.h),
hf AS (SELECT DISTINCT ac.c, ac.a, fi.cb, ch.h FROM ac JOIN ch ON ch.c = ac.c JOIN fi ON fi.c = ch.h WHERE (len(o) = 0 OR list_contains(o, a)) AND NOT list_contains(x, a)),
hs AS (SELECT DISTINCT ac.c, ac.a, sk.cb FROM ac JOIN ch ON ch.c = ac.c JOIN sk ON sk.c = ch.h WHERE len(o) = 0 OR list_contains(o, a))
SELECT c AS class, a AS action, cb AS callback, CASE WHEN h = c THEN '' ELSE h END AS inherited_from FROM hf WHERE (c, a, cb) NOT IN (SELECT (c, a, cb) FROM hs)"""
)
def class_filters(spark, sf_dir):
    """Actions to the filters that they inherit, less the skipped."""
    n, e = both(spark, sf_dir)
    parents = e.filter("type = 'inherits'").groupBy(F.col("src").alias("class")).agg(F.min("dst").alias("parent"))
    classes = parents.select("class").unionByName(parents.select(F.col("parent").alias("class"))).distinct()
    lined = classes.join(n.select(F.col("id").alias("class"), "line"), "class", "left").withColumn("line", F.coalesce("line", F.length("class")))
    some = lambda cond, name: F.expr(f"CASE WHEN {cond} THEN array('{name}') END")
    rule = lambda every, only, but: lined.filter(f"line % {every} = 0").select("class", F.expr("concat('cb', line % 3)").alias("callback"), only.alias("only"), but.alias("except"))
    filters, skips = rule(4, some("line % 8 = 0", "show"), some("line % 12 = 0", "show")), rule(5, some("line % 2 = 0", "index"), some("false", ""))
    actions = classes.select("class", F.explode(F.array(F.lit("show"), F.lit("index"))).alias("action"))
    return L.class_filters(parents, filters, skips, actions).select("class", "action", "callback", "inherited_from")


_ASSETS = """, f AS (SELECT DISTINCT service, regexp_replace(file, '[^/]*$', '') AS d, regexp_replace(regexp_extract(file, '([^/]*)$'), '\\.[^./]+$', '') AS b FROM n WHERE file <> '' AND service <> ''),
k AS (SELECT *, length(b) % 4 AS k FROM f)"""


def _assets(spark, sf_dir):
    f = nodes(spark, sf_dir).filter("file <> '' AND service <> ''").selectExpr("service", "regexp_replace(file, '[^/]*$', '') AS d", "regexp_replace(regexp_extract(file, '([^/]*)$', 1), '[.][^./]+$', '') AS b").distinct().withColumn("k", F.length("b") % 4)
    there = f.filter("k < 3").selectExpr("service", "concat(d, CASE k WHEN 0 THEN concat(b, '.scss') WHEN 1 THEN concat('_', b, '.sass') ELSE concat(b, '/_index.scss') END) AS file")
    asked = f.selectExpr("service", "concat(d, 'x/main.scss') AS file", "1 AS line", "concat('../', b) AS target").unionByName(f.selectExpr("service", "concat(d, 'main.scss') AS file", "2 AS line", "concat('./', b) AS target"))
    return L.asset_imports(asked, there)


@query(W + _ASSETS + """ SELECT service, d || CASE WHEN m = 1 THEN 'x/main.scss' ELSE 'main.scss' END AS file, CASE WHEN m = 1 THEN '../' ELSE './' END || b AS target, d || CASE k WHEN 0 THEN b || '.scss' WHEN 1 THEN '_' || b || '.sass' ELSE b || '/_index.scss' END AS found FROM k, (VALUES (1), (2)) v(m) WHERE k < 3""")
def asset_imports(spark, sf_dir):
    """Stylesheet imports to the files that they mean."""
    return _assets(spark, sf_dir)[0].select("service", "file", "target", "found")


@query(W + _ASSETS + """ SELECT service, CASE WHEN m = 1 THEN '../' ELSE './' END || b AS name, count(*) AS n FROM k, (VALUES (1), (2)) v(m) WHERE k = 3 GROUP BY 1, 2""")
def asset_unresolved(spark, sf_dir):
    """Imports of files that are not there."""
    return _assets(spark, sf_dir)[1].groupBy("service", "name").agg(F.count("*").alias("n"))


@query(W + """, w AS (SELECT DISTINCT service, file, lower(label) AS name, 'get' AS m, '/' || lang AS b FROM n WHERE type = 'function'), c AS (SELECT service, file, line, lower(label) AS name, '/' || type AS arg FROM n WHERE type IN ('function', 'method', 'class')),
o AS (SELECT service, file, name, min((m, b)) AS o FROM w GROUP BY 1, 2, 3), l AS (SELECT service, name, min((m, b)) AS l FROM w GROUP BY 1, 2 HAVING count(*) = 1),
x AS (SELECT c.*, coalesce(o.o, l.l) AS x FROM c LEFT JOIN o ON o.service = c.service AND o.file = c.file AND o.name = c.name LEFT JOIN l ON l.service = c.service AND l.name = c.name)
SELECT concat_ws(':', service, file, 'http_client', name, line) AS id, x[1] AS method, x[2] || arg AS url FROM x WHERE x IS NOT NULL""")
def wrapper_calls(spark, sf_dir):
    """Call sites of wrappers as clients."""
    n = nodes(spark, sf_dir)
    wrappers = n.filter("type = 'function'").selectExpr("service", "file", "lower(label) AS name", "'GET' AS method", "concat('/', lang, '/') AS base_url")
    calls = n.filter("type IN ('function', 'method', 'class')").selectExpr("service", "file", "line", "lower(label) AS name", "concat('/', type) AS arg")
    return L.wrapper_calls(wrappers, calls).select("id", "method", "url")


_PICK = """, c AS (SELECT id, service, file, line // 40 AS line, ['uri', 'path', 'data', 'headers', 'url'][line % 5 + 1] AS key, lower(label[1]) AS via FROM n WHERE type IN ('class', 'function', 'method', 'struct') AND file <> ''),
t AS (SELECT service, file, via, min(key) AS k FROM (SELECT service, file, lower(label[1]) AS via, CASE WHEN line % 2 = 0 THEN 'data' ELSE 'headers' END AS key FROM n WHERE type = 'variable') GROUP BY 1, 2, 3),
r AS (SELECT c.*, CASE WHEN c.key = t.k THEN 0 WHEN c.key = 'url' THEN 1 WHEN c.key = 'uri' THEN 2 WHEN c.key = 'path' THEN 3 WHEN c.key = 'endpoint' THEN 4 ELSE 5 END AS r FROM c LEFT JOIN t ON t.service = c.service AND t.file = c.file AND t.via = c.via),
p AS (SELECT *, count(*) OVER (PARTITION BY service, file, line) AS k FROM r QUALIFY row_number() OVER (PARTITION BY service, file, line ORDER BY r, id) = 1)"""


@query(W + _PICK + " SELECT id, key, k > 1 AND r = 5 AS unsure FROM p")
def picked_candidates(spark, sf_dir):
    """The URL among the fields of one call site, and whether it is a guess."""
    n = nodes(spark, sf_dir)
    key = "CASE line % 5 WHEN 0 THEN 'uri' WHEN 1 THEN 'path' WHEN 2 THEN 'data' WHEN 3 THEN 'headers' ELSE 'url' END"
    candidates = n.filter("type IN ('class', 'function', 'method', 'struct') AND file <> ''").selectExpr("id", "service", "file", "line div 40 AS line", f"{key} AS key", "lower(substr(label, 1, 1)) AS via")
    told = n.filter("type = 'variable'").selectExpr("service", "file", "lower(substr(label, 1, 1)) AS via", "CASE WHEN line % 2 = 0 THEN 'data' ELSE 'headers' END AS key")
    picked, unsure = L.picked_candidates(candidates, told)
    return picked.join(unsure.select(F.col("name").alias("id"), F.lit(True).alias("u")), "id", "left").select("id", "key", F.coalesce("u", F.lit(False)).alias("unsure"))


@query(
    WR
    + """, k AS (SELECT DISTINCT service, type AS name, CASE type WHEN 'function' THEN 'class' WHEN 'class' THEN 'struct' WHEN 'method' THEN 'table' WHEN 'table' THEN 'method' ELSE '' END AS ref, CASE WHEN type = 'struct' THEN 'http://' || service || '.test:80/x' WHEN type = 'variable' THEN 'db' ELSE '' END AS value FROM n WHERE service <> ''),
w AS (SELECT DISTINCT service, name AS root, name FROM k UNION SELECT w.service, w.root, k.ref FROM w JOIN k ON k.service = w.service AND k.name = w.name AND k.ref <> ''),
v AS (SELECT w.service, w.root, min(k.value) AS v FROM w JOIN k ON k.service = w.service AND k.name = w.name WHERE k.value <> '' AND k.ref = '' GROUP BY 1, 2 HAVING count(DISTINCT k.value) = 1)
SELECT n.id, coalesce(regexp_replace(regexp_replace(v.v, '^[a-z]+://', ''), '[:/].*$', ''), '') AS host, CASE WHEN v.v LIKE 'http%' THEN n.service ELSE '' END AS target_service FROM n LEFT JOIN v ON v.service = n.service AND v.root = n.type WHERE n.service <> ''"""
)
def resolved_hosts(spark, sf_dir):
    """Hosts of clients whose URL is a constant, over chains and cycles of constants."""
    n = nodes(spark, sf_dir).filter("service <> ''")
    ref = "CASE type WHEN 'function' THEN 'class' WHEN 'class' THEN 'struct' WHEN 'method' THEN 'table' WHEN 'table' THEN 'method' ELSE '' END"
    constants = n.selectExpr("service", "type AS name", f"{ref} AS ref", "CASE WHEN type = 'struct' THEN concat('http://', service, '.test:80/x') WHEN type = 'variable' THEN 'db' ELSE '' END AS value").distinct()
    links = n.selectExpr("concat(service, '.test') AS host", "service AS target").distinct()
    return L.resolved_hosts(n.selectExpr("id", "service", "type AS name"), constants, links)


@query(W + """, f AS (SELECT DISTINCT service || '/' || file AS file FROM n WHERE service <> '' AND file <> ''), m AS (SELECT DISTINCT service AS root, CASE WHEN length(service) % 2 = 0 THEN 'go,javascript' ELSE 'go' END AS langs, service AS name FROM n WHERE service <> ''
  UNION SELECT DISTINCT service || '/app', 'ruby', 'app' FROM n WHERE service <> ''),
a AS (SELECT file FROM f UNION ALL SELECT root || '/go.mod' FROM m WHERE langs <> 'ruby' UNION ALL SELECT root || '/package.json' FROM m WHERE langs = 'go,javascript' UNION ALL SELECT root || '/Gemfile' FROM m WHERE langs = 'ruby')
SELECT m.root, m.name, m.langs, count(*) AS n_files FROM a JOIN m ON m.root = (SELECT arg_max(x.root, length(x.root)) FROM m x WHERE starts_with(a.file, x.root || '/')) GROUP BY 1, 2, 3""")
def discovered_services(spark, sf_dir):
    """Services of a tree by their manifests: one for each service's folder, and one for the app folder in it."""
    n = nodes(spark, sf_dir).filter("service <> ''")
    files = n.filter("file <> ''").selectExpr("concat(service, '/', file) AS file").distinct()
    s = n.select("service").distinct()
    manifests = s.selectExpr("explode(CASE WHEN length(service) % 2 = 0 THEN array(concat(service, '/go.mod'), concat(service, '/package.json'), concat(service, '/app/Gemfile')) ELSE array(concat(service, '/go.mod'), concat(service, '/app/Gemfile')) END) AS file")
    return L.discovered_services(files.unionByName(manifests)).select("root", "name", "langs", "n_files")


@query(W + """, v AS (SELECT DISTINCT service, lang AS tool, line % 7 AS maj, line % 3 AS mi FROM n WHERE service <> '' AND lang <> ''), r AS (SELECT lang AS tool, m, p FROM (SELECT DISTINCT lang FROM n WHERE lang <> ''), (VALUES ([2, 0], 'two'), ([4, 1], 'four'), ([4, 2], 'later')) x(m, p)),
b AS (SELECT v.*, coalesce(max((m, p)) FILTER (m <= [maj, mi]), min((m, p))) AS b FROM v JOIN r ON r.tool = v.tool GROUP BY ALL)
SELECT service, tool, 'v' || maj || '.' || mi || '.0' AS version, b[2] AS profile, b[1] <> [maj, mi] AS inferred FROM b""")
def toolchain_profiles(spark, sf_dir):
    """Rule profiles for the versions that services use."""
    n = nodes(spark, sf_dir).filter("service <> '' AND lang <> ''")
    versions = n.selectExpr("service", "lang AS tool", "concat('v', line % 7, '.', line % 3, '.0') AS version").distinct()
    profiles = F.explode(F.array(*(F.struct(F.lit(v).alias("version"), F.lit(p).alias("profile")) for v, p in (("2.0", "two"), ("4.1", "four"), ("4.2", "later")))))
    registry = n.select(F.col("lang").alias("tool")).distinct().select("tool", profiles.alias("r")).select("tool", "r.*")
    return L.selected_profiles(versions, registry)


_IMPORTS = """, f AS (SELECT DISTINCT service, file, regexp_replace(file, '[^/]*$', '') AS d, regexp_replace(regexp_extract(file, '([^/]*)$'), '\\.[^./]+$', '') AS b, regexp_extract(file, '\\.([^./]+)$', 1) AS x FROM n WHERE file <> '' AND service <> ''),
a AS (SELECT service, d || 'sub/caller.ts' AS file, '../' || b AS target, d || b AS stem FROM f UNION ALL SELECT service, d || 'main.ts', './' || b, d || b FROM f WHERE length(b) % 2 = 0 UNION ALL SELECT service, d || 'main.ts', './no_' || b, d || 'no_' || b FROM f WHERE length(b) % 5 = 0),
t AS (SELECT a.*, (SELECT arg_min(f.file, list_position(['ts', 'tsx', 'js', 'jsx', 'rb', 'py', 'go'], f.x)) FROM f WHERE f.service = a.service AND f.d || f.b = a.stem) AS found FROM (SELECT DISTINCT * FROM a) a)"""


def _imports(spark, sf_dir):
    f = nodes(spark, sf_dir).filter("file <> '' AND service <> ''").selectExpr("service", "file", "regexp_replace(file, '[^/]*$', '') AS d", "regexp_replace(regexp_extract(file, '([^/]*)$', 1), '[.][^./]+$', '') AS b").distinct()
    asked = f.selectExpr("service", "concat(d, 'sub/caller.ts') AS file", "concat('../', b) AS target").unionByName(f.filter("length(b) % 2 = 0").selectExpr("service", "concat(d, 'main.ts') AS file", "concat('./', b) AS target"))
    asked = asked.unionByName(f.filter("length(b) % 5 = 0").selectExpr("service", "concat(d, 'main.ts') AS file", "concat('./no_', b) AS target"))
    outside = f.selectExpr("service", "concat(d, 'main.ts') AS file", "b AS target")
    return L.import_targets(asked.unionByName(outside).withColumn("line", F.lit(1)), f.select("service", "file"))


@query(W + _IMPORTS + " SELECT DISTINCT service || ':' || file || ':file' AS src, service || ':' || found || ':file' AS dst FROM t WHERE found IS NOT NULL")
def import_targets(spark, sf_dir):
    """Imports of relative paths to the files that they mean."""
    return _imports(spark, sf_dir)[0].select("src", "dst")


@query(W + _IMPORTS + " SELECT service, file, target AS name FROM t WHERE found IS NULL")
def imports_unresolved(spark, sf_dir):
    """Imports of files that are not there."""
    return _imports(spark, sf_dir)[1].select("service", "file", "name")


@query(W + """, o AS (SELECT id, service, label, line, CASE WHEN line % 2 = 0 THEN label ELSE label END AS c FROM n WHERE type IN ('class', 'struct') AND regexp_full_match(label, '[A-Z][a-z]+') AND service <> '')
SELECT DISTINCT o.id AS src, n.id AS dst FROM o JOIN n ON n.service = o.service AND n.label = o.label AND n.type IN ('class', 'struct')""")
def association_targets(spark, sf_dir):
    """Classes to those that an association in snake case, of one or of many, names: here their own names."""
    n = nodes(spark, sf_dir)
    held = n.filter("type IN ('class', 'struct') AND label RLIKE '^[A-Z][a-z]+$' AND service <> ''")
    plural = "CASE WHEN label RLIKE 'y$' THEN regexp_replace(lower(label), 'y$', 'ies') WHEN label RLIKE '(s|x|z|ch|sh)$' THEN concat(lower(label), 'es') ELSE concat(lower(label), 's') END"
    owners = held.selectExpr("id", "service", "file", "line", "CASE WHEN line % 2 = 0 THEN 'has_many' ELSE 'belongs_to' END AS kind", f"CASE WHEN line % 2 = 0 THEN {plural} ELSE lower(label) END AS name", "'' AS class_name")
    return L.associations(owners, n.filter("type IN ('class', 'struct')"))[0].select("src", "dst")


_RECEIVERS = """, m AS (SELECT id, service, meta['class'] AS class, label AS name FROM n WHERE type = 'method' AND coalesce(meta['class'], '') <> ''), t AS (SELECT DISTINCT service, file AS scope, lower(class) AS receiver, class FROM (SELECT service, file, meta['class'] AS class FROM n WHERE type = 'method' AND coalesce(meta['class'], '') <> '')
  UNION SELECT DISTINCT service, file, lower(meta['class']), 'Other' FROM n WHERE type = 'method' AND coalesce(meta['class'], '') <> '' AND line % 4 = 0),
c AS (SELECT 'c:' || id AS id, service, file AS scope, lower(meta['class']) AS receiver, CASE WHEN line % 3 = 0 THEN 'none' ELSE label END AS name FROM n WHERE type = 'method' AND coalesce(meta['class'], '') <> ''),
z AS (SELECT service, scope, receiver, count(*) AS k FROM t GROUP BY 1, 2, 3)"""


def _receivers(spark, sf_dir):
    held = nodes(spark, sf_dir).filter("type = 'method' AND coalesce(try_element_at(meta, 'class'), '') <> ''").withColumn("class", F.expr("meta['class']"))
    types = held.selectExpr("service", "file AS scope", "lower(class) AS receiver", "class").unionByName(held.filter("line % 4 = 0").selectExpr("service", "file AS scope", "lower(class) AS receiver", "'Other' AS class"))
    calls = held.selectExpr("concat('c:', id) AS id", "service", "file", "line", "file AS scope", "lower(class) AS receiver", "CASE WHEN line % 3 = 0 THEN 'none' ELSE label END AS name")
    return L.receiver_calls(calls, types, held.select("id", "service", "class", "label"))


@query(W + _RECEIVERS + " SELECT DISTINCT c.id AS src, m.id AS dst, CASE WHEN z.k > 1 THEN 'partial' ELSE 'inferred' END AS confidence FROM c JOIN t USING (service, scope, receiver) JOIN z USING (service, scope, receiver) JOIN m ON m.service = c.service AND m.class = t.class AND m.name = c.name")
def receiver_calls(spark, sf_dir):
    """Calls to the methods of their receiver's types."""
    return _receivers(spark, sf_dir)[0].select("src", "dst", "confidence")


@query(W + _RECEIVERS + " SELECT c.service, c.scope AS file, count(*) AS n FROM c WHERE NOT EXISTS (SELECT 1 FROM t JOIN m ON m.service = t.service AND m.class = t.class WHERE t.service = c.service AND t.scope = c.scope AND t.receiver = c.receiver AND m.name = c.name) GROUP BY 1, 2")
def receivers_unresolved(spark, sf_dir):
    """Calls whose receiver's type has no such method."""
    return _receivers(spark, sf_dir)[1].groupBy("service", "file").agg(F.count("*").alias("n"))
