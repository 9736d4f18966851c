"""Links that are made from what extraction left in node fields: each is a few joins over the node and edge tables.

Where a link has to choose, all candidates of the best rank count, and what
cannot be resolved comes back as ledger rows (``service``, ``file``, ``line``,
``name``, ``kind``) instead of being dropped.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowskein.functions.predicates import given, is_test_file, meta
from flowskein.functions.scalars import env_var_name, service_hint
from flowskein.operators import traversal as T
from flowskein.operators.linking import edge, similar_sets

#: Keys of an options object that may hold its URL, in order.
URL_KEYS = ("url", "uri", "path", "endpoint")


def _ledger(rows: DataFrame, name: Column, kind: str) -> DataFrame:
    return rows.select("service", "file", "line", name.alias("name"), F.lit(kind).alias("kind"))


def _pattern(nodes: DataFrame, *names: str) -> DataFrame:
    return nodes.filter(meta("meta", "pattern").isin(*names))


def grpc_methods(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Registered gRPC services to all methods of the type that implements them; the ledger of those without.

    The type is read off the registration's ``impl``: ``&T{...}``, ``T{...}`` or ``new(T)``.
    """
    bare = F.regexp_extract(meta("meta", "impl"), r"^\s*(?:&?\s*(?:\w+\.)*([A-Za-z_]\w*)\s*\{|new\(\s*(?:\w+\.)*([A-Za-z_]\w*)\s*\))", 1)
    made = F.regexp_extract(meta("meta", "impl"), r"^\s*new\(\s*(?:\w+\.)*([A-Za-z_]\w*)\s*\)", 1)
    registered = _pattern(nodes, "grpc_server_register").withColumn("type_name", F.when(bare != "", bare).otherwise(made)).withColumn("receiver", F.lower("type_name"))
    receiver = F.lower(F.regexp_replace(meta("meta", "receiver"), r"^\*", ""))
    methods = nodes.filter("type = 'method'").select("service", receiver.alias("receiver"), F.col("id").alias("m_id")).filter("receiver <> ''")
    joined = registered.join(methods, ["service", "receiver"], "left")
    name = F.when(F.col("type_name") != "", F.col("type_name")).otherwise(meta("meta", "impl"))
    return joined.filter("m_id IS NOT NULL").select(*edge("calls", F.col("id"), F.col("m_id"), "calls")), _ledger(joined.filter("m_id IS NULL"), name, "grpc_impl_unresolved")


def route_components(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Routes to the component they name, in their service: the first function, method or component of that label by id."""
    named = nodes.filter("type = 'route'").withColumn("label", meta("meta", "component")).filter("label <> ''")
    targets = nodes.filter("type IN ('function', 'method', 'component')").groupBy("service", "label").agg(F.min("id").alias("t_id"))
    joined = named.join(targets, ["service", "label"], "left")
    return joined.filter("t_id IS NOT NULL").select(*edge("renders", F.col("id"), F.col("t_id"), "renders", "inferred")), _ledger(joined.filter("t_id IS NULL"), F.col("label"), "component_ref")


def template_twins(nodes: DataFrame) -> DataFrame:
    """Generated functions of ``x_templ.go`` to the component of that label in ``x.templ`` beside it."""
    made = nodes.filter("type = 'function' AND lang = 'go' AND file LIKE '%\\\\_templ.go'").groupBy("file", "label").agg(F.min("id").alias("f_id"))
    shown = nodes.filter("type = 'component' AND lang = 'templ' AND file LIKE '%.templ'").select("id", "label", F.regexp_replace("file", r"\.templ$", "_templ.go").alias("file"))
    return shown.join(made, ["file", "label"]).select(*edge("component_impl", F.col("f_id"), F.col("id"), "component_impl"))


def resource_signals(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """HTTP clients to the resources whose loader calls them: (service, file, loader) to its function, then its calls."""
    loaders = nodes.filter("type IN ('function', 'method')").groupBy("service", "file", "label").agg(F.min("id").alias("f_id"))
    held = nodes.withColumn("label", meta("meta", "resource_fn")).filter("label <> ''").select("service", "file", "label", F.col("id").alias("r_id"))
    clients = nodes.filter("type = 'http_client'").select(F.col("id").alias("dst"))
    called = edges.filter("type = 'calls'").select(F.col("src").alias("f_id"), "dst").join(clients, "dst", "left_semi")
    return held.join(loaders, ["service", "file", "label"]).join(called, "f_id").select(*edge("flows_to", F.col("dst"), F.col("r_id"), "flows_to", "inferred")).distinct()


def event_stream_handlers(nodes: DataFrame) -> DataFrame:
    """Event sources to the message handlers of their file."""
    source = _pattern(nodes, "eventsource_connect").select("file", F.col("id").alias("c_id"))
    handlers = _pattern(nodes.filter("type = 'subscriber'"), "ws_onmessage_assign", "ws_on_message")
    return handlers.join(source, "file").select(*edge("sse", F.col("c_id"), F.col("id"), "subscribes", "inferred"))


def event_stream_pushes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Calls of event sources turned around: what flows is what the handler writes."""
    source = _pattern(nodes, "eventsource_connect").select(F.col("id").alias("src"))
    calls = edges.filter("type = 'http_call'").select("src", "dst").join(source, "src", "left_semi")
    return calls.select(*edge("sse_push", F.col("dst"), F.col("src"), "sse_endpoint", "inferred")).distinct()


def broker_hints(nodes: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Publishers and subscribers to the channels of the exchanges that ``links`` (``src``, ``dst``, ``exchange``) say they use.

    A publisher without an exchange of its own is eligible for the links that
    leave its service, a subscriber for those that enter it. What it names (its
    exchange, or those of its queue in the service) decides: one match is
    static, several are partial; without evidence one eligible link is taken;
    all else is ledger. An exchange's real channels, of the sending service or
    else the receiving one, come before the made-up node ``broker:channel:x``.
    Returns new nodes, edges and ledger rows.
    """
    plain = lambda c: F.btrim(c, F.lit("\"'`"))
    rules = links.select(F.col("src").alias("l_src"), F.col("dst").alias("l_dst"), "exchange").filter("exchange <> ''").distinct()
    own = plain(meta("meta", "exchange"))
    ends = _pattern(nodes.filter("type IN ('publisher', 'subscriber')"), "amqp_publish", "amqp_consume", "amqp_subscribe").select("id", "type", "service", "file", "line", "label", own.alias("own"), plain(meta("meta", "queue")).alias("queue"))
    out = ends.filter("type = 'publisher' AND own = ''").join(rules, F.col("service") == F.col("l_src"))
    into = ends.filter("type = 'subscriber'").join(rules, F.col("service") == F.col("l_dst"))
    eligible = out.unionByName(into)
    queues = nodes.select("service", plain(meta("meta", "queue")).alias("queue"), own.alias("named")).filter("queue <> '' AND named <> ''").distinct()
    evidence = ends.filter("own <> ''").select("id", F.col("own").alias("named")).unionByName(ends.filter("queue <> ''").join(queues, ["service", "queue"]).select("id", "named")).distinct()
    told = evidence.select("id").distinct().withColumn("__told", F.lit(True))
    matched = eligible.join(evidence.withColumn("__hit", F.lit(True)), (eligible["id"] == evidence["id"]) & (eligible["exchange"] == evidence["named"]), "left").select(eligible["*"], "__hit").join(told, "id", "left")
    sizes = matched.groupBy("id").agg(F.count("__hit").alias("__hits"), F.count("*").alias("__all"))
    judged = matched.join(sizes, "id").withColumn("__take", F.coalesce("__hit", F.lit(False)) | (F.col("__told").isNull() & (F.col("__all") == 1)))
    taken = judged.filter("__take").withColumn("confidence", F.when(F.col("__hits") > 1, "partial").otherwise("static"))
    lost = judged.join(taken.select("id").distinct(), "id", "left_anti").dropDuplicates(["id"])
    # an exchange's own node, without a routing key, comes before those of its keys
    real = nodes.filter("type = 'channel'").select("service", own.alias("exchange"), F.col("id").alias("c_id"), (plain(meta("meta", "routing_key")) != "").cast("int").alias("keyed")).filter("exchange <> ''")
    first = real.groupBy("service", "exchange").agg(F.min("keyed").alias("keyed"))
    real = real.join(first, ["service", "exchange", "keyed"]).select("service", "exchange", "c_id")
    at = lambda side, rank: taken.join(real.withColumnRenamed("service", side), [side, "exchange"]).select("id", "exchange", "l_src", "l_dst", "c_id", F.lit(rank).alias("__r"))
    met = at("l_src", 0).unionByName(at("l_dst", 1))
    best = met.groupBy("id", "exchange", "l_src", "l_dst").agg(F.min("__r").alias("__r"))
    chosen = taken.join(met.join(best, ["id", "exchange", "l_src", "l_dst", "__r"]).drop("__r"), ["id", "exchange", "l_src", "l_dst"], "left")
    channel = F.coalesce("c_id", F.concat(F.lit("broker:channel:"), "exchange"))
    ways = F.when(F.col("type") == "publisher", F.struct(F.col("id").alias("a"), channel.alias("b"), F.lit("publishes").alias("t"))).otherwise(F.struct(channel.alias("a"), F.col("id").alias("b"), F.lit("subscribes").alias("t")))
    edges = chosen.withColumn("w", ways).select(F.concat("w.t", F.lit(":hint:"), "w.a", F.lit("->"), "w.b").alias("id"), F.col("w.a").alias("src"), F.col("w.b").alias("dst"), F.col("w.t").alias("type"), "confidence").distinct()
    new = chosen.filter("c_id IS NULL").groupBy("exchange").agg(F.min("l_src").alias("service")).select(F.concat(F.lit("broker:channel:"), "exchange").alias("id"), F.lit("channel").alias("type"), F.col("exchange").alias("label"), "service")
    return new, edges, _ledger(lost, F.when(F.col("label") != "", F.col("label")).otherwise(F.col("id")), "amqp_exchange_unresolved")


def response_shapes(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Structs that a ``returns`` edge makes responses, and interfaces of other languages of like field names.

    A field's name is that of its JSON tag, else its own; ``-`` is none. Returns
    pairs of classes and both memberships, as ``similar_sets``: at least two
    names in common and a Jaccard of 0.8.
    """
    listed = F.from_json(meta("meta", "fields"), "array<struct<name:string,tag:string>>")
    tag = lambda x: F.regexp_extract(given(x["tag"]), r'json:"([^",]*)', 1)
    names = F.filter(F.transform(listed, lambda x: F.when(tag(x) == "-", "").when(tag(x) != "", tag(x)).otherwise(given(x["name"]))), lambda x: x != "")
    returned = edges.filter("type = 'returns'").select(F.col("dst").alias("id")).distinct()
    left = nodes.filter("type = 'struct' AND lang = 'go'").join(returned, "id", "left_semi").select("id", names.alias("items"))
    members = F.filter(F.transform(F.split(meta("meta", "methods"), ","), lambda x: F.trim(x)), lambda x: x != "")
    right = nodes.filter("type = 'interface' AND lang <> 'go'").select("id", members.alias("items"))
    return similar_sets(left, right)


def inferred_links(ledger: DataFrame, nodes: DataFrame, services: DataFrame) -> DataFrame:
    """Links to propose: ``src``, ``dst``, ``via``, ``hint``.

    A dynamic URL that reads an environment variable points to the services
    (``name``: configuration) whose name holds the variable's, or the other way
    round, without regard to case and separators; services come to the driver,
    as the settings of a workspace they are few. Services whose channels share
    an exchange are linked both ways; test files do not count. Channels are
    brought down to their services first.
    """
    bare = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    asked = ledger.filter("kind = 'dynamic_url'").select("service", env_var_name(F.col("name")).alias("var")).withColumn("hint", service_hint(F.col("var"))).filter("hint <> ''").distinct()
    names = [r["name"] for r in services.select("name").filter("name <> ''").distinct().collect()]  # configuration
    fits = F.filter(F.from_json(F.lit(json.dumps(names)), "array<string>"), lambda s: bare(s).contains(bare(F.col("hint"))) | bare(F.col("hint")).contains(bare(s)))
    near = asked.select("service", "var", F.explode(fits).alias("dst"))
    by_var = near.filter("dst <> service").groupBy(F.col("service").alias("src"), "dst").agg(F.min("var").alias("hint")).withColumn("via", F.lit("http"))
    used = nodes.filter("type = 'channel'").filter(~is_test_file(F.col("file"))).select("service", F.btrim(meta("meta", "exchange"), F.lit("\"'")).alias("hint")).filter("hint <> '' AND service <> ''").distinct()
    shared = used.withColumnRenamed("service", "src").join(used.withColumnRenamed("service", "dst"), "hint").filter("src <> dst").withColumn("via", F.lit("broker"))
    return by_var.select("src", "dst", "via", "hint").unionByName(shared.select("src", "dst", "via", "hint"))


def middleware(routers: DataFrame, uses: DataFrame, routes: DataFrame, via: str = "gin_middleware_use") -> DataFrame:
    """Routes to the middlewares in front of them.

    ``routers``: ``router``, ``parent`` ('' for none); ``uses``: ``router``,
    ``fn``, ``line``; ``routes``: ``id``, ``router``, ``line``. A middleware of
    an enclosing router holds for all its groups, one of the same router for the
    routes that are registered after it. Groups nest to any depth; a cycle of
    groups ends by what was seen.
    """
    up = routers.filter("parent <> ''").select(F.concat_ws(">", "router", "parent").alias("id"), F.col("router").alias("src"), F.col("parent").alias("dst"), F.lit("group").alias("type"))
    seeds = routes.select(F.col("router").alias("root_id"), F.col("router").alias("node_id")).distinct()
    around = T.traverse(up, seeds).select(F.col("root_id").alias("router"), F.col("node_id").alias("holder"), "depth").unionByName(seeds.select(F.col("root_id").alias("router"), F.col("node_id").alias("holder"), F.lit(0).alias("depth")))
    used = uses.select(F.col("router").alias("holder"), "fn", F.col("line").alias("use_line"))
    hit = routes.join(around, "router").join(used, "holder").filter((F.col("depth") > 0) | (F.col("use_line") < F.col("line")))
    return hit.select(*edge("middleware", F.col("id"), F.col("fn"), "calls"), F.lit(via).alias("via")).distinct()


def class_filters(parents: DataFrame, filters: DataFrame, skips: DataFrame, actions: DataFrame) -> DataFrame:
    """Actions to the filters in front of them, along the superclass chain, less what is skipped.

    ``parents``: ``class``, ``parent``; ``filters`` and ``skips``: ``class``,
    ``callback``, ``only``, ``except`` (arrays, null or empty for none);
    ``actions``: ``class``, ``action``. A filter holds for the actions of its
    class and of all that inherit from it; a skip takes it off for those of its
    class and below. ``inherited_from`` names the class that declares it, ''
    for the action's own.
    """
    up = parents.select(F.concat_ws(">", "class", "parent").alias("id"), F.col("class").alias("src"), F.col("parent").alias("dst"), F.lit("inherits").alias("type"))
    seeds = actions.select(F.col("class").alias("root_id"), F.col("class").alias("node_id")).distinct()
    chain = T.traverse(up, seeds).select(F.col("root_id").alias("class"), F.col("node_id").alias("holder")).unionByName(seeds.select(F.col("root_id").alias("class"), F.col("node_id").alias("holder")))
    named = lambda c: F.coalesce(c, F.expr("cast(array() AS array<string>)"))

    def holding(rules: DataFrame) -> DataFrame:
        held = rules.select(F.col("class").alias("holder"), "callback", named(F.col("only")).alias("__o"), named(F.col("except")).alias("__e"))
        met = actions.join(chain, "class").join(held, "holder")
        return met.filter(((F.size("__o") == 0) | F.array_contains("__o", F.col("action"))) & ~F.array_contains("__e", F.col("action"))).drop("__o", "__e")

    kept = holding(filters).join(holding(skips).select("class", "action", "callback").distinct(), ["class", "action", "callback"], "left_anti")
    origin = F.when(F.col("holder") == F.col("class"), "").otherwise(F.col("holder"))
    return kept.select("class", "action", "callback", origin.alias("inherited_from"), F.when(origin == "", "static").otherwise("inferred").alias("confidence")).distinct()


def asset_imports(imports: DataFrame, files: DataFrame, exts: tuple[str, ...] = ("scss", "sass", "css")) -> tuple[DataFrame, DataFrame]:
    """Stylesheet imports to the file they mean; the ledger of those that mean none.

    ``imports``: ``service``, ``file``, ``line``, ``target``; ``files``:
    ``service``, ``file``. A target is looked for beside the importing file and
    from the root, as it stands, with each extension, as a partial (``_name``)
    and as a folder's index; the first that exists counts. URLs are left out.
    """
    folder = F.regexp_replace(F.col("file"), r"[^/]*$", "")
    clean = F.regexp_replace(F.col("target"), r"^\./", "")
    head, tail = F.regexp_replace(clean, r"[^/]*$", ""), F.regexp_extract(clean, r"([^/]*)$", 1)

    def flat(path: Column) -> Column:
        """ "a/b/../c/" is "a/c/"; three steps up at most beside one another."""
        for pattern, by in ((r"(^|/)\./", "$1"), *[(r"[^/.][^/]*/\.\./", "")] * 3):
            path = F.regexp_replace(path, pattern, by)
        return path

    local = imports.filter(~F.col("target").rlike(r"^(?:https?:)?//|^url\(")).withColumn("__id", F.struct("service", "file", "line", "target"))
    local = local.withColumn("__dirs", F.array(flat(F.concat(folder, head)), flat(head))).withColumn("__tail", tail)
    ends = [("", "")] + [x for e in exts for x in (("", f".{e}"), ("_", f".{e}"), ("", f"/_index.{e}"), ("", f"/index.{e}"))]
    shapes = F.array(*(F.struct(F.lit(before).alias("b"), F.lit(after).alias("a")) for before, after in ends))
    tried = F.flatten(F.transform("__dirs", lambda d: F.transform(shapes, lambda x: F.concat(d, x["b"], F.col("__tail"), x["a"]))))
    each = local.select("__id", "service", F.posexplode(tried).alias("__rank", "path"))
    met = each.join(files.select("service", F.col("file").alias("path")).distinct(), ["service", "path"]).groupBy("__id").agg(F.min(F.struct("__rank", "path")).alias("b"))
    joined = local.select("__id").distinct().join(met, "__id", "left").select("__id.*", F.col("b.path").alias("found"))
    links = joined.filter("found IS NOT NULL").select("service", "file", "line", "target", "found")
    return links, _ledger(joined.filter("found IS NULL"), F.col("target"), "asset_unresolved")


def wrapper_calls(wrappers: DataFrame, calls: DataFrame) -> DataFrame:
    """Call sites of wrappers around an HTTP client, as clients themselves.

    ``wrappers``: ``service``, ``file``, ``name``, ``method``, ``base_url``;
    ``calls``: ``service``, ``file``, ``line``, ``name``, ``arg``. A wrapper of
    the file counts before those of the service; of several in the service none
    is guessed.
    """
    w = wrappers.select("service", F.col("file").alias("w_file"), "name", "method", "base_url").distinct()
    lone = w.groupBy("service", "name").agg(F.count("*").alias("n"), F.min(F.struct("method", "base_url")).alias("w")).filter("n = 1").select("service", "name", "w")
    own = w.groupBy("service", F.col("w_file").alias("file"), "name").agg(F.min(F.struct("method", "base_url")).alias("o"))
    found = calls.join(own, ["service", "file", "name"], "left").join(lone, ["service", "name"], "left").withColumn("x", F.coalesce("o", "w")).filter("x IS NOT NULL")
    url = F.concat(F.regexp_replace(given(F.col("x.base_url")), "/+$", ""), given(F.col("arg")))
    return found.select(F.concat_ws(":", "service", "file", F.lit("http_client"), "name", "line").alias("id"), F.lit("http_client").alias("type"), "service", "file", "line", F.lower(given(F.col("x.method"))).alias("method"), url.alias("url"))


def picked_candidates(candidates: DataFrame, url_keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the fields of an options object at one call site the one that is the URL; the ledger of call sites where none is known to be.

    ``candidates``: ``id``, ``service``, ``file``, ``line``, ``key``, ``via``;
    ``url_keys``: ``service``, ``file``, ``via``, ``key``, what a wrapper's body
    says. First that key, then the usual names in order, else the first by id,
    reported as ambiguous.
    """
    told = url_keys.groupBy("service", "file", "via").agg(F.min("key").alias("__key"))
    usual = F.coalesce(*(F.when(F.col("key") == k, i + 1) for i, k in enumerate(URL_KEYS)), F.lit(len(URL_KEYS) + 1))
    ranked = candidates.join(told, ["service", "file", "via"], "left").withColumn("__rank", F.when(F.col("key") == F.col("__key"), 0).otherwise(usual))
    place = W.partitionBy("service", "file", "line")
    first = ranked.withColumn("__n", F.count("*").over(place)).withColumn("__r", F.row_number().over(place.orderBy("__rank", "id"))).filter("__r = 1")
    unsure = first.filter((F.col("__n") > 1) & (F.col("__rank") == len(URL_KEYS) + 1))
    return first.select("id", "service", "file", "line", "key"), _ledger(unsure, F.col("id"), "ambiguous_url_key")


def resolved_hosts(clients: DataFrame, constants: DataFrame, links: DataFrame) -> DataFrame:
    """Host and target service of clients whose host is a constant or variable.

    ``clients``: ``id``, ``service``, ``name``; ``constants``: ``service``,
    ``name``, ``value``, ``ref`` (another name, '' for a literal). References
    are followed to their ends, however many; several literals, none, or a cycle
    leave the host ''. ``links`` (``host``, ``target``) name the services.
    """
    key = lambda c: F.concat_ws("\u0001", "service", c)
    steps = constants.filter("ref <> ''").select(F.concat_ws(">", key("name"), key("ref")).alias("id"), key("name").alias("src"), key("ref").alias("dst"), F.lit("ref").alias("type"))
    seeds = clients.select(key("name").alias("root_id"), key("name").alias("node_id")).distinct()
    ends = T.traverse(steps, seeds).select("root_id", "node_id").unionByName(seeds)
    literal = constants.filter("ref = '' AND value <> ''").select(key("name").alias("node_id"), "value").distinct()
    held = ends.join(literal, "node_id").groupBy("root_id").agg(F.countDistinct("value").alias("n"), F.min("value").alias("value")).filter("n = 1")
    host = F.regexp_replace(F.regexp_replace("value", r"^[a-z]+://", ""), r"[:/].*$", "")
    named = held.select(F.col("root_id").alias("__k"), host.alias("host")).join(links.groupBy("host").agg(F.min("target").alias("target")), "host", "left")
    return clients.withColumn("__k", key("name")).join(named, "__k", "left").select("id", given(F.col("host")).alias("host"), given(F.col("target")).alias("target_service"))


# Manifests by language.
MANIFESTS = {"go.mod": "go", "package.json": "javascript", "Gemfile": "ruby", "pyproject.toml": "python", "requirements.txt": "python"}


def discovered_services(files: DataFrame) -> DataFrame:
    """Services by their manifests: ``root`` (folder), ``name`` (its last part), ``langs``, and the files of which it is the nearest root.

    ``files``: ``file``. A folder with several manifests is one service.
    """
    base, folder = F.regexp_extract("file", r"([^/]*)$", 1), F.regexp_replace(F.regexp_replace("file", r"[^/]*$", ""), "/$", "")
    kind = F.coalesce(*(F.when(base == m, lang) for m, lang in MANIFESTS.items()))
    roots = files.select(folder.alias("root"), kind.alias("lang")).filter("lang IS NOT NULL").groupBy("root").agg(F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("langs"))
    parts = F.split("file", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    near = files.select("file", F.explode(above).alias("root")).join(roots.select("root"), "root").groupBy("file").agg(F.max(F.struct(F.length("root").alias("n"), "root"))["root"].alias("root"))
    return roots.join(near.groupBy("root").agg(F.count("*").alias("n_files")), "root").select("root", F.regexp_extract("root", r"([^/]*)$", 1).alias("name"), "langs", "n_files")


def version_key(version: Column) -> Column:
    """Versions as arrays of three numbers: they compare part by part."""
    number = F.regexp_extract_all(F.regexp_replace(version, r"^[^0-9]*", ""), F.lit(r"[0-9]+"), F.lit(0))
    return F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.coalesce(F.get(number, i).try_cast("int"), F.lit(0)))


def selected_profiles(versions: DataFrame, registry: DataFrame) -> DataFrame:
    """Rule profile of each tool's version: the same one, else the newest below, else the oldest; ``inferred`` unless the same.

    ``versions``: ``service``, ``tool``, ``version``; ``registry``: ``tool``,
    ``version``, ``profile``, configuration of few rows a tool.
    """
    asked = versions.withColumn("__v", version_key(F.col("version")))
    known = registry.select("tool", version_key(F.col("version")).alias("__p"), "profile")
    met = asked.join(known, "tool", "left").withColumn("__below", F.col("__p") <= F.col("__v"))
    below = F.max(F.when(F.col("__below"), F.struct("__p", "profile")))
    oldest = F.min(F.struct("__p", "profile"))
    best = met.groupBy("service", "tool", "version", "__v").agg(F.coalesce(below, oldest).alias("b"))
    return best.select("service", "tool", "version", F.col("b.profile").alias("profile"), (~F.coalesce(F.col("b.__p") == F.col("__v"), F.lit(False))).alias("inferred"))


def import_targets(imports: DataFrame, files: DataFrame, exts: tuple[str, ...] = ("ts", "tsx", "js", "jsx", "rb", "py", "go")) -> tuple[DataFrame, DataFrame]:
    """Imports of relative paths to the files they mean, as edges between files; the ledger of those that mean none.

    As ``asset_imports``, with the extensions of code; names of packages (no
    leading dot) are left out, for they are no files of the tree.
    """
    local = imports.filter(F.col("target").startswith("."))
    found, lost = asset_imports(local, files, exts)
    at = lambda c: F.concat_ws(":", "service", c, F.lit("file"))
    return found.select(*edge("imports", at("file"), at("found"), "imports")).distinct(), lost.withColumn("kind", F.lit("import_unresolved"))


def class_name(association: Column, many: Column) -> Column:
    """Class that an association names: singular if it is of many, words joined with capitals."""
    one = F.when(many & association.rlike("ies$"), F.regexp_replace(association, "ies$", "y")).when(many & association.rlike("(s|x|z|ch|sh)es$"), F.regexp_replace(association, "es$", "")).when(many, F.regexp_replace(association, "s$", "")).otherwise(association)
    return F.array_join(F.transform(F.split(one, "_"), lambda w: F.initcap(w)), "")


def associations(owners: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes to the classes that their associations name, in their service; the ledger of those that are not there.

    ``owners``: ``id``, ``service``, ``file``, ``line``, ``kind`` (belongs_to,
    has_one, has_many ...), ``name``, and ``class_name`` ('' if it is not
    told); ``classes``: ``id``, ``service``, ``label``. All classes of the name count.
    """
    many = F.col("kind").isin("has_many", "has_and_belongs_to_many")
    named = owners.withColumn("label", F.when(given(F.col("class_name")) != "", F.col("class_name")).otherwise(class_name(F.col("name"), many)))
    joined = named.join(classes.select(F.col("id").alias("c_id"), "service", "label"), ["service", "label"], "left")
    return joined.filter("c_id IS NOT NULL").select(*edge("association", F.col("id"), F.col("c_id"), "uses_type", "inferred")).distinct(), _ledger(joined.filter("c_id IS NULL"), F.col("label"), "association_unresolved")


def receiver_calls(calls: DataFrame, types: DataFrame, methods: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Method calls to the methods of their receiver's type; the ledger of those whose receiver's type is known but has none.

    ``calls``: ``id``, ``service``, ``file``, ``line``, ``scope``, ``receiver``,
    ``name``; ``types``: ``service``, ``scope``, ``receiver``, ``class``, what
    assignments and parameters say; a receiver of several types calls all of
    them, which makes it partial. ``methods``: ``id``, ``service``, ``class``, ``label``.
    """
    known = types.select("service", "scope", "receiver", "class").distinct()
    size = known.groupBy("service", "scope", "receiver").agg(F.count("*").alias("__types"))
    typed = calls.join(known, ["service", "scope", "receiver"]).join(size, ["service", "scope", "receiver"])
    m = methods.select(F.col("id").alias("m_id"), "service", "class", F.col("label").alias("name"))
    joined = typed.join(m, ["service", "class", "name"], "left")
    found = joined.filter("m_id IS NOT NULL")
    lost = joined.join(found.select("id").distinct(), "id", "left_anti").dropDuplicates(["id"])
    return found.select(*edge("calls", F.col("id"), F.col("m_id"), "calls", F.when(F.col("__types") > 1, "partial").otherwise("inferred"))).distinct(), _ledger(lost, F.concat_ws(".", "class", "name"), "method_unresolved")
