"""Joins that link nodes to nodes: containment, as-of and range joins, similarity, hints."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from flowskein.functions.predicates import given, meta
from flowskein.functions.scalars import sql_table
from flowskein.session import Levels, materialize


def edge(prefix: str, src: Column, dst: Column, edge_type: str, confidence: Column | str = "static") -> list[Column]:
    conf = F.lit(confidence) if isinstance(confidence, str) else confidence
    return [F.concat(F.lit(prefix + ":"), src, F.lit("->"), dst).alias("id"), src.alias("src"), dst.alias("dst"), F.lit(edge_type).alias("type"), conf.alias("confidence")]


def containment(nodes: DataFrame) -> DataFrame:
    """Edges service to file, file to declaration, and class to its methods, from columns alone."""
    held = nodes.filter("service <> '' AND file <> '' AND type NOT IN ('service', 'file')")
    service, file = F.concat(F.lit("service:"), "service"), F.concat("service", F.lit(":"), "file", F.lit(":file"))
    files = held.select(service.alias("s"), file.alias("f")).distinct().select(*edge("contains", F.col("s"), F.col("f"), "contains"))
    decls = held.select(*edge("contains", file, F.col("id"), "contains"))
    methods = nodes.filter("type = 'method'").select(F.col("id").alias("m"), "service", F.regexp_replace(meta("meta", "class"), r"^\*", "").alias("label"), "file").filter("label <> ''")
    classes = nodes.filter("type IN ('class', 'struct')").select(F.col("id").alias("c"), "service", "label", "file")
    owned = methods.join(classes, ["service", "label", "file"]).select(*edge("contains", F.col("c"), F.col("m"), "contains"))
    return files.unionByName(decls).unionByName(owned)


def scanned_files(nodes: DataFrame, scanned: DataFrame) -> DataFrame:
    """Scanned files (``service``, ``file``) that declare nothing."""
    return scanned.join(nodes.select("service", "file").distinct(), ["service", "file"], "left_anti")


def datastores(nodes: DataFrame, call_types: tuple[str, ...], store_type: str) -> DataFrame:
    """Calls to the stores of their own service; several stores make it partial.

    The result is as large as the pairs of a service, as the rule demands.
    """
    stores = nodes.filter(F.col("type") == store_type).select("service", F.col("id").alias("store"))
    count = stores.groupBy("service").agg(F.count("*").alias("n"))
    calls = nodes.filter(F.col("type").isin(*call_types)).select("service", F.col("id").alias("call"))
    conf = F.when(F.col("n") > 1, "partial").otherwise("static")
    return calls.join(stores, "service").join(count, "service").select(*edge("store", F.col("call"), F.col("store"), "persists", conf))


def tables_of_queries(queries: DataFrame) -> DataFrame:
    """Table nodes and edges of SQL texts (``id``, ``service``, ``sql``): reads are queries, writes persist."""
    named = queries.withColumn("table", sql_table(F.col("sql"))).filter("table <> ''")
    kind = F.when(F.lower(F.btrim("sql")).rlike("^(insert|update|delete|replace)"), "persists").otherwise("queries")
    target = F.concat("service", F.lit(":table:"), "table")
    return named.select(F.concat(F.lit("table:"), "id", F.lit("->"), target).alias("id"), F.col("id").alias("src"), target.alias("dst"), kind.alias("type"))


def enclosing(points: DataFrame, spans: DataFrame, by: list[str], at: str, start: str, payload: str) -> DataFrame:
    """As-of join, backward: for each point the last span that starts at or before it.

    One union sorted within the key; the last non-null start is carried forward,
    so no pairs of points and spans are made. Ties take the greatest payload.
    """
    both = points.select(*by, F.col(at).alias("__at"), F.struct(*points.columns).alias("__p"), F.lit(None).cast(dict(spans.dtypes)[payload]).alias("__v")).unionByName(
        spans.select(*by, F.col(start).alias("__at"), F.lit(None).cast(points.select(F.struct(*points.columns).alias("s")).schema["s"].dataType).alias("__p"), F.col(payload).alias("__v"))
    )
    order = W.partitionBy(*by).orderBy("__at", F.col("__p").isNotNull(), "__v").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("enclosing", F.last("__v", ignorenulls=True).over(order)).filter("__p IS NOT NULL").select("__p.*", "enclosing")


def nearest_after(points: DataFrame, spans: DataFrame, by: list[str], at: str, start: str, payload: str) -> DataFrame:
    """As-of join, forward: for each point the first span that starts at or after it."""
    flip = lambda df, c: df.withColumn("__n", -F.col(c))
    return enclosing(flip(points, at), flip(spans, start), by, "__n", "__n", payload).drop("__n").withColumnRenamed("enclosing", "nearest")


def overlapping(hunks: DataFrame, nodes: DataFrame, bucket: int = 256) -> DataFrame:
    """Range join: nodes whose lines meet a changed span of their file.

    Both sides are cut into line buckets, so the join is an equi-join whose
    residual is the exact overlap; a pair counts once, in its first common bucket.
    """
    buckets = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bucket), F.floor(F.col(b) / bucket)))
    end = F.greatest("end_line", "line")
    left = hunks.withColumn("__b", buckets("start", "end"))
    right = nodes.filter("line > 0").select("service", "file", F.col("id").alias("node_id"), "line", end.alias("end_line")).withColumn("__b", buckets("line", "end_line"))
    met = left.join(right, ["service", "file", "__b"]).filter("line <= end AND start <= end_line")
    return met.filter(F.col("__b") == F.floor(F.greatest("start", "line") / bucket)).drop("__b")


def similar_sets(left: DataFrame, right: DataFrame, least_shared: int = 2, least_jaccard: float = 0.8) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs of classes (``l``, ``r``, ``shared``, ``jaccard``) and both memberships, by shared elements and Jaccard.

    Inputs: ``id``, ``items``; sets of fewer than two items never match. Equal
    sets are classes: only representatives are compared, on their rarest items
    (prefix filter), and members join their class after.
    """
    def classes(df: DataFrame) -> tuple[DataFrame, DataFrame]:
        named = df.select("id", F.array_sort(F.array_distinct("items")).alias("items")).filter(F.size("items") >= least_shared)
        keyed = named.withColumn("class", F.sha2(F.array_join("items", "\u0001"), 256))
        return keyed.select("id", "class"), keyed.groupBy("class").agg(F.any_value("items").alias("items"))

    (lm, lc), (rm, rc) = classes(left), classes(right)
    of_both = lc.select("class", "items", F.lit(True).alias("a"), F.lit(False).alias("b")).unionByName(rc.select("class", "items", F.lit(False).alias("a"), F.lit(True).alias("b")))
    known = of_both.groupBy("class").agg(F.any_value("items").alias("items"), F.max("a").alias("a"), F.max("b").alias("b"))
    sets, _ = materialize(_numbered(known), "sets")
    found, _ = materialize(_alike(sets, least_shared, least_jaccard, "a", "b"), "pairs")
    named = lambda name, side: sets.filter(side).select(F.col("set").alias(name), F.col("class").alias(f"{name}_class"))
    turned = found.select(F.col("r").alias("l"), F.col("l").alias("r"), "shared", "jaccard")
    pairs = found.unionByName(turned).join(named("l", "a"), "l").join(named("r", "b"), "r").select(F.col("l_class").alias("l"), F.col("r_class").alias("r"), "shared", "jaccard")
    itself = sets.filter("a AND b").select(F.col("class").alias("l"), F.col("class").alias("r"), F.col("size").alias("shared"), F.lit(1.0).alias("jaccard"))
    return pairs.unionByName(itself), lm, rm


_WORDS = [f"b{i}" for i in range(8)]


def _numbered(sets: DataFrame) -> DataFrame:
    """Sets (``class``, ``items``) with a number (``set``), ``size``, 512 bits, and ``nos`` for the items: their numbers, the rarest first.

    What is brought together for a pair are numbers then, not words. Only this
    plan's one write may be read, as it numbers by place.
    """
    key = F.unhex(F.substring("class", 1, 32)).alias("__k")
    each = sets.select(key, F.explode("items").alias("item"))
    freq = each.groupBy("item").agg(F.count("*").alias("n")).withColumn("no", F.monotonically_increasing_id())
    bits = [F.expr(f"bit_or(if(pmod(xxhash64(no), 512) div 64 = {i}, shiftleft(1L, cast(pmod(xxhash64(no), 64) AS int)), 0L))").alias(b) for i, b in enumerate(_WORDS)]
    nos = F.transform(F.array_sort(F.collect_list(F.struct("n", "no"))), lambda x: x["no"]).alias("nos")
    of_key = each.join(freq, "item").groupBy("__k").agg(nos, *bits)
    return sets.withColumn("size", F.size("items")).select(key, *(c for c in sets.columns if c != "items"), "size").join(of_key, "__k").drop("__k").withColumn("set", F.monotonically_increasing_id())


def _alike(sets: DataFrame, least_shared: int, least_jaccard: float, one: str = "", other: str = "") -> DataFrame:
    """Pairs (``l``, ``r``, ``shared``, ``jaccard``) of different sets, as of ``_numbered``, each once, the smaller set first.

    With ``one`` and ``other``, flags of the sets, only pairs of a set of either.
    A pair is tried where the smaller one's prefix meets the larger one's, if the
    items left there and the bits that differ allow the overlap.
    """
    flags, words, numbered = [one, other] if one else [], _WORDS, sets
    of_both = least_jaccard / (1 + least_jaccard)

    def prefixes(name: str, share: float) -> DataFrame:
        length = (F.col("size") - F.ceil(F.lit(share) * F.col("size") - 1e-9) + 1).cast("int")
        kept = numbered.select("*", F.posexplode(F.slice("nos", F.lit(1), length)).alias("pos", "item")).withColumn("at", F.col("pos") + 1)
        return kept.select("item", F.col("set").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in ("size", "at", *words, *flags)))

    # with the larger set an overlap takes at least 2t / (1 + t) of the smaller one, so its prefix is shorter
    total, least = F.col("l_size") + F.col("r_size"), F.ceil(F.lit(of_both) * (F.col("l_size") + F.col("r_size")) - 1e-9)
    differ = sum((F.bit_count(F.col(f"l_{b}").bitwiseXOR(F.col(f"r_{b}"))) for b in words), F.lit(0))
    ordered = (F.col("l_size") < F.col("r_size")) | ((F.col("l_size") == F.col("r_size")) & (F.col("l") < F.col("r")))
    left = F.least(F.col("l_size") - F.col("l_at"), F.col("r_size") - F.col("r_at")) + 1
    may = ordered & (F.col("l_size") >= F.lit(least_jaccard) * F.col("r_size") - 1e-9) & (left >= least) & (differ <= total - 2 * least)
    if one:
        may = may & ((F.col(f"l_{one}") & F.col(f"r_{other}")) | (F.col(f"l_{other}") & F.col(f"r_{one}")))
    # sizes in bands of the ratio that they may have: a smaller set lies in the larger one's band or the one below
    band = lambda size: F.floor(F.log(F.col(size)) / F.lit(1e-6 - math.log(least_jaccard)))
    smaller = prefixes("l", 2 * of_both).withColumn("__band", band("l_size"))
    larger = prefixes("r", least_jaccard).withColumn("__band", F.explode(F.array(band("r_size") - 1, band("r_size"))))
    near = smaller.join(larger, ["item", "__band"]).filter(may).select("l", "r").distinct()

    held = lambda name, alias: numbered.select(F.col("set").alias(name), F.col("nos").alias(alias))
    shared = F.size(F.array_intersect("a", "b"))
    made = near.join(held("l", "a"), "l").join(held("r", "b"), "r")
    scored = made.select("l", "r", shared.alias("shared"), (shared / (F.size("a") + F.size("b") - shared)).alias("jaccard"))
    return scored.filter((F.col("shared") >= least_shared) & (F.col("jaccard") >= least_jaccard - 1e-12))


def similar_within(docs: DataFrame, by: str, least_shared: int = 2, least_jaccard: float = 0.8) -> DataFrame:
    """Every row of ``docs`` (``id``, ``items``, ``by``) with its class, and how many other rows it links to, in all and within its ``by``.

    As ``similar_sets``, with all rows on both sides; sets of fewer than
    ``least_shared`` items have a class and no link, and a null ``by`` is ''. A
    pair of classes is tried where the smaller one's prefix meets the larger
    one's, if the items left there and the bits that differ allow the overlap.
    """
    items = F.array_sort(F.array_distinct(F.coalesce("items", F.array().cast("array<string>"))))
    keyed = docs.select("id", given(F.col(by)).alias(by), items.alias("items")).withColumn("class", F.sha2(F.array_join("items", "\u0001"), 256))
    members, _ = materialize(keyed.filter(F.size("items") >= least_shared).groupBy("class", by).agg(F.count("*").alias("n"), F.any_value("items").alias("items")), "members")
    sets, _ = materialize(_numbered(members.groupBy("class").agg(F.any_value("items").alias("items"))), "sets")

    pairs, _ = materialize(_alike(sets, least_shared, least_jaccard).select("l", "r"), "pairs")
    itself = sets.select(F.col("set").alias("l"), F.col("set").alias("r"))
    both = pairs.unionByName(pairs.select(F.col("r").alias("l"), F.col("l").alias("r"))).unionByName(itself)

    named = sets.select("set", "class")
    counts = members.select("class", by, "n").join(named, "class").select(F.col("set").alias("r"), by, "n")
    near_by = both.join(counts, "r").groupBy("l", by).agg(F.sum("n").alias("own"))
    links = near_by.join(near_by.groupBy("l").agg(F.sum("own").alias("all")), "l").join(named.withColumnRenamed("set", "l"), "l")
    less = lambda c: F.coalesce(F.col(c) - 1, F.lit(0).cast("bigint"))
    return keyed.select("id", by, "class").join(links.select("class", by, "all", "own"), ["class", by], "left").select("id", by, "class", less("all").alias("n_links"), less("own").alias("n_own"))


def handshakes(producers: DataFrame, consumers: DataFrame) -> DataFrame:
    """Cross-service equality of a broker field: none ledger, one resolves, several are candidates.

    Inputs: ``id``, ``service``, ``field``.
    """
    c = consumers.select(F.col("id").alias("c_id"), F.col("service").alias("c_service"), "field")
    # consumers are counted by field and service before producers ask, so a field of very many of both is no product of them
    own = c.groupBy("field", F.col("c_service").alias("service")).agg(F.countDistinct("c_id").alias("__own"))
    all_ = c.groupBy("field").agg(F.countDistinct(F.struct("c_id", "c_service")).alias("__all"))
    asked = producers.select("id", "service", "field").distinct().join(all_, "field", "left").join(own, ["field", "service"], "left")
    hits = asked.groupBy("id").agg(F.sum(F.coalesce("__all", F.lit(0)) - F.coalesce("__own", F.lit(0))).alias("n"))
    return hits.select("id", F.col("n").alias("n_matches"), F.when(F.col("n") == 0, "ledger").when(F.col("n") == 1, "resolved").otherwise("candidates").alias("outcome"))


def hinted(clients: DataFrame, links: DataFrame) -> DataFrame:
    """Target service of each client whose URL starts with a link's base URL; the longest base counts.

    A URL is cut, once for all its clients, to every length that ``links`` (``base_url``, ``target``) holds,
    so the join stays an equi-join; all links count, however many there are. The
    lengths come to the driver as one array, which has no more members than the
    longest base URL has characters. Of several targets of one base the last by
    name counts; null and empty bases are none.
    """
    known = links.filter("base_url <> ''").groupBy("base_url").agg(F.max("target").alias("target"))
    lengths = known.agg(F.array_sort(F.collect_set(F.length("base_url"))).alias("l")).first()["l"]
    if not lengths:
        return clients.withColumn("target_service", F.lit(""))
    fit = F.filter(F.from_json(F.lit(json.dumps(lengths)), "array<int>"), lambda n: n <= F.length("url"))
    heads = F.explode(F.transform(fit, lambda n: F.substr("url", F.lit(1), n)))
    met = clients.select("url").distinct().select("url", heads.alias("base_url")).join(known, "base_url")
    best = met.groupBy("url").agg(F.max(F.struct(F.length("base_url").alias("n"), "target"))["target"].alias("target_service"))
    return clients.join(best, "url", "left").select(*clients.columns, given(F.col("target_service")).alias("target_service"))


def shared_channels(rows: DataFrame) -> DataFrame:
    """Keys (``service``, ``key``) that several services use, with the services: link candidates.

    One row a key, never a row for each pair of services.
    """
    used = rows.select("service", "key").distinct().groupBy("key").agg(F.count("*").alias("n_services"), F.array_join(F.array_sort(F.collect_list("service")), ",").alias("services"))
    return used.filter("n_services > 1")


def nodes_in_file(nodes: DataFrame, path: str) -> DataFrame:
    """Nodes of a file: by exact path if there are any, else by a path that ends in the other's."""
    exact = nodes.filter(F.col("file") == path)
    if exact.limit(1).count():
        return exact
    return nodes.filter((F.col("file") != "") & (F.col("file").endswith("/" + path) | F.lit(path).endswith(F.concat(F.lit("/"), "file"))))


def by_convention(calls: DataFrame, decls: DataFrame) -> DataFrame:
    """Reference to declaration by name: in its own file first, then service, then anywhere if unique.

    ``calls``: ``id``, ``service``, ``file``, ``name``; ``decls``: ``id``,
    ``service``, ``file``, ``label``. All declarations of the nearest scope count.
    """
    d = decls.select(F.col("id").alias("d_id"), F.col("service").alias("d_service"), F.col("file").alias("d_file"), F.col("label").alias("name"))
    once = d.groupBy("name").agg(F.min("d_id").alias("d_id"), F.count("*").alias("__n")).filter("__n = 1").select("name", "d_id")
    c = calls.select("id", "service", "file", "name")
    own = c.join(d, (c["name"] == d["name"]) & (c["service"] == d["d_service"]) & (c["file"] == d["d_file"])).select("id", "d_id", F.lit(0).alias("scope"))
    near = c.join(d, (c["name"] == d["name"]) & (c["service"] == d["d_service"])).select("id", "d_id", F.lit(1).alias("scope"))
    far = c.join(once, "name").select("id", "d_id", F.lit(2).alias("scope"))
    hits = own.unionByName(near).unionByName(far).filter("id <> d_id")
    best = hits.groupBy("id").agg(F.min("scope").alias("scope"))
    return hits.join(best, ["id", "scope"]).select("id", "d_id", "scope").distinct()


def file_routes(files: DataFrame) -> DataFrame:
    """Routes that file conventions imply: pages and route files; ``dialect`` and ``route``."""
    f = F.col("file")
    stem = F.regexp_replace(f, r"\.[^./]+$", "")
    dialect = (
        F.when(f.rlike(r"(^|/)app/(.*/)?(page|route)\.[jt]sx?$"), "next-app")
        .when(f.rlike(r"(^|/)pages/.*\.[jt]sx?$"), "next-pages")
        .when(f.rlike(r"(^|/)pages/.*\.vue$"), "nuxt")
        .when(f.rlike(r"(^|/)server/(api|routes)/.*\.[jt]s$"), "nuxt-server")
        .when(f.rlike(r"(^|/)routes/(.*/)?\+(page|server)(\.server)?\.(svelte|[jt]s)$"), "sveltekit")
        .when(f.rlike(r"(^|/)app/routes/.*\.[jt]sx?$"), "remix")
    )
    path = (
        F.when(F.col("dialect") == "next-app", F.regexp_replace(F.regexp_extract(stem, r"(?:^|.*/)app/(?:(.*)/)?(?:page|route)$", 1), r"\([^)]*\)/?", ""))
        .when(F.col("dialect").isin("next-pages", "nuxt"), F.regexp_replace(F.regexp_extract(stem, r"(?:^|.*/)pages/(.*)$", 1), r"(^|/)index$", ""))
        .when(F.col("dialect") == "nuxt-server", F.regexp_replace(F.regexp_extract(stem, r"(?:^|.*/)server/((?:api|routes)/.*)$", 1), r"^routes/", ""))
        .when(F.col("dialect") == "sveltekit", F.regexp_extract(stem, r"(?:^|.*/)routes/(?:(.*)/)?\+(?:page|server)(?:\.server)?$", 1))
        .when(F.col("dialect") == "remix", F.regexp_replace(F.regexp_extract(stem, r"(?:^|.*/)app/routes/(.*)$", 1), r"[.]", "/"))
    )
    dynamic = F.regexp_replace(F.regexp_replace(F.col("__p"), r"\[\[?(?:\.\.\.)?([^\]]+)\]\]?", ":$1"), r"\$([A-Za-z_]+)", ":$1")
    return files.withColumn("dialect", dialect).filter("dialect IS NOT NULL").withColumn("__p", path).withColumn("route", F.concat(F.lit("/"), F.btrim(dynamic, F.lit("/")))).drop("__p")


def group_prefixes(groups: DataFrame) -> DataFrame:
    """Full prefix of nested route groups (``id``, ``parent_id``, ``prefix``): parents' prefixes first.

    Levels are worked out until none is left, each written once. Groups on or
    below a cycle, or below a group that is not there, have no prefix: ``full``
    is null and ``depth`` -1.
    """
    stored, _ = materialize(groups.select("id", "parent_id", F.coalesce("prefix", F.lit("")).alias("prefix")), "groups")
    level = stored.filter("parent_id IS NULL OR parent_id = ''").select("id", F.col("prefix").alias("full"), F.lit(0).alias("depth"))
    found = Levels("group")
    while found.add(level):
        up = found.last.select(F.col("id").alias("parent_id"), F.col("full").alias("__up"), "depth")
        level = stored.join(up, "parent_id").select("id", F.concat(F.regexp_replace("__up", "/+$", ""), "prefix").alias("full"), (F.col("depth") + 1).alias("depth"))
    out = found.all()
    lost = stored.select("id").join(out.select("id"), "id", "left_anti").select("id", F.lit(None).cast("string").alias("full"), F.lit(-1).alias("depth"))
    return out.unionByName(lost)


def routes_to_handlers(routes: DataFrame, functions: DataFrame) -> DataFrame:
    """Route handler ``qualifier.label``: by receiver and label in the service, else the first of that label."""
    name = F.element_at(F.split("handler", r"\."), -1)
    owner = F.lower(F.when(F.col("handler").contains("."), F.regexp_replace(F.regexp_replace("handler", r"\.[^.]*$", ""), r".*\.", "")).otherwise(""))
    r = routes.select("id", "service", name.alias("label"), owner.alias("owner"))
    f = functions.select(F.col("id").alias("fn"), "service", "label", F.lower(meta("meta", "class")).alias("class"))
    hits = r.join(f, ["service", "label"]).withColumn("rank", F.when((F.col("owner") != "") & (F.col("owner") == F.col("class")), 0).otherwise(1))
    best = hits.groupBy("id").agg(F.min(F.struct("rank", "fn")).alias("b"))
    return best.select("id", F.col("b.fn").alias("fn"), F.col("b.rank").alias("rank"))


def dom_contracts(scripts: DataFrame, templates: DataFrame) -> DataFrame:
    """Selectors in scripts to elements in templates of the service, by (attr, value)."""
    t = templates.select(F.col("id").alias("t_id"), "service", "attr", "value")
    return scripts.join(t, ["service", "attr", "value"]).select(*edge("dom", F.col("id"), F.col("t_id"), "dom_contract"))
