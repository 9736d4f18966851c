"""Queries of the general data-processing problems, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowskein.operators import diff, hierarchy, nested, references, skew
from flowskein.session import materialize, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every span of every export with its place, parent span and service."""
    return nested.export_spans(table(spark, sf_dir, "otlp_exports"))


def p1_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Span table by Dewey label, all fields, deliveries settled."""
    dotted = lambda c: F.array_join(F.col(c).cast("array<string>"), ".")
    spans = nested.export_trees(table(spark, sf_dir, "otlp_exports"), wanted=("span",)).table("span")
    return spans.select(
        F.col("record_key").cast("string").alias("record_key"), dotted("dewey").alias("dewey"), dotted("parent_dewey").alias("parent_dewey"), "trace_id", "span_id", "name", "start_ns", "end_ns"
    )


def p1_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of spans and resources, counted by owner, key and value type."""
    trees = nested.export_trees(table(spark, sf_dir, "otlp_exports"), wanted=("span_attribute", "resource_attribute"))
    owned = [trees.table(f"{owner}_attribute").select(F.lit(owner).alias("owner"), "key", "value_type") for owner in ("span", "resource")]
    return owned[0].unionByName(owned[1]).groupBy("owner", "key", "value_type").agg(F.count("*").alias("n"))


def p1_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All tables of the exports: rows, parents, and rows whose parent is not there."""
    trees = nested.export_trees(table(spark, sf_dir, "otlp_exports"), tuple(nested.Level(x.table, x.parent, x.path) for x in nested.OTLP_LEVELS))
    return nested.lost_links(nested.Trees(materialize(trees.packed, "export-trees")[0], trees.levels))


def p1_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of every complete export by schema path, whatever its depth, with its links checked."""
    exports = table(spark, sf_dir, "otlp_exports").groupBy("export_id").agg(F.min("body").alias("body"))
    # what begins like an object and is not one gives an 'invalid' row
    objects = exports.filter(F.col("body").rlike(r"^\s*\{"))
    return nested.node_summary(nested.dewey_nodes(objects, "export_id", "body").filter("kind <> 'invalid'"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, type) pairs that hold more than 1 % of the distinct edge ids."""
    counts, _ = materialize(skew.balanced_distinct(table(spark, sf_dir, "edges"), ["src", "type"], "id"), "pair-counts")
    total = counts.agg(F.sum("n_items")).first()[0] or 0
    blank = F.col("src").isNull() | (F.btrim("src", F.lit(" \t\r\n")) == "")
    return counts.filter(F.col("n_items") * 100 > total).filter(~blank).select("src", "type")


def p2_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct edges and rows of every (src, type)."""
    edges = table(spark, sf_dir, "edges").filter("src IS NOT NULL AND trim(src) <> ''")
    return skew.balanced_distinct(edges, ["src", "type"], "id").withColumnsRenamed({"n_items": "n_edges"})


def p2_source_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge rows by service and node type of their source: hot sources joined in shards."""
    edges = table(spark, sf_dir, "edges").select("id", "src").filter("src IS NOT NULL")
    nodes = table(spark, sf_dir, "nodes").select("id", "service", "type").unionByName(table(spark, sf_dir, "shared_nodes").select("id", "service", "type"))
    known = nodes.groupBy(F.col("id").alias("src")).agg(F.max("service").alias("service"), F.max("type").alias("node_type"))
    joined = skew.fragment_replicate_join(edges, known, ["src"], spread="id")
    return joined.groupBy("service", "node_type").agg(F.count("*").alias("n_rows"))


EVAL_FIELDS = [diff.Field("recall", 1e-6), diff.Field("precision_score", 1e-6), diff.Field("honest_misses"), diff.Field("silent_misses"), diff.Field("hard_fail")]


def _eval_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    scores = ("recall", "precision_score", "honest_misses", "hard_fail")

    def side(name: str, silent: F.Column) -> DataFrame:
        return table(spark, sf_dir, name).select("run_id", diff.normal_key(F.col("case_id")).alias("case_id"), *scores, silent.alias("silent_misses"))

    return side("eval_baseline", F.col("silent_misses").cast("double")), side("eval_mirror", diff.number_text(F.col("silent_misses")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Case results missing on either side and each field that differs."""
    return _differences(spark, sf_dir).select("run_id", "case_id", "diff")


def p3_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p3_found, with both values as numbers: true is 1, NaN -1."""
    number = lambda c: F.when(F.col(c).isin("true", "false"), (F.col(c) == "true").cast("double")).when(F.isnan(F.col(c).try_cast("double")), -1.0).otherwise(F.round(F.col(c).try_cast("double"), 9))
    return _differences(spark, sf_dir).select("run_id", "case_id", "diff", number("left_value").alias("left_value"), number("right_value").alias("right_value"))


def _differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.differences(*_eval_sides(spark, sf_dir), ["run_id", "case_id"], EVAL_FIELDS, "baseline", "mirror")


def p3_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of which one of the copies contradicts itself."""
    return diff.conflicts(*_eval_sides(spark, sf_dir), ["run_id", "case_id"], EVAL_FIELDS, "baseline", "mirror").select("run_id", "case_id", "side")


def _tree_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = table(spark, sf_dir, "edges").filter(F.col("type").isin("contains", "inherits"))
    down = F.col("type") == "contains"
    return edges.select("type", F.when(down, F.col("src")).otherwise(F.col("dst")).alias("parent"), F.when(down, F.col("dst")).otherwise(F.col("src")).alias("child"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root and depth of every node of the containment and inheritance trees."""
    return hierarchy.hierarchy(_tree_pairs(spark, sf_dir))


def p5_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path from the root to every node, its ids joined by ' > '."""
    paths = hierarchy.hierarchy_paths(_tree_pairs(spark, sf_dir))
    return paths.select("type", "node_id", "root_id", "depth", F.coalesce(F.array_join("path", " > "), F.lit("")).alias("path"))


def p5_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of descendants of every node that has any, and the farthest one's distance."""
    pairs = hierarchy.descendants(hierarchy.hierarchy_paths(_tree_pairs(spark, sf_dir)))
    return pairs.groupBy("type", "node_id").agg(F.count("*").alias("n_descendants"), F.max("distance").alias("height"))


def p5_several_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trees that name several parents."""
    return hierarchy.several_parents(_tree_pairs(spark, sf_dir)).select("type", "node_id", "n_parents")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edge ends that name a node that is missing, late or removed."""
    cols = ("id", "indexed_at", "removed_at")
    nodes = table(spark, sf_dir, "nodes").select(*cols).unionByName(table(spark, sf_dir, "shared_nodes").select(*cols))
    return references.orphan_references(table(spark, sf_dir, "edges"), nodes)


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references by side, reason and month."""
    return references.orphan_report(p6_found(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_spans, p1_attributes, p1_tables, p1_nodes, p2_found, p2_pair_counts, p2_source_services, p3_found, p3_differences, p3_conflicts,
        p5_found, p5_paths, p5_descendants, p5_several_parents, p6_found, p6_report,
    )
}

_BLANK = "' ' || chr(9) || chr(10) || chr(13)"
_P1 = """
WITH e AS (SELECT export_id, min(body) AS body FROM otlp_exports WHERE json_valid(body) AND json_type(body) = 'OBJECT' GROUP BY export_id),
r AS (SELECT export_id, generate_subscripts(a, 1) - 1 AS resource_pos, unnest(a) AS r FROM (SELECT export_id, json_extract(body, '$.resourceSpans[*]') AS a FROM e)),
s AS (SELECT export_id, resource_pos, r, generate_subscripts(a, 1) - 1 AS scope_pos, unnest(a) AS s FROM (SELECT *, json_extract(r, '$.scopeSpans[*]') AS a FROM r)),
p AS (SELECT export_id, resource_pos, scope_pos, r, generate_subscripts(a, 1) - 1 AS span_pos, unnest(a) AS p FROM (SELECT *, json_extract(s, '$.spans[*]') AS a FROM s))
"""
_TREE = """
WITH RECURSIVE pairs AS (
  SELECT DISTINCT type, CASE WHEN type = 'contains' THEN src ELSE dst END AS parent, CASE WHEN type = 'contains' THEN dst ELSE src END AS child
  FROM edges WHERE type IN ('contains', 'inherits')),
nodes AS (SELECT type, parent AS node_id FROM pairs UNION SELECT type, child FROM pairs),
roots AS (SELECT n.type, n.node_id FROM nodes n LEFT JOIN pairs p ON p.type = n.type AND p.child = n.node_id WHERE p.child IS NULL),
walk AS (
  SELECT type, node_id, node_id AS root_id, 0 AS depth, node_id AS path FROM roots
  UNION ALL
  SELECT w.type, p.child, w.root_id, w.depth + 1, w.path || ' > ' || p.child FROM walk w JOIN pairs p ON p.type = w.type AND p.parent = w.node_id)
"""
_REFS = """
WITH n AS (SELECT id, indexed_at, removed_at FROM nodes UNION ALL SELECT id, indexed_at, removed_at FROM shared_nodes),
refs AS (
  SELECT id AS edge_id, 'src' AS side, src AS ref, indexed_at AS t FROM edges
  UNION ALL SELECT id, 'dst', dst, indexed_at FROM edges),
asked AS (SELECT * FROM refs WHERE ref IS NOT NULL AND trim(ref) <> '' AND ref <> 'unresolved' AND NOT starts_with(ref, 'unresolved:')),
held AS (SELECT DISTINCT a.ref, a.t FROM asked a JOIN n ON n.id = a.ref AND n.indexed_at <= a.t AND (n.removed_at IS NULL OR n.removed_at > a.t)),
first_seen AS (SELECT id, min(indexed_at) AS first_at FROM n GROUP BY id),
found AS (
  SELECT a.edge_id, a.side, CASE WHEN f.id IS NULL THEN 'missing' WHEN f.first_at > a.t THEN 'late' ELSE 'removed' END AS reason, strftime(a.t, '%Y-%m') AS period
  FROM asked a LEFT JOIN held h ON h.ref = a.ref AND h.t = a.t LEFT JOIN first_seen f ON f.id = a.ref WHERE h.ref IS NULL)
"""
_SIDES = f"""
WITH b AS (SELECT DISTINCT run_id, lower(trim(case_id, {_BLANK})) AS case_id, recall, precision_score, honest_misses, CAST(silent_misses AS DOUBLE) AS silent_misses, hard_fail FROM eval_baseline),
m AS (SELECT DISTINCT run_id, lower(trim(case_id, {_BLANK})) AS case_id, recall, precision_score, honest_misses,
  CASE WHEN trim(silent_misses, {_BLANK}) <> '' THEN coalesce(TRY_CAST(trim(silent_misses, {_BLANK}) AS DOUBLE), 'nan'::DOUBLE) END AS silent_misses, hard_fail FROM eval_mirror)
"""
_EXACT = ("honest_misses", "silent_misses", "hard_fail")
_NEAR = ("recall", "precision_score")


def _differs(name: str, a: str, b: str) -> str:
    unlike = f"{a}.{name} IS DISTINCT FROM {b}.{name}"
    return unlike if name in _EXACT else f"{unlike} AND coalesce(isnan({a}.{name}) OR isnan({b}.{name}) OR abs({a}.{name} - {b}.{name}) > 1e-6, true)"


_DIFF = (
    _SIDES
    + """, both_sides AS (SELECT b.run_id, b.case_id, b AS l, m AS r FROM b JOIN m ON b.run_id = m.run_id AND b.case_id = m.case_id),
d AS (SELECT run_id, case_id, 'only_baseline' AS diff, CAST(NULL AS DOUBLE) AS lv, CAST(NULL AS DOUBLE) AS rv FROM b ANTI JOIN m USING (run_id, case_id)
UNION ALL SELECT run_id, case_id, 'only_mirror', NULL, NULL FROM m ANTI JOIN b USING (run_id, case_id) """
    + " ".join(f"UNION ALL SELECT run_id, case_id, '{n}', CAST(l.{n} AS DOUBLE), CAST(r.{n} AS DOUBLE) FROM both_sides WHERE {_differs(n, 'l', 'r')}" for n in (*_NEAR, *_EXACT))
    + ")"
)

ORACLES = {
    "p1_found": _P1
    + """SELECT export_id, CAST(resource_pos AS INT) AS resource_pos, CAST(scope_pos AS INT) AS scope_pos, CAST(span_pos AS INT) AS span_pos,
  coalesce(json_extract_string(p, '$.spanId'), '') AS span_id,
  CASE WHEN regexp_full_match(coalesce(json_extract_string(p, '$.parentSpanId'), ''), '[\\s0]*') THEN '' ELSE json_extract_string(p, '$.parentSpanId') END AS parent_span_id,
  coalesce(json_extract_string(list_filter(json_extract(r, '$.resource.attributes[*]'), lambda x: json_extract_string(x, '$.key') = 'service.name')[1], '$.value.stringValue'), '') AS service
FROM p WHERE json_type(p) = 'OBJECT'""",
    "p1_spans": _P1
    + """SELECT DISTINCT CAST(export_id AS VARCHAR) AS record_key, concat_ws('.', resource_pos, scope_pos, span_pos) AS dewey, concat_ws('.', resource_pos, scope_pos) AS parent_dewey,
  coalesce(json_extract_string(p, '$.traceId'), '') AS trace_id, coalesce(json_extract_string(p, '$.spanId'), '') AS span_id, coalesce(json_extract_string(p, '$.name'), '') AS name,
  coalesce(json_extract_string(p, '$.startTimeUnixNano'), '') AS start_ns, coalesce(json_extract_string(p, '$.endTimeUnixNano'), '') AS end_ns FROM p""",
    "p1_attributes": _P1
    + """, a AS (SELECT 'span' AS owner, unnest(json_extract(p, '$.attributes[*]')) AS a FROM p
  UNION ALL SELECT 'resource', unnest(json_extract(r, '$.resource.attributes[*]')) FROM r)
SELECT owner, coalesce(json_extract_string(a, '$.key'), '') AS key, coalesce(json_keys(a, '$.value')[1], '') AS value_type, count(*) AS n FROM a GROUP BY 1, 2, 3""",
    "p1_tables": _P1
    + """, ra AS (SELECT export_id, resource_pos AS a, unnest(json_extract(r, '$.resource.attributes[*]')) AS x FROM r),
q AS (SELECT *, concat_ws('.', resource_pos, scope_pos, span_pos) AS a FROM p),
sa AS (SELECT export_id, a, unnest(json_extract(p, '$.attributes[*]')) AS x FROM q),
ev AS (SELECT export_id, a, generate_subscripts(x, 1) AS k, unnest(x) AS x FROM (SELECT export_id, a, json_extract(p, '$.events[*]') AS x FROM q)),
ea AS (SELECT export_id, a || '.' || k AS a, unnest(json_extract(x, '$.attributes[*]')) AS x FROM ev),
ln AS (SELECT export_id, a, generate_subscripts(x, 1) AS k, unnest(x) AS x FROM (SELECT export_id, a, json_extract(p, '$.links[*]') AS x FROM q)),
la AS (SELECT export_id, a || '.' || k AS a, unnest(json_extract(x, '$.attributes[*]')) AS x FROM ln),
t AS (SELECT 'resource' AS "table", export_id, '' AS a FROM r UNION ALL SELECT 'resource_attribute', export_id, CAST(a AS VARCHAR) FROM ra
  UNION ALL SELECT 'scope', export_id, CAST(resource_pos AS VARCHAR) FROM s UNION ALL SELECT 'span', export_id, concat_ws('.', resource_pos, scope_pos) FROM p
  UNION ALL SELECT 'span_attribute', export_id, a FROM sa UNION ALL SELECT 'event', export_id, a FROM ev UNION ALL SELECT 'event_attribute', export_id, a FROM ea
  UNION ALL SELECT 'link', export_id, a FROM ln UNION ALL SELECT 'link_attribute', export_id, a FROM la),
names AS (SELECT unnest(['resource', 'resource_attribute', 'scope', 'span', 'span_attribute', 'event', 'event_attribute', 'link', 'link_attribute']) AS "table")
SELECT n."table", count(t.export_id) AS n_rows, count(DISTINCT (t.export_id, t.a)) FILTER (t.export_id IS NOT NULL) AS n_parents, CAST(0 AS BIGINT) AS n_lost FROM names n LEFT JOIN t ON t."table" = n."table" GROUP BY n."table\"""",
    "p1_nodes": """
WITH e AS (SELECT export_id, min(body) AS body FROM otlp_exports WHERE json_valid(body) AND json_type(body) = 'OBJECT' GROUP BY export_id),
t AS (SELECT regexp_replace(x.fullkey, '\\[[0-9]+\\]', '[]', 'g') AS schema_path, x.parent IS NULL AS is_root, regexp_replace(x.path, '\\[[0-9]+\\]', '[]', 'g') AS above FROM e, json_tree(e.body) x),
up AS (SELECT above AS schema_path, count(*) AS n FROM t WHERE NOT is_root GROUP BY 1)
SELECT t.schema_path, count(*) AS n_nodes, CAST(coalesce(any_value(up.n), 0) AS BIGINT) AS n_children, CAST(0 AS BIGINT) AS n_lost FROM t LEFT JOIN up ON up.schema_path = t.schema_path GROUP BY t.schema_path""",
    "p2_found": """SELECT src, type FROM edges WHERE src IS NOT NULL AND trim(src) <> '' GROUP BY src, type
HAVING count(DISTINCT id) * 100 > (SELECT count(DISTINCT id) FROM edges)""",
    "p2_pair_counts": """SELECT src, type, count(DISTINCT id) AS n_edges, count(*) AS n_rows FROM edges WHERE src IS NOT NULL AND trim(src) <> '' GROUP BY src, type""",
    "p2_source_services": """WITH n AS (SELECT id, service, type FROM nodes UNION ALL SELECT id, service, type FROM shared_nodes),
k AS (SELECT id, max(service) AS service, max(type) AS node_type FROM n GROUP BY id)
SELECT k.service, k.node_type, count(*) AS n_rows FROM edges e LEFT JOIN k ON k.id = e.src WHERE e.src IS NOT NULL GROUP BY 1, 2""",
    "p3_found": _DIFF + " SELECT run_id, case_id, diff FROM d",
    "p3_differences": _DIFF + " SELECT run_id, case_id, diff, CASE WHEN isnan(lv) THEN -1.0 ELSE round(lv, 9) END AS left_value, CASE WHEN isnan(rv) THEN -1.0 ELSE round(rv, 9) END AS right_value FROM d",
    "p3_conflicts": _SIDES
    + f""", x AS (SELECT *, 'baseline' AS side FROM b UNION ALL SELECT *, 'mirror' FROM m)
SELECT DISTINCT a.run_id, a.case_id, a.side FROM x a JOIN x c ON a.run_id = c.run_id AND a.case_id = c.case_id AND a.side = c.side AND ({" OR ".join(f"({_differs(n, 'a', 'c')})" for n in (*_NEAR, *_EXACT))})""",
    "p5_found": _TREE
    + """SELECT n.type, n.node_id, coalesce(w.root_id, '') AS root_id, coalesce(w.depth, -1) AS depth
FROM nodes n LEFT JOIN walk w ON w.type = n.type AND w.node_id = n.node_id""",
    "p5_paths": _TREE
    + """SELECT n.type, n.node_id, coalesce(w.root_id, '') AS root_id, coalesce(w.depth, -1) AS depth, coalesce(w.path, '') AS path
FROM nodes n LEFT JOIN walk w ON w.type = n.type AND w.node_id = n.node_id""",
    "p5_descendants": _TREE
    + """, below AS (
  SELECT type, node_id, node_id AS at_id, 0 AS distance FROM walk
  UNION ALL SELECT b.type, b.node_id, p.child, b.distance + 1 FROM below b JOIN pairs p ON p.type = b.type AND p.parent = b.at_id)
SELECT type, node_id, count(*) AS n_descendants, max(distance) AS height FROM below WHERE distance > 0 GROUP BY type, node_id""",
    "p5_several_parents": """SELECT type, CASE WHEN type = 'contains' THEN dst ELSE src END AS node_id, count(DISTINCT CASE WHEN type = 'contains' THEN src ELSE dst END) AS n_parents
FROM edges WHERE type IN ('contains', 'inherits') AND src IS NOT NULL AND dst IS NOT NULL GROUP BY 1, 2 HAVING n_parents > 1""",
    "p6_found": _REFS + "SELECT edge_id, side, reason, period FROM found",
    "p6_report": _REFS + "SELECT side, reason, period, count(*) AS n_refs, count(DISTINCT edge_id) AS n_edges FROM found GROUP BY side, reason, period",
}
