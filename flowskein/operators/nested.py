"""Deeply nested records to flat, linked tables by Dewey labels.

A node's Dewey label is the list of ordinals on the way to it, so its parent's
label is the label without its last part: parent links need no join. Nodes are
grouped into tables by schema path (the member names on the way, no ordinals).

``dewey_tables`` labels known schema paths inside the JVM on the VARIANT type;
``dewey_nodes`` labels every node of records of unknown depth.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def complete_objects(df: DataFrame, body: str, out: str) -> DataFrame:
    """``df`` with ``out``: the VARIANT of a text that is one complete JSON object, else null.

    ``try_parse_json`` stops after the first value and ignores what follows, so
    the text is parsed inside four pairs of brackets, which the rest has to
    close. Garbage could close them itself only with four ``]`` in a row, or by
    ending in ``]``: the latter is ruled out directly, and texts with four in a
    row are parsed once more inside braces, which brackets cannot close.
    Repeated member names in one object make it ambiguous: null.
    """
    text = F.btrim(F.col(body), F.lit(" \t\r\n"))
    framed = F.try_parse_json(F.concat(F.lit("[[[["), text, F.lit("]]]]")))
    braced = F.try_parse_json(F.concat(F.lit('{"b":'), text, F.lit("}")))
    frames = df.withColumn("__n", F.try_variant_get(framed, "$", "array<array<array<array<variant>>>>"))
    level = F.col("__n")
    alone = F.size(level) == 1
    for _ in range(3):
        level = F.get(level, F.lit(0))
        alone = alone & (F.size(level) == 1)
    sure = F.when(text.rlike(r"(\]\s*){4}"), braced.isNotNull()).otherwise(F.lit(True))
    value = F.when(alone & text.startswith("{") & text.endswith("}") & sure, F.get(level, F.lit(0)))
    # a column of its own, not an expression: it is used often and must be parsed once
    return frames.withColumn(out, value).drop("__n")


def members(value: Column, name: str) -> Column:
    """Array at the path ``name`` below an object, empty where absent, null or no array."""
    return F.coalesce(
        F.try_variant_get(value, f"$.{name}", "array<variant>"), F.expr("cast(array() as array<variant>)")
    )


def text_of(value: Column, path: str) -> Column:
    """Text at ``path``; '' where absent or null, JSON text where nested."""
    return F.coalesce(F.try_variant_get(value, path, "string"), F.lit(""))


Getter = str | Callable[[Column], Column]


@dataclass(frozen=True)
class Level:
    """One schema path: an array below the nodes of ``parent`` ('' for the record), and what to keep of its elements.

    A field is a JSON path, whose text is kept ('' where absent), or a function
    from the node's VARIANT to a column of a type that has an order.
    """

    table: str
    parent: str
    path: str
    fields: dict[str, Getter] = field(default_factory=dict)


@dataclass(frozen=True)
class Trees:
    """Records whose labelled nodes are still packed: one array of (``dewey``, fields) for each schema path."""

    packed: DataFrame
    levels: dict[str, Level]

    def table(self, name: str, inherited: dict[str, tuple[str, str]] | None = None) -> DataFrame:
        """Nodes of one schema path: ``record_key``, ``dewey``, ``parent_dewey`` (its truncation) and the fields.

        ``inherited`` names columns that are fields of an ancestor, as
        ``{column: (table, field)}``: its label is the node's, cut to its
        length, and it is looked up in the same record's packed nodes.
        """
        rows = self.packed.select("*", F.explode(name).alias("__n"))
        taken = {column: self._ancestor(table).getField(of) for column, (table, of) in (inherited or {}).items()}
        kept = [c for c in self.packed.columns if c not in self.levels]
        return rows.select(
            *kept,
            F.col("__n.dewey").alias("dewey"),
            F.expr("slice(__n.dewey, 1, size(__n.dewey) - 1)").alias("parent_dewey"),
            *(F.col(f"__n.{f}").alias(f) for f in self.levels[name].fields),
            *(value.alias(column) for column, value in taken.items()),
        )

    def _ancestor(self, table: str) -> Column:
        depth = 1
        level = self.levels[table]
        while level.parent:
            level, depth = self.levels[level.parent], depth + 1
        if depth == 1:  # nodes of the first level are packed in the order of their only ordinal
            return F.get(F.col(table), F.col("__n.dewey")[0])
        cut = F.slice(F.col("__n.dewey"), 1, depth)
        return F.try_element_at(F.filter(table, lambda x: x["dewey"] == cut), F.lit(1))


def _labelled(value: Column, levels: dict[str, Level], table: str) -> Column:
    """Array of (``dewey``, ``node``) of all nodes of a level, in document order."""
    level = levels[table]
    child = lambda dewey: lambda c, i: F.struct(F.concat(dewey, F.array(i)).alias("dewey"), c.alias("node"))
    if not level.parent:
        return F.transform(members(value, level.path), child(F.expr("cast(array() as array<int>)")))
    above = _labelled(value, levels, level.parent)
    return F.flatten(F.transform(above, lambda p: F.transform(members(p["node"], level.path), child(p["dewey"]))))


def dewey_tables(records: DataFrame, key: str, value: str, levels: tuple[Level, ...], wanted: tuple[str, ...] = (), order: tuple[str, ...] = (), carry: tuple[str, ...] = ()) -> Trees:
    """Labels the nodes of a nested VARIANT column, for flat tables by schema path.

    Labelling is narrow: no shuffle, whatever the size, and a member that is
    absent, null, empty or not an array holds nothing. ``wanted`` names the
    tables to pack (all). Without ``order`` every row is a record. With it, rows
    of one ``key`` are deliveries of one record: the least by ``order`` whose
    value is not null counts, with its ``carry`` columns, and a row without key
    counts as a record of its own for each distinct ``order``. Nodes are then
    settled packed, so what is shuffled is neither a body nor a row a node, and
    a record delivered very often shrinks on the map side.
    """
    known = {level.table: level for level in levels}
    names = wanted or tuple(known)

    def pack(table: str) -> Column:
        getters = known[table].fields
        get = lambda node, g: text_of(node, g) if isinstance(g, str) else g(node)
        nodes = _labelled(F.col("__v"), known, table)
        return F.transform(nodes, lambda n: F.struct(n["dewey"].alias("dewey"), *(get(n["node"], g).alias(f) for f, g in getters.items()))).alias(table)

    source = records.select(F.col(key).alias("record_key"), *order, *(c for c in carry if c not in order), F.col(value).alias("__v"))
    levels_of = {t: known[t] for t in known if t in names}
    keep = {**levels_of, **{t: known[t] for t in known if t not in names}}
    if not order:
        return Trees(source.select("record_key", *carry, *(pack(t) for t in names)), keep)
    # a null value gives a null, which min() passes over; a filter would work the value out twice
    delivery = F.when(F.col("__v").isNotNull(), F.struct(*order, *(c for c in carry if c not in order), *(pack(t) for t in names)))
    own = F.when(F.col("record_key").isNull(), F.xxhash64(*order))
    settled = source.select("record_key", own.alias("__own"), delivery.alias("__d")).groupBy("record_key", "__own").agg(F.min("__d").alias("__d"))
    return Trees(settled.filter("__d IS NOT NULL").select("record_key", *(f"__d.{c}" for c in (*carry, *names))), keep)


def is_object(node: Column) -> Column:
    return F.try_variant_get(node, "$", "map<string,variant>").isNotNull()


def parent_span(value: Column) -> Column:
    """A parent span id; '' for none: absent, null, blank or all zeros."""
    return F.when(value.rlike(r"^[\s0]*$"), F.lit("")).otherwise(value)


def service_of(resource: Column) -> Column:
    """``stringValue`` of the resource's first own attribute ``service.name``, else ''."""
    own = F.try_variant_get(resource, "$.resource.attributes", "array<variant>")
    named = F.filter(own, lambda a: F.try_variant_get(a, "$.key", "string") == "service.name")
    return F.coalesce(F.try_variant_get(F.try_element_at(named, F.lit(1)), "$.value.stringValue", "string"), F.lit(""))


def _value_type(attribute: Column) -> Column:
    held = F.try_variant_get(attribute, "$.value", "map<string,variant>")
    return F.coalesce(F.element_at(F.map_keys(held), 1), F.lit(""))


def _value_text(attribute: Column) -> Column:
    held = F.try_variant_get(attribute, "$.value", "map<string,variant>")
    return F.coalesce(F.element_at(F.map_values(held), 1).cast("string"), F.lit(""))


#: Key-value attributes: ``value`` is the text of a plain value and the JSON text of a nested one, ``value_type`` the OTLP member that holds it.
ATTRIBUTE: dict[str, Getter] = {"key": "$.key", "value_type": _value_type, "value": _value_text}

#: The nesting of an OTLP trace export.
OTLP_LEVELS = (
    Level("resource", "", "resourceSpans", {"service": service_of}),
    Level("resource_attribute", "resource", "resource.attributes", ATTRIBUTE),
    Level("scope", "resource", "scopeSpans", {"scope_name": "$.scope.name", "scope_version": "$.scope.version"}),
    Level(
        "span",
        "scope",
        "spans",
        {
            "is_span": is_object,
            "trace_id": "$.traceId",
            "span_id": "$.spanId",
            "parent_span_id": lambda p: parent_span(text_of(p, "$.parentSpanId")),
            "name": "$.name",
            "kind": "$.kind",
            "start_ns": "$.startTimeUnixNano",
            "end_ns": "$.endTimeUnixNano",
        },
    ),
    Level("span_attribute", "span", "attributes", ATTRIBUTE),
    Level("event", "span", "events", {"name": "$.name", "at_ns": "$.timeUnixNano"}),
    Level("event_attribute", "event", "attributes", ATTRIBUTE),
    Level("link", "span", "links", {"trace_id": "$.traceId", "span_id": "$.spanId"}),
    Level("link_attribute", "link", "attributes", ATTRIBUTE),
)


def export_trees(exports: DataFrame, levels: tuple[Level, ...] = OTLP_LEVELS, wanted: tuple[str, ...] = (), carry: tuple[str, ...] = ()) -> Trees:
    """Labelled nodes of OTLP export bodies, each export once.

    Input columns: ``export_id``, ``received_at``, ``body`` and ``carry``; others
    are ignored. Bodies that are null, not JSON, cut, or no object give no rows.
    Of the deliveries of one ``export_id`` the earliest complete one counts
    (ties: the lowest body hash); exports without id count once for each
    distinct body and time. Every query over exports settles them this way.
    """
    read = complete_objects(exports.select("export_id", "received_at", *carry, "body"), "body", "__body")
    return dewey_tables(read.withColumn("__hash", F.xxhash64("body")), "export_id", "__body", levels, wanted, ("received_at", "__hash"), carry)


#: What ``export_spans`` keeps of the levels.
_SPAN_LEVELS = tuple(
    Level(level.table, level.parent, level.path, {k: v for k, v in level.fields.items() if k in ("service", "is_span", "span_id", "parent_span_id")})
    for level in OTLP_LEVELS
    if level.table in ("resource", "scope", "span")
)


def export_spans(exports: DataFrame) -> DataFrame:
    """Spans of OTLP export bodies with their place, parent span and service.

    The places are the parts of the span's Dewey label; the service is a field
    of the resource that the label, cut to its first part, names. Exports are
    settled as in ``export_trees``. Arrays that are absent, null or empty hold
    nothing; a place in ``spans`` that holds no object (a null, a number) is no
    span, though it keeps its ordinal.
    """
    spans = export_trees(exports, _SPAN_LEVELS, ("resource", "span")).table("span", {"service": ("resource", "service")})
    place = lambda i, name: F.col("dewey")[i].alias(name)
    return spans.filter("is_span").select(
        F.col("record_key").alias("export_id"), place(0, "resource_pos"), place(1, "scope_pos"), place(2, "span_pos"), "span_id", "parent_span_id", "service"
    )


def lost_links(trees: Trees) -> DataFrame:
    """Rows of every table and how many of them have a parent label that no row of the parent table has.

    ``table``, ``n_rows``, ``n_parents`` (labels that have children), ``n_lost``.
    Children are counted by parent label before the two tables meet.
    """
    out = None
    for name, level in trees.levels.items():
        rows = trees.table(name).select("record_key", "dewey", "parent_dewey")
        below = rows.groupBy("record_key", F.col("parent_dewey").alias("dewey")).agg(F.count("*").alias("__n"))
        if level.parent:
            above = trees.table(level.parent).select("record_key", "dewey", F.lit(0).cast("bigint").alias("__n"), F.lit(1).alias("__is"))
        else:
            above = trees.packed.select("record_key", F.expr("cast(array() as array<int>)").alias("dewey"), F.lit(0).cast("bigint").alias("__n"), F.lit(1).alias("__is"))
        met = below.withColumn("__is", F.lit(0)).unionByName(above).groupBy("record_key", "dewey").agg(F.sum("__n").alias("__n"), F.max("__is").alias("__is"))
        part = met.agg(F.coalesce(F.sum("__n"), F.lit(0)).alias("n_rows"), F.count_if(F.col("__n") > 0).alias("n_parents"), F.coalesce(F.sum(F.when(F.col("__is") == 0, F.col("__n"))), F.lit(0)).alias("n_lost"))
        part = part.select(F.lit(name).alias("table"), "*")
        out = part if out is None else out.unionByName(part)
    return out


_NODE_COLUMNS = ("record_key", "label", "parent_label", "schema_path", "parent_path", "kind", "value", "n_children")
_NODE_SCHEMA = "record_key string, label string, parent_label string, schema_path string, parent_path string, kind string, value string, n_children bigint"
_TOKEN = re.compile(r'[ \t\r\n]*(?:([{}\[\]:,])|"((?:[^"\\\x00-\x1f]|\\.)*)"|(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)|(true|false|null))')


class _Object(list):
    """Members of an object in text order, repeated names too."""


def _no_constant(name: str):
    raise ValueError(name)


def parse_json(text: str):
    """JSON text of any depth; objects as lists of (name, value). Raises ``ValueError``."""
    try:
        return json.loads(text, object_pairs_hook=_Object, parse_constant=_no_constant)
    except RecursionError:
        return _parse_deep(text)


def _parse_deep(text: str):
    """Without recursion, for what nests too deeply for the ordinary parser."""
    whole: list = []
    open_: list[list] = [whole]
    name: list[str | None] = [None]
    at, want = 0, "value"  # or: first (value or end), member (name or end), name, colon, next (comma or end)
    end = len(text.rstrip(" \t\r\n"))
    while at < end:
        found = _TOKEN.match(text, at)
        if not found:
            raise ValueError(f"no JSON at {at}")
        at = found.end()
        sign, string, number, word = found.groups()
        inside = isinstance(open_[-1], _Object)
        if want in ("value", "first") and (sign in ("{", "[") or sign is None):
            if sign:
                value = _Object() if sign == "{" else []
            else:
                value = json.loads(found.group(0)) if string is not None or number is not None else {"true": True, "false": False, "null": None}[word]
            open_[-1].append((name.pop(), value) if inside else value)
            if sign:
                open_.append(value)
                want = "member" if sign == "{" else "first"
            else:
                want = "next"
        elif want in ("member", "name") and string is not None:
            name.append(json.loads(found.group(0)))
            want = "colon"
        elif want == "colon" and sign == ":":
            want = "value"
        elif want == "next" and sign == "," and len(open_) > 1:
            want = "name" if inside else "value"
        elif len(open_) > 1 and ((sign == "}" and inside and want in ("member", "next")) or (sign == "]" and not inside and want in ("first", "next"))):
            open_.pop()
            want = "next"
        else:
            raise ValueError(f"no JSON at {at}")
    if len(open_) > 1 or len(whole) != 1:
        raise ValueError("cut")
    return whole[0]


def dewey_nodes(records: DataFrame, key: str, body: str, batch_nodes: int = 20_000) -> DataFrame:
    """Every node of JSON records of any depth, labelled in document order.

    Members get ordinals in text order (repeated names each their own), elements
    by position. ``schema_path`` joins member names with '.', ``[]`` for
    elements; '$' is the root, whose label is empty and whose parent is null. A
    null body is no record. A text that is not JSON gives one row of kind
    'invalid' with the text as value, so no record goes unseen. One Arrow pass,
    no shuffle. Unknown depth needs a walk that no built-in expression offers,
    hence Python; depth itself is not limited.
    """

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns: list[list] = [[] for _ in _NODE_COLUMNS]
        add = [c.append for c in columns]

        def made() -> pa.RecordBatch:
            kinds = [pa.string()] * 7 + [pa.int64()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=list(_NODE_COLUMNS))
            for c in columns:
                c.clear()
            return batch

        for batch in batches:
            for record_key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text is None:
                    continue
                try:
                    todo = [("", None, "$", None, parse_json(text))]
                except ValueError:
                    for put, value in zip(add, (record_key, "", None, "$", None, "invalid", text, 0)):
                        put(value)
                    continue
                while todo:
                    own, up, path, above, node = todo.pop()
                    inner: list = []
                    value = None
                    head = f"{own}." if own else ""
                    if isinstance(node, _Object):
                        kind = "object"
                        inner = [(f"{head}{i}", own, f"{path}.{m}", path, x) for i, (m, x) in enumerate(node)]
                    elif isinstance(node, list):
                        kind, below = "array", path + "[]"
                        inner = [(f"{head}{i}", own, below, path, x) for i, x in enumerate(node)]
                    elif isinstance(node, str):
                        kind, value = "str", node
                    else:
                        kind, value = "null" if node is None else type(node).__name__, json.dumps(node)
                    for put, x in zip(add, (record_key, own, up, path, above, kind, value, len(inner))):
                        put(x)
                    todo.extend(reversed(inner))
                    if len(columns[0]) >= batch_nodes:
                        yield made()
        if columns[0]:
            yield made()

    rows = records.select(F.col(key).cast("string").alias("k"), F.col(body).alias("b")).mapInArrow(label, _NODE_SCHEMA)
    numbers = lambda c: F.when(F.col(c) == "", F.expr("cast(array() AS array<int>)")).otherwise(F.split(c, "[.]").cast("array<int>"))
    return rows.select("record_key", numbers("label").alias("dewey"), numbers("parent_label").alias("parent_dewey"), *(c for c in _NODE_COLUMNS if c != "record_key"))


def node_summary(nodes: DataFrame) -> DataFrame:
    """Nodes of every schema path: ``n_nodes``, ``n_children`` that name one of them as parent, ``n_lost`` links that do not fit.

    Links are checked without bringing nodes together: what the nodes of a path
    say of their labels and numbers of children, and what children say of their
    parents' labels, are summed up as hashes of two halves, which agree only if
    every child's parent is there and has as many children as it says. Where
    they do not, ``n_lost`` is the difference in numbers, at least 1.
    """
    hashes = lambda c: [F.shiftrightunsigned(c, 33), F.col(c).bitwiseAND(2**31 - 1)]
    hashed = nodes.select("schema_path", "parent_path", "n_children", F.xxhash64("record_key", "label").alias("__own"), F.when(F.col("parent_label").isNotNull(), F.xxhash64("record_key", "parent_label")).alias("__up"))
    zero, one, n = F.lit(0).cast("bigint"), F.lit(1).cast("bigint"), F.col("n_children")
    own = F.struct(F.col("schema_path").alias("path"), one.alias("own"), n.alias("told"), zero.alias("met"), *((h * n).alias(f"h{i}") for i, h in enumerate(hashes("__own"))))
    up = F.struct(F.col("parent_path").alias("path"), zero.alias("own"), zero.alias("told"), one.alias("met"), *((-h).alias(f"h{i}") for i, h in enumerate(hashes("__up"))))
    said = hashed.select(F.explode(F.when(F.col("__up").isNull(), F.array(own)).otherwise(F.array(own, up))).alias("e")).select("e.*")
    summed = said.groupBy(F.col("path").alias("schema_path")).agg(*(F.sum(c).alias(c) for c in ("own", "told", "met", "h0", "h1")))
    lost = F.when((F.col("h0") == 0) & (F.col("h1") == 0) & (F.col("told") == F.col("met")), 0).otherwise(F.greatest(F.abs(F.col("told") - F.col("met")), F.lit(1)))
    return summed.select("schema_path", F.col("own").alias("n_nodes"), F.col("met").alias("n_children"), lost.cast("bigint").alias("n_lost"))
