"""Source texts to graph nodes by pattern packs: the extraction phase, inside the JVM.

A pack is a list of line patterns of one language; each match is a node whose
meta fields are the pattern's groups, and a line may hold several. Packs are
checked when they are loaded; own packs come as JSON (``load_packs``). Patterns
see one line at a time; what needs a syntax tree is out of their reach and
stays out (see README).
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowskein.functions.predicates import is_test_file


@dataclass(frozen=True)
class Pattern:
    """``regex`` with one group for each of ``fields``; the label is the field of that name, else all fields."""

    name: str
    lang: str
    exts: tuple[str, ...]
    node_type: str
    regex: str
    fields: tuple[str, ...]

    def __post_init__(self) -> None:
        if re.compile(self.regex).groups != len(self.fields) or not self.fields:
            raise ValueError(f"pattern {self.name}: {len(self.fields)} fields for other groups")
        if not self.exts or not all((self.name, self.lang, self.node_type)):
            raise ValueError(f"pattern {self.name!r}: a name, a language, a node type and extensions are needed")


_Q, _NQ = r"""["'`]""", r"""[^"'`]"""
_S = rf"{_Q}({_NQ}+){_Q}"  # a string
_VERBS = "get|post|put|patch|delete|head|options"


def _pack(lang: str, exts: tuple[str, ...], *rows: tuple[str, str, str, str]) -> tuple[Pattern, ...]:
    """Patterns of one language from (name, node type, fields, regex)."""
    return tuple(Pattern(name, lang, exts, kind, regex, tuple(fields.split())) for name, kind, fields, regex in rows)


JS = ("js", "jsx", "ts", "tsx", "mjs", "vue", "svelte")
TS = ("ts", "tsx")
PACKS: tuple[Pattern, ...] = (
    *_pack(
        "go", ("go",),
        ("go_func", "function", "label", r"^func ([A-Za-z_]\w*)\s*[\(\[]"),
        ("go_method", "method", "class label", r"^func \(\w*\s*(\*?\w+)[^)]*\) ([A-Za-z_]\w*)\("),
        ("go_struct", "struct", "label", r"^type (\w+) struct\b"),
        ("go_interface", "interface", "label", r"^type (\w+) interface\b"),
        ("go_const", "variable", "label value", r'^\s*(?:const )?([A-Z]\w*)\s*(?:string)?\s*=\s*"([^"]*)"'),
        ("go_handle_func", "http_handler", "method path", r'\.Handle(?:Func)?\("(?:([A-Z]+) )?(/[^"]*)"'),
        ("go_router", "http_handler", "method path", r'\.(GET|POST|PUT|PATCH|DELETE|Get|Post|Put|Patch|Delete)\("(/[^"]*)"'),
        ("gin_group", "route", "router path", r'(\w+)\s*:?=\s*\w+\.Group\("([^"]*)"'),
        ("gin_middleware_use", "variable", "router label", r"(\w+)\.Use\(\s*([\w.]+)"),
        ("go_http_client", "http_client", "method url", r'http\.(Get|Post|Head|PostForm)\("([^"]+)"'),
        ("go_new_request", "http_client", "method url", r'http\.NewRequest(?:WithContext)?\((?:\w+,\s*)?"?(?:http\.Method)?([A-Za-z]+)"?,\s*"([^"]+)"'),
        ("resty", "http_client", "method url", r'\.R\(\)[^"]*\.(Get|Post|Put|Patch|Delete)\("([^"]+)"'),
        ("go_kafka_publish", "publisher", "topic", r'Topic:\s*"([^"]+)"'),
        ("amqp_publish", "publisher", "exchange routing_key", r'\.Publish(?:WithContext)?\((?:\w+,\s*)?"([^"]*)",\s*"([^"]*)"'),
        ("amqp_consume", "subscriber", "queue", r'\.Consume\("([^"]+)"'),
        ("nats_publish", "publisher", "subject", r'\bnc?\.Publish\("([^"]+)",'),
        ("nats_subscribe", "subscriber", "subject", r'\bnc?\.(?:Queue)?Subscribe\("([^"]+)"'),
        ("redis_publish", "publisher", "channel", r'\.Publish\(ctx,\s*"([^"]+)",'),
        ("redis_subscribe", "subscriber", "channel", r'\.P?Subscribe\(ctx,\s*"([^"]+)"'),
        ("grpc_server_register", "grpc_handler", "service impl", r"\.?Register(\w+)Server\(\w+,\s*(.+)\)"),
        ("grpc_client_new", "grpc_client", "service", r"\.New(\w+)Client\("),
        ("go_sql", "table", "verb sql", r'\.(Query|QueryRow|Exec|QueryContext|QueryRowContext|ExecContext)\((?:\w+,\s*)?["`]([^"`]+)["`]'),
        ("gorm_model", "table", "label", r"\.(?:Model|Create|Save|Find|First|Delete)\(&(\w+)"),
        ("go_statement", "function", "label", r"^\s*go ([\w.]+)\("),
        ("cobra_command", "worker", "label", r'Use:\s*"([^"]+)"'),
        ("s3_call", "http_client", "operation", r"\.(PutObject|GetObject|DeleteObject|ListObjectsV2|HeadObject)\("),
        ("gorilla_upgrade", "http_handler", "label", r"(\w*[uU]pgrader)\.Upgrade\("),
        ("go_env", "variable", "label", r'os\.(?:Getenv|LookupEnv)\("([^"]+)"'),
    ),
    *_pack(
        "python", ("py",),
        ("py_func", "function", "label", r"^(?:async )?def (\w+)\("),
        ("py_class", "class", "label", r"^class (\w+)"),
        ("py_method", "method", "label", r"^\s+(?:async )?def (\w+)\(self"),
        ("py_route", "http_handler", "method path", rf"@\w+\.({_VERBS}|route|websocket)\({_Q}([^\"']+)"),
        ("django_path", "http_handler", "path view", rf"\b(?:re_)?path\(\s*r?{_Q}({_NQ}*){_Q},\s*([\w.]+)"),
        ("py_client", "http_client", "method url", rf"(?:requests|httpx|session|client)\.({_VERBS})\(\s*f?{_Q}([^\"']+)"),
        ("celery_task_delay", "publisher", "name", r"(\w+)\.(?:delay|apply_async)\("),
        ("celery_task_decorator", "subscriber", "name", r"@\w+\.task\((?:[^)]*name=[\"'])?([\w.]*)"),
        ("py_kafka_send", "publisher", "topic", rf"\.(?:send|produce)\({_S}"),
        ("py_import", "import", "label", r"^(?:from|import) ([\w.]+)"),
        ("py_env", "variable", "label", rf"os\.(?:environ\.get\(|environ\[|getenv\(){_Q}([A-Z][A-Z0-9_]*)"),
        ("sqlalchemy_table", "table", "label", rf"__tablename__\s*=\s*{_S}"),
    ),
    *_pack(
        "javascript", JS,
        ("js_function", "function", "label", r"^\s*(?:export )?(?:default )?(?:async )?function\s*\*?\s*(\w+)\s*\("),
        ("js_arrow", "function", "label", r"^\s*(?:export )?const (\w+)\s*=\s*(?:async )?\([^)]*\)\s*(?::[^=]+)?=>"),
        ("js_class", "class", "label", r"^\s*(?:export )?(?:default )?(?:abstract )?class (\w+)"),
        ("js_const", "variable", "label value", rf"^\s*(?:export )?const ([A-Z][A-Z0-9_]*)\s*=\s*{_S}"),
        ("js_import", "import", "label", rf"^\s*import\b.*?\bfrom\s+{_S}"),
        ("js_route", "http_handler", "method path", rf"\b(?:app|router|server|fastify)\.({_VERBS}|all)\(\s*{_Q}(/[^\"'`]*)"),
        ("express_middleware_use", "variable", "router label", r"\b(app|router)\.use\(\s*([A-Za-z_][\w.]*)"),
        ("js_client", "http_client", "method url", rf"\b(?:axios|http|api|\$http|\$)\.({_VERBS})\(\s*{_Q}([^\"'`]+)"),
        ("js_fetch", "http_client", "url", rf"\bfetch\(\s*{_Q}([^\"'`]+)"),
        ("xhr_open", "http_client", "method url", rf"\.open\(\s*{_Q}([A-Za-z]+){_Q},\s*{_Q}([^\"'`]+)"),
        ("jquery_ajax", "http_client", "url", rf"\$\.ajax\(\{{[^}}]*url:\s*{_Q}([^\"'`]+)"),
        ("eventsource_connect", "http_client", "url", rf"new EventSource\(\s*{_Q}([^\"'`]+)"),
        ("ws_new_connection", "http_client", "url", rf"new WebSocket\(\s*{_Q}([^\"'`]+)"),
        ("ws_onmessage_assign", "subscriber", "label", r"(\w+)\.onmessage\s*="),
        ("ws_on_message", "subscriber", "label", rf"(\w+)\.on\({_Q}message{_Q}"),
        ("pusher_subscribe_client", "subscriber", "channel", rf"\.subscribe\({_S}\)"),
        ("pusher_trigger", "publisher", "channel", rf"\.trigger\({_S},"),
        ("dom_by_id", "dom_ref", "value", rf"getElementById\({_S}\)"),
        ("dom_query", "dom_ref", "value", rf"querySelector(?:All)?\({_S}\)"),
        ("dom_create", "dom_ref", "value", rf"createElement\({_S}"),
        ("dom_listener", "dom_ref", "event", rf"addEventListener\({_S}"),
        ("graphql_operation", "graphql_client", "kind operation", r"\b(query|mutation|subscription) ([A-Z]\w*)"),
        ("js_env", "variable", "label", r"process\.env\.([A-Z][A-Z0-9_]*)"),
    ),
    *_pack(
        "typescript", TS,
        ("ts_interface", "interface", "label", r"^\s*(?:export )?interface (\w+)"),
        ("ts_type", "interface", "label", r"^\s*(?:export )?type (\w+)\s*(?:<[^>]*>)?\s*="),
        ("ts_enum", "class", "label", r"^\s*(?:export )?(?:const )?enum (\w+)"),
        ("nest_route", "http_handler", "method path", rf"@(Get|Post|Put|Patch|Delete)\({_Q}?({_NQ}*?){_Q}?\)"),
    ),
    *_pack(
        "ruby", ("rb",),
        ("rb_method", "method", "label", r"^\s*def (?:self\.)?(\w+[?!]?)"),
        ("rb_class", "class", "label", r"^\s*class ([A-Z]\w*(?:::\w+)*)"),
        ("rb_superclass", "reference", "label", r"^\s*class [A-Z][\w:]*\s*<\s*([A-Z][\w:]*)"),
        ("rb_module", "class", "label", r"^\s*module ([A-Z]\w*(?:::\w+)*)"),
        ("rb_include", "reference", "how label", r"^\s*(include|extend|prepend) ([A-Z][\w:]*)"),
        ("rb_route", "http_handler", "method path", rf"^\s*({_VERBS})\s+{_Q}([^\"']+)"),
        ("rb_resources", "http_handler", "kind label", r"^\s*(resources?)\s+:(\w+)"),
        ("rb_association", "reference", "kind label", r"^\s*(belongs_to|has_many|has_one|has_and_belongs_to_many)\s+:(\w+)"),
        ("rails_filter", "variable", "kind label", r"^\s*(before_action|after_action|around_action|skip_before_action)\s+:(\w+)"),
        ("rb_client", "http_client", "lib method", rf"\b(Faraday|HTTParty|RestClient|Net::HTTP)\.({_VERBS})\b"),
        ("aj_perform_later", "publisher", "job_class", r"(\w+)\.perform_(?:later|async)\b"),
        ("bunny_publish", "publisher", "routing_key", rf"\.publish\([^)]*routing_key:\s*{_S}"),
        ("rb_env", "variable", "label", rf"ENV(?:\.fetch\(|\[){_Q}([A-Z][A-Z0-9_]*)"),
    ),
    *_pack(
        "html", ("html", "htm", "erb", "templ", "vue", "svelte", "jsx", "tsx"),
        ("html_id", "element", "value", r'\bid="([^"{]+)"'),
        ("html_link", "http_client", "url", r'<a\b[^>]*\bhref="([^"#][^"]*)"'),
        ("html_form", "http_client", "url", r'<form\b[^>]*\baction="([^"]*)"'),
        ("html_event", "dom_ref", "event label", r'\bon(click|submit|change|input|load)="([^"]+)"'),
        ("html_script", "import", "label", r'<script\b[^>]*\bsrc="([^"]+)"'),
    ),
    *_pack("templ", ("templ",), ("templ_component", "component", "label", r"^templ (\w+)\(")),
    *_pack("css", ("css", "scss", "sass"), ("css_import", "import", "label", rf"@(?:import|use)\s+{_S}"), ("css_class", "element", "value", r"^\s*\.([A-Za-z_][\w-]*)\s*[,{]")),
    *_pack("sql", ("sql",), ("sql_table", "table", "label", r"(?i)^\s*create table (?:if not exists )?[\"`]?(\w+)"), ("sql_view", "table", "label", r"(?i)^\s*create (?:or replace )?view [\"`]?(\w+)")),
    *_pack("graphql", ("graphql", "gql"), ("graphql_type", "interface", "label", r"^type (\w+)"), ("graphql_input", "interface", "label", r"^input (\w+)")),
    *_pack("proto", ("proto",), ("proto_rpc", "grpc_handler", "label", r"^\s*rpc (\w+)\s*\("), ("proto_message", "struct", "label", r"^\s*message (\w+)"), ("proto_service", "class", "label", r"^\s*service (\w+)")),
)


def load_packs(text: str, base: tuple[Pattern, ...] = PACKS) -> tuple[Pattern, ...]:
    """Own packs after the built-in ones: a JSON list of patterns. Unknown fields, bad expressions and names that are taken are refused."""
    out = list(base)
    for raw in json.loads(text):
        if extra := set(raw) - set(Pattern.__dataclass_fields__):
            raise ValueError(f"unknown pattern field {sorted(extra)[0]!r}")
        made = Pattern(**(raw | {k: tuple(raw[k]) for k in ("exts", "fields") if k in raw}))
        if made.name in {p.name for p in out}:
            raise ValueError(f"pattern {made.name!r} is there already")
        out.append(made)
    return tuple(out)


def extract(files: DataFrame, service: str, packs: tuple[Pattern, ...] = PACKS) -> DataFrame:
    """Nodes that the packs find in ``path``, ``text``; test files are flagged in meta.

    Node ids are ``service:file:type:label:line``; of several patterns that make
    one id the first in the packs counts. Null texts give none. A pattern reads
    only the lines of its own extensions, all packs in one pass, and every match
    on a line is a node.
    """
    ext = F.regexp_extract("path", r"\.([^./]+)$", 1)
    lines = files.select("path", ext.alias("ext"), F.posexplode(F.split("text", "\r?\n")).alias("pos", "line"))

    def found(rank: int, p: Pattern) -> Column:
        groups = [F.regexp_extract_all("line", F.lit(p.regex), F.lit(i + 1)) for i in range(len(p.fields))]

        def node(at: Column, k: Column) -> Column:
            values = {f: F.coalesce(F.get(g, k), F.lit("")) for f, g in zip(p.fields, groups)}
            label = values.get("label", F.trim(F.concat_ws(" ", *values.values())))
            meta = F.map_from_arrays(F.array(F.lit("pattern"), *(F.lit(f) for f in values)), F.array(F.lit(p.name), *values.values()))
            return F.struct(F.lit(rank).alias("rank"), F.lit(p.node_type).alias("type"), label.alias("label"), F.lit(p.lang).alias("lang"), meta.alias("meta"))

        return F.when(F.col("line").rlike(p.regex), F.transform(groups[0], node))

    # patterns of the same extensions are tried together
    parts = []
    for exts in dict.fromkeys(p.exts for p in packs):
        own = F.flatten(F.array_compact(F.array(*(found(i, p) for i, p in enumerate(packs) if p.exts == exts))))
        parts.append(F.when(F.col("ext").isin(*exts), own))
    nodes = lines.filter(F.col("ext").isin(*sorted({e for p in packs for e in p.exts}))).select("path", "pos", F.explode(F.flatten(F.array_compact(F.array(*parts)))).alias("n"))
    test = F.when(is_test_file(F.col("path")), F.create_map(F.lit("is_test"), F.lit("true"))).otherwise(F.expr("cast(map() as map<string,string>)"))
    line = (F.col("pos") + 1).cast("int")
    rows = nodes.select(
        F.concat_ws(":", F.lit(service), "path", "n.type", "n.label", line).alias("id"), "n.type", "n.label", F.lit(service).alias("service"),
        F.col("path").alias("file"), line.alias("line"), F.lit(0).alias("end_line"), "n.lang", F.map_concat("n.meta", test).alias("meta"), "n.rank",
    )
    columns = [c for c in rows.columns if c not in ("id", "rank")]
    first = rows.groupBy("id").agg(F.min_by(F.struct(*columns), "rank").alias("n"))
    return first.select("id", *(f"n.{c}" for c in columns))
