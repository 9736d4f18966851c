"""Readers of source trees, configuration, diffs, specs, transcripts and captures."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def tree(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Files below ``root`` with content hash and extension; contents stay in the scan."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return raw.select("path", "modificationTime", "length", F.sha2("content", 256).alias("content_hash"), F.regexp_extract("path", r"\.([^./]+)$", 1).alias("ext"))


def texts(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """Whole files as text: ``path``, ``text``."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return raw.select("path", F.col("content").cast("string").alias("text"))


def hidden_texts(spark: SparkSession, root: str, prefix: str = ".env", most: int = 10_000) -> DataFrame:
    """Dot files, which file sources leave out, as ``path``, ``text``: small configuration, read by the driver.

    More than ``most`` of them is an error.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    listing, rows = fs.listFiles(path, True), []
    while listing.hasNext():
        at = listing.next().getPath()
        if at.getName().startswith(prefix):
            if len(rows) == most:
                raise ValueError(f"more than {most} files named {prefix}*")
            stream = fs.open(at)
            rows.append((at.toString(), jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
            stream.close()
    return spark.createDataFrame(rows, "path string, text string")


def changed_since(files: DataFrame, since: Column) -> DataFrame:
    """Number of files newer than the last index."""
    return files.filter(F.col("modificationTime") > since).agg(F.count("*").alias("n_changed"))


def fingerprint(files: DataFrame) -> DataFrame:
    """One hash of all (path, content hash), in any order of reading.

    Hashes of rows add up, so nothing is gathered; 128 bits against collisions.
    """
    h = lambda seed: F.sum(F.xxhash64(F.lit(seed), "path", "content_hash").cast("decimal(20,0)")).cast("string")
    return files.agg(F.sha2(F.concat_ws(":", F.count("*").cast("string"), h(1), h(2)), 256).alias("fingerprint"))


def config_values(files: DataFrame) -> DataFrame:
    """Variables of ``.env``, ``.tfvars`` and Kubernetes files: ``path``, ``line``, ``var``, ``value``.

    Comments and quotes go; a variable may have several values, in file order.
    Input: ``path``, ``text``.
    """
    lines = files.select("path", F.posexplode(F.split("text", "\r?\n")).alias("pos", "raw"))
    prior = F.lag("raw").over(_in_file())
    rows = lines.withColumn("prior", F.coalesce(prior, F.lit("")))
    env, tf = r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*?)\s*$", r"^\s*([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*?)\s*$"
    is_env, is_tf, is_yaml = F.col("path").rlike(r"(^|/)\.env[^/]*$|\.env$"), F.col("path").endswith(".tfvars"), F.col("path").rlike(r"\.ya?ml$")
    name = F.when(is_env, F.regexp_extract("raw", env, 1)).when(is_tf, F.regexp_extract("raw", tf, 1)).when(is_yaml, F.regexp_extract("prior", r"^\s*-?\s*name:\s*[\"']?([A-Z][A-Z0-9_]*)", 1)).otherwise("")
    value = F.when(is_yaml, F.regexp_extract("raw", r"^\s*value:\s*(.*?)\s*$", 1)).otherwise(F.regexp_extract("raw", env, 2))
    plain = F.regexp_replace(F.regexp_replace(F.col("v"), r"^([\"'])(.*)\1\s*(#.*)?$", "$2"), r"\s+#.*$", "")
    return rows.filter(~F.col("raw").rlike(r"^\s*#")).select("path", (F.col("pos") + 1).alias("line"), name.alias("var"), value.alias("v")).filter("var <> '' AND v <> ''").select("path", "line", "var", plain.alias("value"))


def _in_file():
    from pyspark.sql import Window

    return Window.partitionBy("path").orderBy("pos")


def diff_hunks(diffs: DataFrame) -> DataFrame:
    """Changed line spans of the new side of unified diffs: ``diff_id``, ``file``, ``start``, ``end``, ``deleted``.

    A hunk of pure deletion has an empty span: ``end`` is ``start`` - 1. Input:
    ``diff_id``, ``text``.
    """
    parts = diffs.select("diff_id", F.explode(F.split("text", r"(?m)^(?=diff --git |--- )")).alias("part")).filter(F.col("part").rlike(r"(?m)^\+\+\+ "))
    target = F.regexp_extract("part", r"(?m)^\+\+\+ (?:b/)?([^\t\n]+)", 1)
    source = F.regexp_extract("part", r"(?m)^--- (?:a/)?([^\t\n]+)", 1)
    file = F.when(target == "/dev/null", source).otherwise(target)
    heads = F.expr(r"regexp_extract_all(part, '(?m)^@@ -[0-9,]+ \\+([0-9]+(?:,[0-9]+)?) @@', 1)")
    each = parts.select("diff_id", file.alias("file"), (target == "/dev/null").alias("deleted"), F.explode(heads).alias("h"))
    start, count = F.split("h", ",")[0].cast("int"), F.coalesce(F.try_element_at(F.split("h", ","), F.lit(2)).cast("int"), F.lit(1))
    return each.select("diff_id", "file", start.alias("start"), (start + count - 1).alias("end"), "deleted")


_METHODS = {"get", "post", "put", "patch", "delete", "head", "options"}


def spec_channels(files: DataFrame) -> DataFrame:
    """Channels that interface specs declare: ``path``, ``kind``, ``key``, ``problem``.

    OpenAPI and AsyncAPI (JSON or YAML), protobuf services and GraphQL types. A
    file that cannot be read is a row with its problem. Input: ``path``, ``text``.
    """

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, text in zip(frame["path"], frame["text"]):
                try:
                    rows += [(path, kind, key, "") for kind, key in channels_of(path, text or "")]
                except Exception as e:  # a broken spec must not end the scan
                    rows.append((path, "", "", f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(rows, columns=["path", "kind", "key", "problem"])

    return files.select("path", "text").mapInPandas(parse, "path string, kind string, key string, problem string")


def channels_of(path: str, text: str) -> list[tuple[str, str]]:
    """(kind, raw key) of each operation of one spec."""
    if path.endswith(".proto"):
        package = re.search(r"(?m)^\s*package\s+([\w.]+)\s*;", text)
        prefix = f"{package[1]}." if package else ""
        out = []
        for service in re.finditer(r"\bservice\s+(\w+)\s*\{(.*?)\n\}", text, re.S):
            out += [("grpc", f"{prefix}{service[1]}/{m}") for m in re.findall(r"\brpc\s+(\w+)\s*\(", service[2])]
        return out
    if path.endswith((".graphql", ".gql")):
        out = []
        for kind in re.finditer(r"\btype\s+(?:Query|Mutation|Subscription)\b[^{]*\{(.*?)\n\}", text, re.S):
            out += [("graphql", m) for m in re.findall(r"(?m)^\s*(\w+)\s*(?:\([^)]*\))?\s*:", kind[1])]
        return out
    if text.lstrip().startswith("{"):
        spec = json.loads(text)
    else:
        import yaml  # only YAML specs need it

        spec = yaml.safe_load(text)
    if not isinstance(spec, dict):
        raise ValueError("no mapping")
    if "asyncapi" in spec:
        return [("async", str(c)) for c in (spec.get("channels") or {})]
    if "openapi" in spec or "swagger" in spec:
        base = str(spec.get("basePath") or "").rstrip("/")
        paths = spec.get("paths") or {}
        return [("http", f"{m.lower()} {base}{p}") for p, ops in paths.items() for m in (ops or {}) if m.lower() in _METHODS]
    raise ValueError("neither OpenAPI nor AsyncAPI")


def transcripts(rows: DataFrame) -> DataFrame:
    """Usage and named files of agent transcripts (``task_id``, ``text`` JSON)."""
    schema = "result string, duration_ms bigint, total_cost_usd double, usage struct<input_tokens bigint, output_tokens bigint>"
    read = rows.withColumn("t", F.from_json("text", schema))
    paths = F.expr(r"regexp_extract_all(t.result, '([A-Za-z0-9_.-]+(?:/[A-Za-z0-9_.-]+)+\\.[A-Za-z0-9]+)', 1)")
    return read.select(
        "task_id", "t.duration_ms", "t.total_cost_usd", "t.usage.input_tokens", "t.usage.output_tokens",
        F.array_sort(F.array_distinct(F.coalesce(paths, F.array()))).alias("files"),
    )


def exports(spark: SparkSession, folder: str) -> DataFrame:
    """Capture files as exports: whole JSON files, or one export a line."""
    raw = texts(spark, folder).withColumn("session", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
    bodies = F.when(F.col("text").rlike(r"(?s)^\s*\{.*\n\s*\{"), F.split("text", r"\n")).otherwise(F.array("text"))
    each = raw.select("path", "session", F.posexplode(bodies).alias("line", "body")).filter(F.trim("body") != "")
    return each.select(F.xxhash64("path", "line").alias("export_id"), "session", F.lit(None).cast("timestamp").alias("received_at"), "body")


def sessions(spark: SparkSession, folder: str) -> DataFrame:
    """Capture sessions by their ``meta.json``."""
    return spark.read.option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "meta.json").json(folder)


def cytoscape(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes and edges as UI elements, one JSON text each."""
    n = nodes.select(F.lit("nodes").alias("part"), F.to_json(F.struct(F.struct("id", "label", "type", "service").alias("data"))).alias("element"))
    e = edges.select(F.lit("edges").alias("part"), F.to_json(F.struct(F.struct("id", F.col("src").alias("source"), F.col("dst").alias("target"), "type").alias("data"))).alias("element"))
    return n.unionByName(e)


def mermaid(pairs: DataFrame, title: str = "graph LR", most: int = 500) -> str:
    """Text of a service or file graph (``src``, ``dst``, ``label``); at most ``most`` lines are drawn, the rest is counted."""
    total = pairs.count()
    rows = pairs.orderBy("src", "dst", "label").limit(most).collect()
    ids = {name: f"n{i}" for i, name in enumerate(sorted({x for r in rows for x in (r["src"], r["dst"])}))}
    safe = lambda s: s.replace('"', "'")
    lines = [title, *(f'  {i}["{safe(n)}"]' for n, i in ids.items()), *(f'  {ids[r["src"]]} -->|{safe(r["label"])}| {ids[r["dst"]]}' for r in rows)]
    return "\n".join(lines + ([f"  %% {total - most} more"] if total > most else [])) + "\n"


def review_comment(files: DataFrame, most_bytes: int = 60_000) -> str:
    """Markdown of impacted files (``service``, ``file``, ``n_nodes``, ``min_depth``), cut at whole lines to a size; the rest is counted.

    No line is shorter than 15 bytes, so no more rows are fetched than could fit.
    """
    total = files.count()
    head = f"### Impact: {total} files\n\n| file | service | nodes | depth |\n|---|---|---|---|\n"
    size, lines = len(head.encode()) + 40, []
    for r in files.orderBy("min_depth", "file", "service").limit(most_bytes // 15 + 1).collect():
        line = f"| {r['file']} | {r['service']} | {r['n_nodes']} | {r['min_depth']} |\n"
        if (size := size + len(line.encode())) > most_bytes:
            break
        lines.append(line)
    return head + "".join(lines) + (f"\n{total - len(lines)} more\n" if total > len(lines) else "")
