"""Captured OTLP exports in protobuf encoding, as the JSON that every other operator reads.

The wire format has no built-in reader here: files are decoded in Arrow batches,
one pass, by a table of the messages' fields. Field numbers are those of the
public trace protocol.
"""

from __future__ import annotations

import base64
import json
import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Messages as {field number: (JSON name, kind, repeated)}; a kind that is a message's name is one.
MESSAGES = {
    "Export": {1: ("resourceSpans", "ResourceSpans", True)},
    "ResourceSpans": {1: ("resource", "Resource", False), 2: ("scopeSpans", "ScopeSpans", True), 3: ("schemaUrl", "text", False)},
    "Resource": {1: ("attributes", "KeyValue", True), 2: ("droppedAttributesCount", "int", False)},
    "ScopeSpans": {1: ("scope", "Scope", False), 2: ("spans", "Span", True), 3: ("schemaUrl", "text", False)},
    "Scope": {1: ("name", "text", False), 2: ("version", "text", False), 3: ("attributes", "KeyValue", True), 4: ("droppedAttributesCount", "int", False)},
    "Span": {
        1: ("traceId", "hex", False), 2: ("spanId", "hex", False), 3: ("traceState", "text", False), 4: ("parentSpanId", "hex", False), 5: ("name", "text", False), 6: ("kind", "int", False),
        7: ("startTimeUnixNano", "long", False), 8: ("endTimeUnixNano", "long", False), 9: ("attributes", "KeyValue", True), 10: ("droppedAttributesCount", "int", False), 11: ("events", "Event", True),
        12: ("droppedEventsCount", "int", False), 13: ("links", "Link", True), 14: ("droppedLinksCount", "int", False), 15: ("status", "Status", False), 16: ("flags", "int", False),
    },
    "Event": {1: ("timeUnixNano", "long", False), 2: ("name", "text", False), 3: ("attributes", "KeyValue", True), 4: ("droppedAttributesCount", "int", False)},
    "Link": {1: ("traceId", "hex", False), 2: ("spanId", "hex", False), 3: ("traceState", "text", False), 4: ("attributes", "KeyValue", True), 5: ("droppedAttributesCount", "int", False), 6: ("flags", "int", False)},
    "Status": {2: ("message", "text", False), 3: ("code", "int", False)},
    "KeyValue": {1: ("key", "text", False), 2: ("value", "Any", False)},
    "Any": {1: ("stringValue", "text", False), 2: ("boolValue", "bool", False), 3: ("intValue", "signed", False), 4: ("doubleValue", "double", False), 5: ("arrayValue", "List", False), 6: ("kvlistValue", "Map", False), 7: ("bytesValue", "bytes", False)},
    "List": {1: ("values", "Any", True)},
    "Map": {1: ("values", "KeyValue", True)},
}


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise ValueError("cut or overlong number")
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at += 1
        if byte < 0x80:
            return value, at
        shift += 7


def _plain(kind: str, wire: int, raw: int | bytes):
    if wire == 2:
        assert isinstance(raw, bytes)
        return raw.decode("utf-8", "replace") if kind == "text" else raw.hex() if kind == "hex" else base64.b64encode(raw).decode()
    if kind == "double":
        return struct.unpack("<d", raw)[0] if isinstance(raw, bytes) else float(raw)
    number = int.from_bytes(raw, "little") if isinstance(raw, bytes) else raw
    if kind == "bool":
        return bool(number)
    if kind == "signed" and number >= 1 << 63:
        number -= 1 << 64
    return str(number) if kind in ("long", "signed") else number  # JSON has 64-bit numbers as text


def decode(data: bytes, message: str = "Export") -> dict:
    """One message as its JSON object; fields that are not known are passed over. Raises ``ValueError``."""
    out: dict = {}
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        number, wire = tag >> 3, tag & 7
        raw: int | bytes
        if wire == 0:
            raw, at = _varint(data, at)
        elif wire in (1, 2, 5):
            size, at = (8, at) if wire == 1 else (4, at) if wire == 5 else _varint(data, at)
            if at + size > len(data):
                raise ValueError("cut")
            raw, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {wire}")
        if number not in MESSAGES[message]:
            continue
        name, kind, many = MESSAGES[message][number]
        if (wire == 2) != (kind in MESSAGES or kind in ("text", "hex", "bytes")):
            raise ValueError(f"field {name} of wire type {wire}")
        value = decode(bytes(raw), kind) if kind in MESSAGES else _plain(kind, wire, raw)
        if many:
            out.setdefault(name, []).append(value)
        else:
            out[name] = value
    return out


def decoded(files: DataFrame) -> DataFrame:
    """``path``, ``content`` (protobuf) to ``path``, ``body`` (JSON), ``problem``; what cannot be read is a row with its problem and no body."""

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for path, content in zip(frame["path"], frame["content"]):
                try:
                    rows.append((path, json.dumps(decode(bytes(content))), ""))
                except (ValueError, RecursionError) as e:
                    rows.append((path, None, f"{type(e).__name__}: {e}"[:200]))
            yield pd.DataFrame(rows, columns=["path", "body", "problem"])

    return files.select("path", "content").mapInPandas(read, "path string, body string, problem string")


def captures(spark: SparkSession, folder: str) -> DataFrame:
    """Capture files of either encoding as exports: ``export_id``, ``session`` (the folder), ``received_at``, ``body``, ``problem``.

    A file that begins with a brace is JSON, whole or one export a line, any
    other protobuf. Empty files give nothing.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).filter("length > 0")
    is_text = F.col("content").cast("string").rlike(r"^\s*\{")
    text = raw.filter(is_text).select("path", F.col("content").cast("string").alias("t"))
    bodies = F.when(F.col("t").rlike(r"(?s)^\s*\{.*\n\s*\{"), F.split("t", r"\n")).otherwise(F.array("t"))
    each = text.select("path", F.posexplode(bodies).alias("line", "body")).filter(F.trim("body") != "").withColumn("problem", F.lit(""))
    binary = decoded(raw.filter(~is_text)).select("path", F.lit(0).alias("line"), "body", "problem")
    session = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    return each.unionByName(binary).select(F.xxhash64("path", "line").alias("export_id"), session.alias("session"), F.lit(None).cast("timestamp").alias("received_at"), "body", "problem")
