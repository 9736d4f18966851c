import json
import struct

import pytest

from flowskein.operators import nested
from flowskein.sources import otlp


def varint(n):
    n &= (1 << 64) - 1
    out = b""
    while n > 0x7F:
        out += bytes([n & 0x7F | 0x80])
        n >>= 7
    return out + bytes([n])


def field(number, value):
    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    if isinstance(value, float):
        return varint(number << 3 | 1) + struct.pack("<d", value)
    return varint(number << 3) + varint(value)


def fixed(number, value):
    return varint(number << 3 | 1) + struct.pack("<Q", value)


def attribute(key, value):
    return field(1, key.encode()) + field(2, value)


def export():
    nested_value = field(6, field(1, attribute("k", field(5, field(1, field(3, -5)) + field(1, field(2, 1))))))
    attributes = [attribute("a", field(1, "né".encode())), attribute("b", field(4, 1.5)), attribute("c", field(7, b"\x00\x01")), attribute("d", nested_value)]
    span = field(1, bytes(range(16))) + field(2, bytes(8)) + field(4, bytes([1] * 8)) + field(5, b"GET") + field(6, 2) + fixed(7, 2**63) + b"".join(field(9, a) for a in attributes)
    span += field(11, fixed(1, 7) + field(2, b"e")) + field(13, field(1, bytes(16)) + field(2, bytes(8))) + field(15, field(3, 1)) + field(99, b"unknown")
    return field(1, field(1, field(1, attribute("service.name", field(1, b"api")))) + field(2, field(1, field(1, b"lib")) + field(2, span) + field(2, field(5, b"second"))))


def test_messages_become_json():
    body = otlp.decode(export())
    span = body["resourceSpans"][0]["scopeSpans"][0]["spans"][0]
    assert span["traceId"] == bytes(range(16)).hex() and span["kind"] == 2 and span["startTimeUnixNano"] == str(2**63) and span["status"] == {"code": 1}
    values = {a["key"]: a["value"] for a in span["attributes"]}
    assert values["a"] == {"stringValue": "né"} and values["b"] == {"doubleValue": 1.5} and values["c"] == {"bytesValue": "AAE="}
    assert values["d"] == {"kvlistValue": {"values": [{"key": "k", "value": {"arrayValue": {"values": [{"intValue": "-5"}, {"boolValue": True}]}}}]}}
    assert span["events"] == [{"timeUnixNano": "7", "name": "e"}] and len(span["links"]) == 1
    assert otlp.decode(b"") == {}
    for bad in (export()[:-3], b"\x0b", b"\x08\x01", b"\xff" * 11):
        with pytest.raises(ValueError):
            otlp.decode(bad)


def test_captures_of_both_encodings(spark, tmp_path):
    folder = tmp_path / "cap" / "s1"
    folder.mkdir(parents=True)
    (folder / "a.pb").write_bytes(export())
    (folder / "b.json").write_text(json.dumps(otlp.decode(export())))
    (folder / "c.jsonl").write_text('{"resourceSpans": []}\n{"resourceSpans": []}\n')
    (folder / "d.pb").write_bytes(export()[:-3])
    (folder / "empty").write_bytes(b"")
    rows = otlp.captures(spark, str(tmp_path / "cap"))
    assert rows.count() == 5 and {r["session"] for r in rows.collect()} == {"s1"}
    assert [r["problem"] for r in rows.filter("problem <> ''").collect()] == ["ValueError: cut"]
    spans = nested.export_spans(rows).collect()
    assert sorted((r["span_pos"], r["span_id"], r["parent_span_id"], r["service"]) for r in spans) == sorted([(0, "0" * 16, "01" * 8, "api"), (1, "", "", "api")] * 2)
