"""Readers and writers on files of our own."""

import gzip
import json
import struct

import pytest
from pyspark.sql import functions as F

from spanloom import config
from spanloom.functions import attrs as A
from spanloom.operators import traces
from spanloom.sources import files, sinks


def test_trajectories(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.jsonl").write_text('{"task_id": "1", "intent": "i", "steps": [{"action": "f(1)"}, "g"], "score": 0.5, "extra": 3}\n\nnot json\n{"task_id": "2", "steps": null}\n')
    (tmp_path / "y.json").write_text(json.dumps([{"task_id": "3", "success": 1, "steps": ["h"]}, {"task_id": "4", "success": False}]))
    f = config.merged(config.FieldMap(), {"spans": "steps"})
    got = {r.task_id: r for r in files.read_trajectories(spark, str(tmp_path), f).collect()}
    assert {k: r.success for k, r in got.items()} == {"1": False, "2": True, "3": True, "4": False}
    assert [s.action for s in got["1"].spans] == ["f(1)", "g"] and json.loads(got["1"].metadata) == {"extra": "3"}
    assert files.read_trajectories(spark, str(tmp_path), f, success_only=True).count() == 2
    sinks.write_trajectories(files.read_trajectories(spark, str(tmp_path), f), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).filter("metadata.success_source = 'unknown'").count() == 4


def kv(k, **v):
    return {"key": k, "value": v}


def test_otlp_json(spark, tmp_path):
    span = {"traceId": "ab" * 16, "spanId": "cd" * 8, "name": "x.tool", "startTimeUnixNano": "5", "status": {"code": 2}, "attributes": [kv("n", intValue="3"), kv("l", arrayValue={"values": [{"boolValue": True}]}), {"value": {}}], "events": [{"name": "e"}]}
    (tmp_path / "r.json").write_text(json.dumps({"resourceSpans": [{"resource": {"attributes": [kv("service.name", stringValue="svc")]}, "scopeSpans": [{"spans": [span]}]}]}))
    r = files.read_otlp(spark, str(tmp_path)).collect()
    assert len(r) == 1 and json.loads(r[0].attributes) == {"n": 3, "l": [True]} and r[0].status_code == "ERROR" and r[0].start_time_unix_nano == 5
    assert json.loads(r[0].events[0])["name"] == "e" and json.loads(r[0].resource) == {"service.name": "svc"}


def field(n, b):
    return bytes([n << 3 | 2]) + (bytes([len(b)]) if len(b) < 128 else bytes([len(b) & 127 | 128, len(b) >> 7])) + b


def test_otlp_protobuf(spark, tmp_path):
    attr = field(1, b"k") + field(2, bytes([3 << 3, 7]))
    s = field(1, b"\xab" * 16) + field(2, b"\xcd" * 8) + field(5, b"name") + bytes([7 << 3 | 1]) + struct.pack("<Q", 9) + field(9, attr) + field(15, bytes([3 << 3, 1]))
    body = field(1, field(1, field(1, field(1, b"service.name") + field(2, field(1, b"svc")))) + field(2, field(2, s)))
    (row,) = files.otlp_proto_spans(body)
    assert row[0] == "ab" * 16 and row[3] == "name" and row[4] == "9" and row[6] == "OK" and json.loads(row[7]) == {"k": 7} and json.loads(row[8]) == {"service.name": "svc"}
    with pytest.raises(ValueError):
        list(files.otlp_proto_spans(body[:-3]))
    (tmp_path / "r.pb").write_bytes(body)
    (tmp_path / "bad.pb").write_bytes(b"\xff\xff")
    assert files.read_otlp(spark, str(tmp_path)).select("span_id").collect()[0][0] == "cd" * 8


def trace(name, spans):
    return {"trace_id": name, "spans": spans}


def sp(i, parent=None, name="x", start=0, **attrs):
    return {"span_id": i, "parent_span_id": parent, "name": name, "start_time_unix_nano": start, "end_time_unix_nano": start + 1, "attributes": attrs}


def test_projection_of_assembled_traces(spark, tmp_path):
    props = {"traceloop.association.properties": json.dumps({"task_id": "ticket-1", "success": True, "app_name": "shop"}), "own.task_root": True, "own.intent": "find the order"}
    tool = {"gen_ai.operation.name": "execute_tool", "gen_ai.tool.name": "lookup_order", "gen_ai.tool.call.arguments": '{"arguments": "id=1"}', "gen_ai.tool.call.result": {"found": 1}}
    call = [{"role": "user", "content": "mail please"}, {"role": "assistant", "parts": [{"type": "tool_call", "id": "a", "name": "search_emails", "arguments": "{}"}]}, {"role": "tool", "tool_call_id": "a", "content": "none"}, {"role": "assistant", "tool_calls": [{"id": "a", "function": {"name": "search_emails"}}]}]
    data = [
        trace("a1" * 16, [sp("01" * 8, name="own.task", **props), sp("02" * 8, "01" * 8, "invoke_agent", 1, **{"gen_ai.operation.name": "invoke_agent", "gen_ai.agent.name": "Support"}), sp("03" * 8, "02" * 8, "execute_tool lookup_order", 2, **tool)]),
        trace("a2" * 16, [sp("01" * 8, name="crew.agent", **{"traceloop.span.kind": "agent", "own.success": "no"}), sp("02" * 8, "01" * 8, "chat", 1, **{"gen_ai.operation.name": "chat", "gen_ai.input.messages": json.dumps(call)})]),
        trace("a3" * 16, [sp("01" * 8, name="chat", **{"gen_ai.operation.name": "chat", "gen_ai.input.messages": json.dumps(call[:1])})]),
    ]
    (tmp_path / "t.jsonl").write_text("\n".join(map(json.dumps, data)))
    fields, steps = traces.project(files.read_traces(spark, str(tmp_path)))
    f = {r.trace_id[:2]: r for r in fields.collect()}
    s = {r.trace_id[:2]: r for r in steps.collect()}
    assert (f["a1"].task_id, f["a1"].intent, f["a1"].success, f["a1"].app_name, f["a1"].framework, f["a1"].drop_reason) == ("ticket-1", "find the order", True, "shop", "langchain", None)
    assert (s["a1"].action, s["a1"].agent_name, s["a1"].arguments) == ("lookup_order", "Support", "id=1") and json.loads(s["a1"].observation) == {"found": 1}
    assert (f["a2"].intent, f["a2"].success, f["a2"].success_source, f["a2"].drop_reason) == ("mail please", False, "association", None)
    assert (s["a2"].action, s["a2"].observation, s["a2"].origin) == ("search_emails", "none", "llm_fallback") and steps.count() == 2
    assert f["a3"].drop_reason == "success_unknown"


def test_specs_catalog_results(spark, tmp_path):
    fn = {"type": "function", "function": {"name": "shop__buy", "description": "d", "parameters": {"properties": {"n": {"type": "integer"}, "c": {"type": "array", "items": {"type": "string"}, "enum": ["a"]}}}}}
    (tmp_path / "shop.json").write_text(json.dumps([fn]))
    (tmp_path / "supervisor.json").write_text(json.dumps({"functions": [fn]}))
    (r,) = files.read_api_specs(spark, str(tmp_path)).collect()
    assert (r.tool_name, r.app, len(r.parameters)) == ("shop__buy", "shop", 2)
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "cat.json").write_text('{"a": "x", "b": null}')
    assert {(r.tool_name, r.description) for r in files.read_catalog(spark, str(tmp_path / "c")).collect()} == {("a", "x"), ("b", "")}
    (tmp_path / "c" / "res.json").write_text('{"tasks": {"t": {"ranked": ["a", "b"], "cost_usd": 0.1, "latency_ms": 5}}}')
    assert files.read_results(spark, str(tmp_path / "c" / "res.json")).first().ranked == ["a", "b"]


def test_config_and_reports(tmp_path):
    p = tmp_path / "c.json"
    p.write_text(json.dumps({"gate": {"max_spans": 5}, "projection": {"drop_tools": ["x"]}, "model": {"gbt": {"maxIter": 3}}}))
    c = config.load(str(p))
    assert c.gate.max_spans == 5 and c.projection.drop_tools == ("x",) and c.model.gbt["maxIter"] == 3 and c.model.gbt["maxDepth"] == 8
    with pytest.raises(ValueError):
        config.merged(config.Config(), {"nope": 1})
    sinks.write_report({"a": 1}, str(tmp_path / "d" / "r.json"))
    assert json.loads((tmp_path / "d" / "r.json").read_text()) == {"a": 1}
    assert sinks.metrics_text({("kept", None): 2, ("dropped", "late"): 1}) == 'spanloom_dropped{reason="late"} 1\nspanloom_kept 2\n'


def test_request_bodies_by_type_and_encoding(spark):
    good = {"resourceSpans": [{"scopeSpans": [{"spans": [{"traceId": "ab" * 16, "spanId": "01" * 8, "name": "x"}]}]}]}
    text = json.dumps(good).encode()
    rows = [
        (text, "application/json", None), (gzip.compress(text), "Application/JSON; charset=utf-8", "gzip"), (text, "application/json", "br"), (text, "text/plain", ""), (b"{", "application/json", ""), (text, "application/json", "gzip"),
        (None, "application/x-protobuf", ""), (b"\xff\xff", "application/x-protobuf", ""), (b"[1]", None, None),
    ]
    spans, refused = files.read_bodies(spark.createDataFrame([(None if b is None else bytearray(b), t, e) for b, t, e in rows], "body binary, content_type string, content_encoding string"))
    assert [(r.trace_id, r.name) for r in spans.collect()] == [("ab" * 16, "x")] * 2
    assert sorted(r.status for r in refused.collect()) == [400, 400, 400, 415, 415, 415]


def test_spans_are_written_and_read_again(spark, tmp_path):
    df = spark.createDataFrame([("ab" * 16, "01" * 8, None, "x", 5, 6, "OK", '{"a": 1, "b": {"c": "d"}}', None, ['{"name": "e"}'])], "trace_id string, span_id string, parent_span_id string, name string, start_time_unix_nano long, end_time_unix_nano long, status_code string, attributes string, resource string, events array<string>")
    sinks.write_spans(df, str(tmp_path / "s.jsonl"))
    (r,) = files.read_traces(spark, str(tmp_path / "s.jsonl")).collect()
    assert (r.trace_id, r.span_id, r.name, r.start_time_unix_nano, r.status_code) == ("ab" * 16, "01" * 8, "x", 5, "OK")
    assert json.loads(r.attributes) == {"a": "1", "b": '{"c":"d"}'} and json.loads(r.events[0]) == {"name": "e"}


def test_results_replace_each_other(spark, tmp_path):
    for cost in (0.1, 0.2):
        df = spark.createDataFrame([("t", ["a"], cost, 5.0)], "task_id string, ranked array<string>, cost_usd double, latency_ms double")
        sinks.write_results(df, str(tmp_path / "results"))
    assert [r.cost_usd for r in files.read_results(spark, str(tmp_path / "results")).collect()] == [0.2]
    assert not (tmp_path / "results.part").exists()


def test_private_files_tables_and_loaders(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([("t", "i", True, "{}")], "task_id string, intent string, success boolean, metadata string")
    sinks.append_private(df, str(tmp_path / "out"))
    sinks.append_private(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    modes = {oct(p.stat().st_mode & 0o777) for p in (tmp_path / "out").rglob("*.json")}
    assert modes == {"0o600"} and oct((tmp_path / "out").stat().st_mode & 0o777) == "0o700"
    assert sinks.metrics_table([{"m": "a", "v": 0.25}, {"m": "bcd", "v": None}]) == "m         v\na    0.2500\nbcd"
    sinks.write_json(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "j"))
    assert '"b":null' in "".join(p.read_text() for p in (tmp_path / "j").glob("*.json"))
    with pytest.raises(ValueError):
        files.load(spark, "x", "mine")
    monkeypatch.setitem(files.LOADERS, "mine", lambda s, path: df)
    with pytest.raises(ValueError):
        files.load(spark, "x", "mine")
    monkeypatch.setitem(files.LOADERS, "mine", lambda s, path: df.selectExpr("*", "'a' AS app_name", "array() AS spans", "array() AS tools_used"))
    assert files.load(spark, "x", "mine", success_only=True).count() == 1
