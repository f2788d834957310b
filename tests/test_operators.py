"""Names, joins, traces, context, sampling and metrics on small literal cases."""

import json

import pytest
from pyspark.sql import functions as F

from spanloom.functions import attrs as A
from spanloom.functions import names as N
from spanloom.joins import asof_last, lookup
from spanloom.operators import corpus, ranking, sampling, traces


def one(spark, expr, **cols):
    schema = ", ".join(f"{c} string" for c in cols)
    return spark.createDataFrame([tuple(cols.values())], schema).select(expr).first()[0]


@pytest.mark.parametrize("raw,want", [("req-00000118/attempt-1", "req-118"), ("BENCH:291", "bench-291"), (" tk_007#2 ", "tk-7"), ("req 0", "req-0"), ("tk-00000012.retry2", "tk-12"), ("", None), (" ", None), (None, None), ("free text", "free text")])
def test_task_key(spark, raw, want):
    assert one(spark, N.task_key("x"), x=raw) == want


@pytest.mark.parametrize("raw,want", [("Ledger-Pilot 000", "ledgerpilot000"), ("N/A", None), ("not known", None), ("", None), (None, None)])
def test_app_key(spark, raw, want):
    assert one(spark, N.app_key("x"), x=raw) == want


@pytest.mark.parametrize("raw,want", [("Seal_Folio ({\"a\": \"(x)\"})", "seal_folio"), (" ", None), ("(x)", None), (None, None)])
def test_tool_name(spark, raw, want):
    assert one(spark, N.tool_name("x"), x=raw) == want


@pytest.mark.parametrize(
    "name,attrs,role,tool",
    [
        ("chat", {"gen_ai.operation.name": "embeddings", "traceloop.span.kind": "task"}, "skip", None),
        ("own.task", {}, "root", None),
        ("other.task", {}, "other", None),
        ("x", {"own.task_root": "true"}, "root", None),
        ("x", {"own.task_root": "false"}, "other", None),
        ("mcp_tools", {"openinference.span.kind": "TOOL"}, "skip", None),
        ("x", {"gen_ai.operation.name": "execute_tool", "gen_ai.tool.name": "f(1)"}, "tool", "f"),
        ("execute_tool look_up", {}, "tool", "look_up"),
        ("function.check", {}, "tool", "check"),
        ("function.check", {"traceloop.span.kind": "llm"}, "llm", None),
        ("tools/call.tool", {"traceloop.entity.input.tool_name": "add"}, "tool", "add"),
        ("x", {"traceloop.span.kind": "tool", "traceloop.entity.name": "seek"}, "tool", "seek"),
        ("x", {"gen_ai.operation.name": "chat"}, "llm", None),
        ("x", {"gen_ai.operation.name": "invoke_agent"}, "agent", None),
        ("x", {"gen_ai.operation.name": "execute_task"}, "task", None),
        ("x", {"traceloop.span.kind": "workflow"}, "agent", None),
        ("x", {}, "other", None),
    ],
)
def test_roles_and_tools(spark, name, attrs, role, tool):
    df = spark.createDataFrame([(name, json.dumps(attrs))], "name string, a string").withColumn("attrs", A.as_map("a"))
    r = df.select(A.role("own.").alias("role"), A.tool_of_span("own.").alias("tool")).first()
    assert r.role == role and (role != "tool" or r.tool == tool)


def test_the_collectors_prefix_is_found_or_set(spark):
    texts = ['{"ours.task_root": true}', '{"ours.task_root": 1, "x": 2}', '{"theirs.task_root" : true}', '{"a.task": 1}', "ours.task_root", None, ""]
    df = spark.createDataFrame([(t,) for t in texts], "attributes string")
    assert A.collector_prefix(df) == "ours." and A.collector_prefix(df.filter("attributes like '%a.task%'")) == ""
    spark.conf.set(A.PREFIX_SETTING, "theirs")
    assert A.collector_prefix(df) == "theirs."
    spark.conf.unset(A.PREFIX_SETTING)


def test_bad_attributes_are_empty(spark):
    df = spark.createDataFrame([(None,), ("",), ('{"a": "b', ), ("[1]",)], "a string")
    assert [len(r[0]) for r in df.select(A.as_map("a")).collect()] == [0, 0, 0, 0]


def test_lookup_hot_and_cold(spark):
    left = spark.createDataFrame([(1,)] * 30 + [(2,), (None,), (3,)], "k int")
    right = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    got = lookup(left, right, ["k"], hot_rows=10).groupBy("k", "v").count().collect()
    assert {(r.k, r.v, r["count"]) for r in got} == {(1, "a", 30), (2, "b", 1), (None, None, 1), (3, None, 1)}


def test_asof_over_buckets(spark):
    left = spark.createDataFrame([("a", t) for t in (0, 5, 9, 100, 1000)] + [("b", 7)], "g string, t long")
    right = spark.createDataFrame([("a", 5, "x"), ("a", 5, "y"), ("a", 95, "z"), ("c", 1, "q")], "g string, t long, v string")
    got = {(r.g, r.t): r.v for r in asof_last(left, right, "g", "t", "v", 10).collect()}
    assert got == {("a", 0): None, ("a", 5): "y", ("a", 9): "y", ("a", 100): "z", ("a", 1000): "z", ("b", 7): None}


REC = "record_id long, task_id string, app_name string, intent string, success boolean, score double, spans array<struct<agent_name:string,action:string,observation:string,thoughts:string>>, tools_used array<string>, metadata string, split_name string, recorded_at timestamp_ntz"


def record(i, actions, tools=None, **kw):
    spans = None if actions is None else [("a", x, f"o{n}", f"t{n}") for n, x in enumerate(actions)]
    d = {"task_id": f"tk-{i}", "app_name": "app", "intent": "do it", "success": True, "score": None, "metadata": '{"success_source": "association"}', "split_name": "train"} | kw
    return (i, d["task_id"], d["app_name"], d["intent"], d["success"], d["score"], spans, tools, d["metadata"], d["split_name"], None)


def test_context_sees_nothing_later(spark):
    actions = ["f(1)", None, "g", "f", "h"]
    recs = corpus.records(spark.createDataFrame([record(1, actions), record(2, actions[:4]), record(3, None), record(4, [])], REC))
    rows = {(r.record_id, r.k): r for r in corpus.contexts(recs).collect()}
    assert {k for i, k in rows if i == 1} == {0, 2, 3, 4} and not [1 for i, _ in rows if i in (3, 4)]
    r = rows[1, 4]
    assert (r.previous_tools, r.n_spans, r.last_action, r.last_thought, r.unique_tools_so_far, r.tool_diversity) == ("f | g | f", 4, "f", "t3", 2, 0.5)
    assert r.history_summary == "f→o0 | think→o1 | g→o2 | f→o3"
    for k in (0, 2, 3):  # cutting the trace changes nothing before the cut
        assert rows[1, k][2:] == rows[2, k][2:] or rows[1, k].previous_tools == rows[2, k].previous_tools


def test_success_rules(spark):
    rows = [record(1, [], success=None, score=0.9), record(2, [], success=None, score=1.0), record(3, [], success=None), record(4, [], success=False, score=1.0)]
    got = {r.record_id: r.success for r in corpus.records(spark.createDataFrame(rows, REC)).collect()}
    assert got == {1: False, 2: True, 3: True, 4: False}


def test_gate_order(spark):
    m = lambda src, t=None: json.dumps({"success_source": src} | ({"otel.trace_id": t} if t else {}))
    rows = [record(1, ["f"], intent=" "), record(2, [None]), record(3, ["f"], metadata=m("unknown")), record(4, ["f"], success=False), record(5, ["f"] * 3), record(6, ["f"], metadata=m("association", "t")), record(7, ["f"], metadata=m("association", "t")), record(8, ["f"], metadata=None)]
    got = {r.record_id: r.drop_reason for r in corpus.gate(corpus.records(spark.createDataFrame(rows, REC)), max_spans=2).collect()}
    assert got == {1: "missing_intent", 2: "zero_tool_spans", 3: "success_unknown", 4: "success_false", 5: "too_many_spans", 6: None, 7: "duplicate_trace", 8: "success_unknown"}


def test_negatives(spark):
    catalog = spark.createDataFrame([(f"t{i}", f"word{i % 3} thing") for i in range(12)], "tool string, description string")
    rows = spark.createDataFrame([(1, ["t0", "t1"]), (2, []), (3, [f"t{i}" for i in range(11)])], "record_id long, tools array<string>")
    a = {r.record_id: r.negatives for r in sampling.random_negatives(rows, catalog, "record_id", "tools", 4).collect()}
    b = {r.record_id: r.negatives for r in sampling.random_negatives(rows.repartition(3), catalog, "record_id", "tools", 4).collect()}
    assert a == b and len(set(a[1])) == 4 and not {"t0", "t1"} & set(a[1]) and a[3] == ["t11"]


def test_group_split_and_folds(spark):
    rows = spark.createDataFrame([(f"g{i}",) for i in range(101) for _ in range(1 + (i == 7) * 200)], "g string")
    parts = sampling.group_split(rows, "g").groupBy("part").count().collect()
    assert {r.part: r["count"] for r in parts} == {"test": 21, "train": 80}
    folds = sampling.group_kfold(rows, "g", 3).collect()
    assert len(folds) == 101 and {r.fold for r in folds} == {0, 1, 2}


def metrics(spark, y, s, tasks=None):
    rows = [(tasks[i] if tasks else "t", f"tool{i}", y[i], s[i]) for i in range(len(y))]
    return ranking.task_metrics(spark.createDataFrame(rows, "task_id string, tool_name string, label int, score double"), ks=(2,))


def test_ranking_metrics_by_hand(spark):
    s = [0.9, 0.8, 0.3, 0.2, 0.1]
    r = metrics(spark, [1, 1, 0, 0, 0], s).first()
    assert (r.r_precision, r.recall_2, r.ndcg_2, r.mrr) == (1, 1, 1, 1)
    assert metrics(spark, [0, 0, 1, 1, 0], s).first().r_precision == 0
    assert abs(metrics(spark, [1, 1, 1, 0, 0], [0.9, 0.3, 0.1, 0.8, 0.5]).first().recall_2 - 1 / 3) < 1e-12
    assert metrics(spark, [0, 0], [0.1, 0.2]).count() == 0


def test_auc_holm_curves(spark):
    rows = spark.createDataFrame([(1, 0.9), (0, 0.9), (1, 0.8), (0, 0.1)], "label int, score double")
    assert ranking.roc_auc(rows).first()[0] == 0.625
    assert ranking.roc_auc(rows.filter("label = 1")).first()[0] is None
    p = spark.createDataFrame([("a", 0.001), ("b", 0.002), ("c", 0.9)], "name string, p_value double")
    assert {r.name: r.reject for r in ranking.holm(p).collect()} == {"a": True, "b": True, "c": False}
    conf = spark.createDataFrame([("a", x, 1) for x in (0.95, 0.9, 0.85, 0.6, 0.5)], "task_id string, confidence double, correct int")
    c = ranking.risk_curve(conf, [0.9]).first()
    assert (c.coverage, c.risk) == (0.4, 0.0)
    curve = spark.createDataFrame([(0.0, 1.0, 0.5), (0.5, 0.8, 0.2), (1.0, 0.5, 0.0)], "tau double, coverage double, risk double")
    got = {r.target: r.coverage for r in ranking.coverage_at_risk(curve, [0.25, 0.01, -0.01]).collect()}
    assert got == {0.25: 0.8, 0.01: 0.5, -0.01: None}
    line = spark.createDataFrame([(0.0, 0.0, 1.0), (1.0, 1.0, 0.0)], "tau double, coverage double, risk double")
    assert ranking.curve_area(line).first()[0] == 0.5


def test_wrappers_fold_into_the_innermost(spark):
    spans = spark.createDataFrame([("t", "1", "f"), ("t", "2", "f"), ("t", "3", "f"), ("t", "4", "g")], "trace_id string, span_id string, tool string")
    trees = spark.createDataFrame([("t", "1", "1", 0, 3), ("t", "2", "1", 1, 1), ("t", "3", "1", 2, 2), ("t", "4", "1", 3, 3)], "trace_id string, span_id string, root_span_id string, lo long, hi long")
    assert sorted(r.span_id for r in traces.innermost_tools(spans, trees).collect()) == ["2", "3", "4"]


def test_a_group_over_many_ranges_keeps_its_order(spark):
    from spanloom.joins import next_in_order

    rows = [("a", i) for i in range(500)] + [("b", 3), ("c", 1), ("c", 2)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = {(r.g, r.x): r.y for r in next_in_order(spark.createDataFrame(rows, "g string, x long").repartition(5), ["g"], ["x"], "x", "y").collect()}
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(got) == 503 and all(y == (x + 1 if (g, x + 1) in got else None) for (g, x), y in got.items())


def test_too_many_hot_keys_are_salted(spark, monkeypatch):
    from spanloom import joins

    monkeypatch.setattr(joins, "BROADCAST_BYTES", 100)
    left = spark.createDataFrame([(i % 5,) for i in range(100)] + [(9,), (None,)], "k int")
    right = spark.createDataFrame([(i, f"v{i}") for i in range(10)], "k int, v string")
    got = [(r.k, r.v) for r in lookup(left, right, ["k"], hot_rows=10).collect()]
    assert len(got) == 102 and all(v == (None if k is None else f"v{k}") for k, v in got)


def test_assistant_text_and_indexed_messages(spark):
    out = [{"role": "assistant", "parts": [{"type": "text", "content": "first"}, {"type": "tool_call", "name": "f"}, {"type": "text", "content": "later"}]}, {"role": "assistant", "content": "plain"}, {"role": "user", "content": "no"}]
    rows = [({"gen_ai.output.messages": out},), ({"gen_ai.completion": "done"},), ({"llm.completions": [{"text": "a"}, {"text": "b"}]},), ({"llm.input_messages.10.message.content": "z", "llm.input_messages.2.message.content": "y"},)]
    df = spark.createDataFrame([(i, json.dumps(a[0])) for i, a in enumerate(rows)], "i int, a string").withColumn("attrs", A.as_map("a"))
    got = df.orderBy("i").select(A.assistant_text().alias("t"), F.transform(A.input_messages(), A.message_text).alias("m")).collect()
    assert [r.t for r in got] == ["first plain", "done", "a, b", ""] and got[3].m == ["y", "z"] and got[0].m is None


def test_calls_of_the_output_follow(spark):
    inp = [{"role": "assistant", "tool_calls": [{"id": "a", "name": "f"}, {"name": "g"}, {"name": "g"}]}, {"role": "tool", "tool_call_id": "a", "content": "seen"}]
    inp[0]["tool_calls"] += [{"name": "g", "arguments": '{"a": 1, "b": {"d": 2, "c": 3}}'}, {"name": "g", "arguments": '{"b":{"c":3,"d":2},"a":1}'}]  # the same in another order
    out = [{"role": "assistant", "tool_calls": [{"id": "a", "name": "f"}, {"id": "b", "name": "h"}, {"name": "k"}]}]
    rows = [("t", "1", None, 0, "llm", None, json.dumps({"gen_ai.input.messages": inp, "gen_ai.output.messages": out}))]
    df = spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string, start long, role string, tool string, a string").withColumn("attrs", A.as_map("a"))
    got = [(r.tool, r.call_id, r.observation) for r in traces.message_decisions(df).orderBy("message", "place").collect()]
    assert got == [("f", "a", "seen"), ("g", "", ""), ("g", "", ""), ("h", "b", "")]
