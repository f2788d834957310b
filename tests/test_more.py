"""Twins, replies, benchmark spans, streaming state, models."""

import json
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom import __main__ as main
from spanloom.__main__ import parser
from spanloom.config import Config, DatasetConfig, ModelConfig, RuntimeConfig
from spanloom.functions.replies import ranked_names, tool_line
from spanloom.operators import benchmark, learn, ranking, sampling, traces, twins
from spanloom.streaming import assembler
from spanloom.streaming.assembler import Inflight, run_available


def pair(spans):
    """The rule one client after the other, on whole chains of ancestors; rows are dictionaries."""
    by_id = {r["span_id"]: r for r in spans}

    def chain(i):
        out, at = [], by_id[i]["up"]
        while at in by_id and at not in out:
            out.append(at)
            at = by_id[at]["up"]
        return out

    servers, clients = [], []
    for r in sorted((r for r in spans if r["tool"]), key=lambda r: (r["start"], r["span_id"])):
        above = [by_id[i] for i in chain(r["span_id"])]
        if r["server"] or any(x["server"] for x in above):
            servers.append(r)
        elif r["call"] or any(x["session"] for x in above):
            clients.append(r)

    def related(a, b):
        x, y = set(chain(a["span_id"])), set(chain(b["span_id"]))
        return a["span_id"] in y or b["span_id"] in x or any(by_id[i]["shared"] for i in x & y)

    left, gone = [], set()
    for c in clients:
        twin = next((s for s in servers if s["tool"] == c["tool"] and related(c, s)), None)
        if twin is None:
            left.append(c)
        else:
            servers.remove(twin)
            gone.add(c["span_id"])
    for c in left:
        if servers and c["tool"] == servers[0]["tool"]:
            gone.add(c["span_id"])
            servers.pop(0)
    return gone


KINDS = [("x", None), ("add.tool", "add"), ("sub.tool", "sub"), ("tools/call.tool", "add"), ("tools/call.tool", "sub"), ("mcp.server.call", None), ("mcp.client.session", None), ("mcp.list", None)]


def twin_spans(spark, rows):
    """rows: (trace, span, parent, name, tool, start)."""
    s = spark.createDataFrame(rows, "trace_id string, span_id string, parent_span_id string, name string, tool string, start long")
    return s.withColumn("attrs", F.from_json(F.lit("{}"), "map<string,string>")).withColumn("kind", F.lit(""))


def test_twins_against_the_plain_rule(spark):
    """Random forests of every shape in one table; among them deep chains, many calls of one top, calls outside the protocol."""
    rng, rows, want = random.Random(5), [], set()
    for t in range(120):
        n, kinds = rng.choice([4, 12, 40]), rng.choice([KINDS, KINDS[1:6], KINDS[3:7], KINDS[:5] + KINDS[5:6]])
        mine = []
        for i in range(n):
            up = None if i == 0 or rng.random() < 0.15 else f"{rng.randrange(max(0, i - rng.choice([1, 3, i])), i):03d}"
            name, tool = rng.choice(kinds)
            mine.append((f"t{t}", f"{i:03d}", up, name, tool, rng.randrange(n)))
        rows += mine
        marks = [{"span_id": i, "up": up, "start": at, "tool": tool, "server": "mcp.server" in name, "call": name == "tools/call.tool", "session": "mcp.client.session" in name, "shared": "mcp." in name} for _, i, up, name, tool, at in mine]
        want |= {(f"t{t}", i) for i in pair(marks)}
    got = [tuple(r) for r in twins.client_twins(twin_spans(spark, rows)).collect()]
    assert len(got) == len(set(got)) and len(want) > 50
    assert set(got) == want


def test_twins_of_large_traces_follow_the_same_rule(spark):
    """A session with 6000 calls and a server with as many: each call has its twin; a tool span below the session counts."""
    rows = [("t", "s", None, "mcp.client.session", None, 0), ("t", "v", None, "mcp.server.run", None, 0)]
    rows += [("t", f"c{i}", "s", "add.tool", "add", i) for i in range(6000)] + [("t", f"v{i}", "v", "add.tool", "add", i) for i in range(5999)]
    got = {r.span_id for r in twins.client_twins(twin_spans(spark, rows)).collect()}
    assert got == {f"c{i}" for i in range(5999)}
    chain = [("u", "0", None, "mcp.client.session", None, 0), ("u", "1", "0", "add.tool", "add", 1), ("u", "2", "1", "mcp.server.call", None, 2), ("u", "3", "2", "add.tool", "add", 3)]
    assert [r.span_id for r in twins.client_twins(twin_spans(spark, chain)).collect()] == ["1"]
    assert twins.client_twins(twin_spans(spark, [("u", "1", None, "add.tool", "add", 0)])) is None


@pytest.mark.parametrize("reply,want", [('["a", "b", "a"]', ["a", "b"]), ('```json\n{"tools": [{"name": "x"}, "y"]}\n```', ["x", "y"]), ('Sure: ["p", 3] done', ["p", "3"]), ('first "q" then "r"', ["q", "r"]), (None, []), ("nothing", []), ('{"other": ["a"]}', ["other", "a"])])
def test_ranked_names(reply, want):
    assert ranked_names(reply) == want


def test_tool_line(spark):
    long = " ".join(["word"] * 40)
    got = [r[0] for r in spark.createDataFrame([("t", long), ("u", None)], "n string, d string").select(tool_line("n", "d", F.lit(2))).collect()]
    assert got[0].endswith("word… [2 args]") and len(got[0]) < 140 and got[1] == "- u:  [2 args]"


def test_benchmark_trajectories(spark):
    calls = lambda *names: [{"id": n, "function": {"name": n, "arguments": "{}"}} for n in names]
    msgs = [{"role": "user", "content": "tutorial"}, {"role": "assistant", "tool_calls": calls("mail__old")}, {"role": "tool", "content": "old"}, {"role": "user", "content": "# Real Task Instruction pay"}, {"role": "assistant", "tool_calls": calls("shop__buy", "supervisor__x", "mail__send")}, {"role": "tool", "content": "ok"}, {"role": "tool", "content": "ctl"}]
    a = lambda **kw: json.dumps(kw)
    rows = [("t", a(**{"openinference.span.kind": "LLM", "llm.input_messages": json.dumps(msgs[:2])})), ("t", a(**{"openinference.span.kind": "LLM", "llm.input_messages": json.dumps(msgs)})), ("t", a(**{"openinference.span.kind": "TOOL", "tool.name": "mail__send", "output.value": "sent"})), ("t", a(**{"openinference.span.kind": "TOOL", "tool.name": "supervisor__complete_task"})), ("u", a(**{"openinference.span.kind": "TOOL", "tool.name": "shop__list", "output.value": "x"}))]
    s = spark.createDataFrame([(t, i, "n", x, i) for i, (t, x) in enumerate(rows)], "trace_id string, span_id long, name string, attributes string, position long")
    head, steps = benchmark.trajectories(s, ("# Real Task Instruction",))
    h = {r.task_id: r for r in head.collect()}
    got = [(r.trace_id, r.step_index, r.action, r.observation) for r in steps.orderBy("trace_id", "step_index").collect()]
    assert got == [("t", 0, "shop__buy", "ok"), ("t", 1, "mail__send", "sent"), ("u", 0, "shop__list", "x")]
    assert (h["t"].intent, h["t"].app_name, h["t"].success) == ("pay", "shop", True) and not h["u"].success
    assert {r.tool_name for r in benchmark.catalog(s).collect()} == {"mail__send", "shop__list"}


def test_inflight_rules():
    x = Inflight(RuntimeConfig(max_spans=2))
    x.add("llm", "a", 0)
    assert x.due() == (30_000, "idle")
    for t in range(20_000, 300_001, 20_000):
        x.add("tool", "b", t)
    assert x.due()[1] == "max_age" and len(x.spans) == 2 and x.dropped > 0
    x.add("root", "r", 300_000)
    assert x.due() == (302_000, "explicit") and [s for _, s in x.spans] == ["b", "r"]
    x.add("root", "r2", 301_000)
    assert x.due()[0] == 303_000 and [s for _, s in x.spans] == ["r", "r2"]
    dropped = x.dropped
    x.add("root", "r3", 301_000)  # nothing may go for it
    assert len(x.spans) == 3 and x.dropped == dropped
    x.close(303_000)
    assert x.forgotten_at() == 903_000 and not x.spans


LANDED = "delivery_id long, received_at timestamp, trace_id string, span_id string, parent_span_id string, name string, start_time_unix_nano long, end_time_unix_nano long, status_code string, attributes string, resource string, events array<string>"


def land(spark, folder, rows):
    """rows: (delivery id, second of arrival, trace, span, name, attributes)."""
    values = [(i, s, t, p, None, n, i, i + 1, "OK", a, "{}", []) for i, s, t, p, n, a in rows]
    spark.createDataFrame(values, LANDED.replace("received_at timestamp", "received_at long")).withColumn("received_at", F.timestamp_seconds("received_at")).coalesce(1).write.mode("append").parquet(str(folder))


def test_stream_closes_and_reports_late_spans(spark, tmp_path):
    t1, t2, t3 = "a1" * 16, "a2" * 16, "a3" * 16
    config = RuntimeConfig(prefix="own", remember_s=1000)

    def go(rows):
        land(spark, tmp_path / "in", rows)
        run_available(spark.readStream.schema(LANDED).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), config)

    go([(1, 100, t1, "01" * 8, "x", "{}"), (2, 101, t1, "02" * 8, "own.task", "{}"), (3, 100, t2, "03" * 8, "x", "{}"), (4, 120, t1, "05" * 8, "x", "{}")])
    go([(5, 200, t3, "04" * 8, "x", "{}"), (6, 140, t2, "06" * 8, "x", "{}")])
    go([(7, 900, t3, "07" * 8, "x", "{}")])
    got = {(r.trace_id, r.complete_reason, tuple(json.loads(s)["span_id"] for s in r.spans)) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert (t1, "explicit", ("01" * 8, "02" * 8)) in got and (t1, "late", ("05" * 8,)) in got and (t2, "idle", ("03" * 8,)) in got and (t3, "idle", ("04" * 8,)) in got
    assert assembler.stats(spark, str(tmp_path / "cp"))["seen"] == 3


def test_closed_traces_leave_the_state(spark, tmp_path):
    """Hundreds of traces come and go; what is held are those of the last minutes. A forgotten trace begins anew."""
    config, held = RuntimeConfig(remember_s=60), []
    for n in range(4):
        land(spark, tmp_path / "in", [(1000 * n + i, 1000 * n + i, f"{1000 * n + i:032x}", "01" * 8, "x", "{}") for i in range(0, 300, 3)] + [(9000 + n, 1000 * n, "ab" * 16, "02" * 8, "x", "{}")])
        run_available(spark.readStream.schema(LANDED).parquet(str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), config)
        held.append(assembler.open_states(spark, str(tmp_path / "cp")).count())
    assert max(held) < 150 and held[3] <= held[1]
    again = [r.complete_reason for r in spark.read.parquet(str(tmp_path / "out")).filter(F.col("trace_id") == "ab" * 16).collect()]
    assert again.count("idle") >= 3 and "late" not in again


def test_stream_to_gated_trajectories(spark, tmp_path):
    tool = json.dumps({"gen_ai.operation.name": "execute_tool", "gen_ai.tool.name": "f", "gen_ai.tool.call.result": "secret found"})
    task = lambda ok: json.dumps({"own.task_root": True, "own.intent": "do it", "own.success": ok, "own.task_id": f"tk-{ok}"})
    rows = []
    for n, (ok, steps) in enumerate([("true", 2), ("false", 1), ("true", 0), ("true", 1)]):
        t = f"{n + 1:032x}"
        rows += [(100 * n + k, 100 + k, t, f"{k + 1:016x}", "execute_tool f", tool) for k in range(steps)] + [(100 * n + 50, 110 if n < 3 else 500, t, "ff" * 8, "own.task", task(ok))]
    land(spark, tmp_path / "in", [*rows, (999, 500, f"{9:032x}", "01" * 8, "x", "{}")])
    cfg, out, cp = Config(runtime=RuntimeConfig(prefix="own")), str(tmp_path / "out"), str(tmp_path / "cp")
    hide = lambda d: d.withColumn("attributes", F.regexp_replace("attributes", "secret", "***"))
    assembler.run(spark.readStream.schema(LANDED).parquet(str(tmp_path / "in")), out, cp, cfg, event_time=True, redact=hide).awaitTermination()
    assembler.finish(assembler.flush(spark, cp, 501_000, cfg.runtime), out, "batch=flush", cfg)
    got = spark.read.json(f"{out}/trajectories/*")
    kept = {(r.task_id, len(r.spans), r.spans[0].observation) for r in got.collect()}
    assert kept == {("tk-true", 2, "*** found")} and got.count() == 1
    counters = {(r["name"], r.label): r.n for r in spark.read.parquet(f"{out}/counters/*").groupBy("name", "label").agg(F.sum("n").alias("n")).collect()}
    assert counters["traces_completed", "explicit"] == 3 and counters["traces_dropped", "zero_tool_spans"] >= 1 and counters["traces_dropped", "success_false"] == 1
    assert counters["traces_completed", "idle"] == 1 and counters["traces_completed", "late"] == 1  # the fourth trace's tool span, and its task span
    assert counters["traces_completed", "shutdown"] == 1


def test_models_rank_the_obvious(spark):
    rows = spark.createDataFrame([(f"t{i}", f"g{i % 6}", ("buy", "sell")[i % 2], tool, int(tool == ("buy_it", "sell_it")[i % 2]), float(tool == ("buy_it", "sell_it")[i % 2])) for i in range(60) for tool in ("buy_it", "sell_it", "wait")], "task_id string, task string, intent string, tool_name string, label int, tool_frequency double")
    cfg = ModelConfig(kind="logistic", max_terms=20, logistic={"c": 1.0, "maxIter": 20})
    model = learn.fit(rows, cfg)
    top = learn.shortlist(model, rows, 1, keep=("label",))
    assert top.filter("label = 0").count() == 0 and top.count() == 60
    with pytest.raises(ValueError):
        learn.estimator(ModelConfig(kind="?"), 1)
    with pytest.raises(ValueError):
        learn.feature_stages(rows.select("label"))


def test_text_weights_by_hand(spark):
    texts = ["Find the order, find it", "the order", None, "ÉTÉ x été"]
    rows = spark.createDataFrame([(i, t, "a b") for i, t in enumerate(texts)], "i int, intent string, tool_name string")
    idf = {w: math.log((1 + 4) / (1 + n)) + 1 for w, n in (("find", 1), ("the", 2), ("order", 2), ("it", 1), ("été", 1))}
    voc = {(r.column, r.term): (r.df, r.idf) for r in learn.vocabulary(rows, ["intent"], 9).collect()}
    assert {t: x[1] for (_, t), x in voc.items()} == pytest.approx(idf)
    assert len(learn.vocabulary(rows, ["intent"], 3).collect()) == 3
    m = learn.text_encoder("tfidf", ["intent", "tool_name"]).fit(rows)
    got = [r._intent_v for r in m.transform(rows.repartition(3)).orderBy("i").collect()]
    order = sorted(idf)
    want = np.zeros((4, 5))
    for i, t in enumerate(texts):
        words = [w for w in re.findall(r"\w\w+", (t or "").lower())]
        for w in set(words):
            want[i, order.index(w)] = (1 + math.log(words.count(w))) * idf[w]
        want[i] /= np.linalg.norm(want[i]) or 1
    assert np.allclose([v.toArray() for v in got], want)
    assert all(r._tool_name_v.size == 0 for r in m.transform(rows).collect())  # no word of two letters


def test_models_are_saved_and_loaded(spark, tmp_path):
    rows = spark.createDataFrame([(f"t{i}", ("buy", "sell")[i % 2], ("a", None)[i % 2], tool, int(tool == ("buy_it", "sell_it")[i % 2]), float(i)) for i in range(40) for tool in ("buy_it", "sell_it")], "task_id string, intent string, app_name string, tool_name string, label int, n_spans double")
    for cfg in (ModelConfig(kind="logistic", max_terms=20), ModelConfig(kind="gbt", max_terms=20, gbt={"maxIter": 3, "maxDepth": 2, "seed": 1})):
        model = learn.fit(rows, cfg)
        learn.save(model, cfg, str(tmp_path / cfg.kind))
        again, config = learn.load(str(tmp_path / cfg.kind))
        assert config == cfg
        score = lambda m: [(r.task_id, r.tool_name, r.score) for r in learn.predict(m, rows, ["task_id", "tool_name"]).orderBy("task_id", "tool_name").collect()]
        assert score(model) == score(again)
        top = learn.shortlist_one(again, spark, {"intent": "buy", "n_spans": 3}, [{"tool_name": "sell_it"}, {"tool_name": "buy_it"}], 1)
        assert [t for t, _ in top] == ["buy_it"]
    learn.save(model, cfg, str(tmp_path / "old"))
    spark.createDataFrame([('{"version": 1, "config": {}}',)], "value string").write.mode("overwrite").text(str(tmp_path / "old" / "about"))
    with pytest.raises(ValueError):
        learn.load(str(tmp_path / "old"))


def test_encoders(spark):
    rows = spark.createDataFrame([("ab",), (None,)], "intent string")
    dense = learn.text_encoder("auto", ["intent"], embed=lambda texts: np.array([[len(t), 1.0] for t in texts]))
    assert [list(r._intent_v.toArray()) for r in dense.transform(rows).collect()] == [[2, 1], [0, 1]]
    assert isinstance(learn.text_encoder("auto", ["intent"]), learn.TextWeights)
    with pytest.warns(UserWarning):
        assert isinstance(learn.text_encoder("dense", ["intent"]), learn.TextWeights)
    with pytest.raises(ValueError):
        learn.text_encoder("?", ["intent"])


def test_samplers_by_name(spark, monkeypatch):
    catalog = spark.createDataFrame([(f"t{i}", f"word{i % 3} thing {i}") for i in range(30)], "tool string, description string")
    tasks = spark.createDataFrame([(i, "a" if i % 2 else None, sorted({f"t{i % 7}", f"t{i % 5}"})) for i in range(40)] + [(99, "a", []), (100, "a", ["unknown"])], "record_id long, app string, tools array<string>")
    apps = spark.createDataFrame([("a", ["t1", "t2", "t3", "t20", "gone"])], "app string, tools array<string>")
    co = spark.createDataFrame([("t1", "t9", 4), ("t1", "t8", 4), ("t2", "t9", 1), ("t3", "gone", 9)], "tool_a string, tool_b string, n_together long")
    small = {}
    for name in sampling.SAMPLERS:
        got = sampling.negatives(tasks, catalog, apps, co, 6, DatasetConfig(sampler=name)).collect()
        small[name] = {r.record_id: r.negatives for r in got}
        for r in got:
            assert len(set(r.negatives)) == 6 and not set(r.negatives) & set(r.tools) and set(r.negatives) <= {f"t{i}" for i in range(30)}
    monkeypatch.setattr(sampling, "fits_broadcast", lambda *_: False)  # a catalog of any size gives the same
    for name in sampling.SAMPLERS:
        assert {r.record_id: r.negatives for r in sampling.negatives(tasks, catalog, apps, co, 6, DatasetConfig(sampler=name)).collect()} == small[name]
    monkeypatch.setitem(sampling.SAMPLERS, "mine", lambda t, cat, *_: t.withColumn("negatives", F.array(F.lit("t0"))))
    assert sampling.negatives(tasks, catalog, apps, co, 1, DatasetConfig(sampler=" Mine ")).first().negatives == ["t0"]
    with pytest.raises(ValueError):
        sampling.negatives(tasks, catalog, apps, co, 1, DatasetConfig(sampler="?"))


def test_metrics_of_lists_and_baselines(spark):
    lists = spark.createDataFrame([("a", ["x", None, "", "y", "x", "z"]), ("b", []), ("c", ["q"]), ("e", ["p"])], "task_id string, ranked array<string>")
    rel = spark.createDataFrame([("a", ["y", "z"]), ("b", ["y"]), ("c", []), ("d", ["z"])], "task_id string, relevant array<string>")
    got = {r.task_id: (r.r_precision, r.mrr, r.recall_1, r.recall_3) for r in ranking.list_metrics(lists, rel, (1, 3)).collect()}
    assert got == {"a": (0.5, 0.5, 0.0, 1.0), "b": (0, 0, 0, 0), "c": (0, 0, 0, 0)}
    r = ranking.random_scores(spark.createDataFrame([(f"t{i}", "x") for i in range(500)], "task_id string, tool_name string")).agg(F.min("score"), F.max("score"), F.avg("score")).first()
    assert 0 <= r[0] < 0.05 and 0.95 < r[1] < 1 and abs(r[2] - 0.5) < 0.05
    lat = spark.createDataFrame([("m", 1.0), ("m", 3.0), ("m", None), ("n", 2.0)], "method string, latency_ms double")
    assert {x.method: (x.n, x.mean_ms) for x in ranking.latency_means(lat).collect()} == {"m": (2, 2.0), "n": (1, 2.0)}
    name, n, ms = ranking.timed("m", 10, lambda: sum(range(1000)))
    assert (name, n) == ("m", 10) and 0 <= ms < 1000
    assert ranking.format_metrics({"b": 0.5, "a": 3}) == "a: 3\nb: 0.5000"
    groups = sampling.random_groups(spark.createDataFrame([(f"g{i % 50}",) for i in range(200)] + [(None,)], "g string"), "g", 12)
    assert groups.count() == 12 == groups.distinct().count()


def test_calibration_helps(spark):
    rows = spark.range(2000).select((F.col("id") % 4).alias("fold"), (F.rand(1) < F.pow(F.rand(2), 3)).cast("int").alias("label"), F.rand(2).alias("score"))
    rows = spark.createDataFrame(rows.toPandas())
    from spanloom.operators.ranking import ece, reliability

    before = ece(reliability(rows)).first()[0]
    for method in ("platt", "isotonic"):
        assert ece(reliability(learn.cross_calibrated(rows, method))).first()[0] < before / 2
    one = rows.withColumn("label", F.lit(1))
    assert learn.calibrated(one, one).select("score").first() == one.select("score").first()


def test_command_line(spark, tmp_path):
    """Trajectories in a file → dataset → model → report, through the command line's own functions."""
    a = parser().parse_args(["dataset", "--input", "x", "--output", "y", "--no-split"])
    assert a.command == "dataset" and a.no_split
    runs = [{"task_id": f"tk-{i // 2}", "intent": ("buy it", "sell it")[i % 2], "app_name": "shop", "success": i % 7 != 0, "metadata": "m", "success_source": "x", "spans": [{"action": ("buy", "sell")[i % 2]}, {"action": "wait"}]} for i in range(60)]
    (tmp_path / "t.jsonl").write_text("\n".join(map(json.dumps, runs)))
    (tmp_path / "c.json").write_text(json.dumps({f"tool{i}": "d" for i in range(5)} | {"buy": "buy things", "sell": None, "wait": ""}))
    cfg = Config(model=ModelConfig(kind="logistic", max_terms=30), dataset=DatasetConfig(sampler="mixed", n_splits=2, negative_ratio=2))
    at = lambda name: str(tmp_path / name)
    for fmt in ("parquet", "csv"):
        main.dataset(spark, parser().parse_args(["dataset", "--input", at("t.jsonl"), "--catalog", at("c.json"), "--output", at(f"d-{fmt}"), "--format", fmt]), cfg)
        main.train(spark, parser().parse_args(["train", "--dataset", at(f"d-{fmt}"), "--output", at("cv.json"), "--model", at("model"), "--format", fmt]), cfg)
        main.evaluate(spark, parser().parse_args(["evaluate", "--dataset", at(f"d-{fmt}"), "--output", at("report.json"), "--model", at("model"), "--format", fmt]), cfg)
        cv, report = (json.loads((tmp_path / f).read_text()) for f in ("cv.json", "report.json"))
        assert cv["mean"]["n_folds"] == 2 and len(cv["folds"]) == 2 and report["mrr"] > 0.7
    rows = spark.read.parquet(at("d-parquet"))
    assert rows.select("task_id").distinct().count() == 120  # every run of a task is its own decision
    assert not {r.task for r in rows.filter("part = 'train'").select("task").distinct().collect()} & {r.task for r in rows.filter("part = 'test'").select("task").distinct().collect()}
