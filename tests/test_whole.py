"""Registered queries and operators do the whole job: no shorter texts, fewer replicates or other methods than the defaults."""

import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.operators import ranking
from spanloom.plans import evaluation
from spanloom.plans import traces as trace_plans

SPANS = "delivery_id long, batch_id long, received_at timestamp, trace_id string, span_id string, parent_span_id string, name string, start_time_unix_nano long, end_time_unix_nano long, status_code string, attributes string, resource string, events array<string>"


def write_spans(spark, folder, attributes):
    """A table of tool spans, one per text of attributes, in one trace."""
    df = spark.createDataFrame([(i, a) for i, a in enumerate(attributes)], "i long, attributes string")
    values = {"delivery_id": F.col("i"), "batch_id": F.lit(0), "received_at": F.timestamp_seconds(F.col("i")), "trace_id": F.lit("ab" * 16), "span_id": F.format_string("%016x", F.col("i") + 1), "name": F.lit("execute_tool add"), "start_time_unix_nano": F.col("i"), "end_time_unix_nano": F.col("i") + 1, "attributes": F.col("attributes"), "resource": F.lit("{}")}
    kinds = dict(x.split(" ") for x in SPANS.split(", "))
    df.select(*[values.get(c, F.lit(None)).cast(k).alias(c) for c, k in kinds.items()]).write.parquet(f"{folder}/otel_spans.parquet")


def test_tool_io_keeps_whole_observations(spark, tmp_path):
    texts = ["x" * 20, "ab" * 150, "y" * 2000, "z" * 2500]
    write_spans(spark, tmp_path, [json.dumps({"gen_ai.tool.name": "add", "gen_ai.tool.call.result": t}) for t in texts])
    got = [r.observation for r in trace_plans.tool_io(spark, str(tmp_path)).orderBy("span_id").collect()]
    assert got == [*texts[:3], texts[3][:2000]]


def test_resampling_queries_take_all_replicates(spark, monkeypatch):
    """Against the formula in plain Python with 2000 replicates."""
    rng = random.Random(3)
    tasks = [(i, "ab"[i % 2], rng.random() < 0.6) for i in range(40)]
    rows = [(i, t, int((t == "x") == hit), s, p) for i, _, hit in tasks for t, s, p in (("x", 0.9, 0.2 + 0.2 * (i % 3)), ("y", 0.5, 0.3))]
    scored = spark.createDataFrame(rows, "task_id long, tool_name string, label int, score double, popularity double")
    recs = spark.createDataFrame([(i, app) for i, app, _ in tasks], "record_id long, app string")
    monkeypatch.setattr(evaluation, "scored", lambda *_: scored)
    monkeypatch.setattr(evaluation, "_recs", lambda *_: recs)

    def replicates(values):
        number = lambda text: int(hashlib.md5(text.encode()).hexdigest()[:8], 16)
        block = {i: number(f"block:{i}") % ranking.BLOCKS for i, _ in values}
        out = []
        for b in range(2000):
            w = {k: sum(number(f"42:{b}:{k}") / 4294967296 >= c for c in ranking.POISSON) for k in set(block.values())}
            if any(w.values()):
                out.append(sum(w[block[i]] * v for i, v in values) / sum(w[block[i]] for i, _ in values))
        return np.array(out)

    first = lambda i, column: 1 if max((r for r in rows if r[0] == i), key=lambda r: r[column])[2] else 0.5
    m = replicates([(i, float(hit)) for i, _, hit in tasks])
    got = evaluation.bootstrap_ci(spark, "").first()
    assert (got.lower, got.upper) == pytest.approx(tuple(np.quantile(m, [0.025, 0.975])), abs=1e-6)
    for got in evaluation.paired_holm(spark, "").collect():
        m = replicates([(i, first(i, 3) - first(i, 4)) for i, app, _ in tasks if app == got.app])
        p = min(1, 2 * min((m <= 0).mean(), (m >= 0).mean()))
        assert (got.lower, got.upper, got.p_value) == pytest.approx((*np.quantile(m, [0.025, 0.975]), p), abs=1e-6)


def test_blocks_spread_like_tasks(spark):
    """The interval of many tasks in few blocks is about that of the normal approximation."""
    rng = np.random.default_rng(7)
    v = rng.gamma(2.0, 1.0, 20_000)
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "task_id long, v double")
    for blocks in (200, 1000):
        r = ranking.bootstrap(df, "v", blocks=blocks).first()
        half = 1.96 * v.std() / np.sqrt(len(v))
        assert r.n == 20_000 and abs(r.mean - v.mean()) < 1e-9
        assert abs((r.upper - r.lower) / 2 / half - 1) < 0.15
