"""Trajectories from exported benchmark spans, whose tools are named ``<app>__<api>``.

The last model span of a trace, by position in the export, holds the whole conversation. Steps are the calls from the
real task's message on, each with the tool message of the same rank; without calls they are the exported tool spans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import attrs as A

CONTROL_APPS = ("supervisor",)


def app_of(tool: str | Column) -> Column:
    return F.trim(F.substring_index(F.col(tool) if isinstance(tool, str) else tool, "__", 1))


def is_control(tool: str | Column) -> Column:
    return app_of(tool).isin(*CONTROL_APPS)


def clean_intent(text: Column, real: tuple[str, ...], tutorial: tuple[str, ...]) -> Column:
    """Without one marker of the real task and then one of the tutorial at its start."""
    for markers in (real, tutorial):
        cut = F.lit(None).cast("string")
        for m in reversed(markers):
            cut = F.when(text.startswith(m), F.substring(text, len(m) + 1, 2**31 - 1)).otherwise(cut)
        text = F.coalesce(cut, text)
    return A.strip(text)


def trajectories(spans: DataFrame, real: tuple[str, ...], tutorial: tuple[str, ...] = (), max_chars: int = 2000) -> tuple[DataFrame, DataFrame]:
    """(one row per trace, steps): ``spans`` is the result of ``read_benchmark_spans``; markers say where the task begins."""
    s = spans.withColumn("attrs", A.as_map("attributes"))
    kind = A.first_attr("attrs", "openinference.span.kind")
    last = s.filter(kind == "LLM").groupBy("trace_id").agg(F.max_by("attrs", "position").alias("attrs"))
    msgs = last.select("trace_id", F.posexplode(A.as_list(A.first_attr("attrs", "llm.input_messages"))).alias("i", "msg"))
    msgs = msgs.select("trace_id", "i", F.get_json_object("msg", "$.role").alias("role"), F.coalesce(F.get_json_object("msg", "$.content"), F.lit("")).alias("content"), A.message_calls(F.col("msg")).alias("calls"))
    marked = F.lit(False)
    for m in real:
        marked = marked | F.lower("content").contains(m.lower())
    user = F.col("role") == "user"
    start = msgs.groupBy("trace_id").agg(F.coalesce(F.min(F.when(user & marked, F.col("i"))), F.max(F.when(user & (F.trim("content") != ""), F.col("i")))).alias("start"))
    own = msgs.join(start, "trace_id").filter(F.col("i") >= F.col("start"))
    intent = own.filter(F.col("i") == F.col("start")).select("trace_id", clean_intent(F.col("content"), real, tutorial).alias("intent"))
    rank = F.row_number().over(Window.partitionBy("trace_id").orderBy("i", "c"))
    calls = own.filter("role = 'assistant'").select("trace_id", "i", F.posexplode("calls").alias("c", "call")).filter("call.name <> ''").withColumn("rn", rank).select("trace_id", "rn", F.col("call.name").alias("tool"))
    seen = own.filter(F.col("role").isin("tool", "function")).withColumn("rn", F.row_number().over(Window.partitionBy("trace_id").orderBy("i"))).select("trace_id", "rn", F.col("content").alias("obs"))
    steps = calls.join(seen, ["trace_id", "rn"], "left").select("trace_id", "rn", "tool", F.coalesce("obs", F.lit("")).alias("obs"))
    tool = A.first_attr("attrs", "tool.name")
    exported = s.filter((kind == "TOOL") & tool.isNotNull()).select("trace_id", "position", tool.alias("tool"), F.coalesce(A.first_attr("attrs", "output.value"), F.lit("")).alias("out"))
    plain = exported.filter(~is_control("tool"))
    bare = plain.join(steps.select("trace_id").distinct(), "trace_id", "left_anti").select("trace_id", F.col("position").alias("rn"), "tool", F.col("out").alias("obs"))
    steps = steps.filter(~is_control("tool")).withColumn("rn", F.col("rn").cast("bigint")).unionByName(bare)
    # empty observations are filled from the exports of the same tool, each used once, in order
    by_tool = Window.partitionBy("trace_id", "tool")
    empty = steps.filter("obs = ''").withColumn("nth", F.row_number().over(by_tool.orderBy("rn")))
    outs = plain.withColumn("nth", F.row_number().over(by_tool.orderBy("position"))).select("trace_id", "tool", "nth", "out")
    filled = empty.join(outs, ["trace_id", "tool", "nth"], "left").select("trace_id", "rn", "tool", F.coalesce("out", F.lit("")).alias("obs"))
    steps = steps.filter("obs <> ''").unionByName(filled)
    steps = steps.select("trace_id", (F.row_number().over(Window.partitionBy("trace_id").orderBy("rn")) - 1).alias("step_index"), F.col("tool").alias("action"), F.substring("obs", 1, max_chars).alias("observation"))
    unique = steps.groupBy("trace_id", "action").agg(F.min("step_index").alias("at")).withColumn("app", app_of("action"))
    apps = unique.groupBy("trace_id", "app").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("at"))
    apps = apps.groupBy("trace_id").agg(F.min_by("app", F.struct(-F.col("n"), "at")).alias("app_name"), F.array_sort(F.collect_set("app")).alias("apps"))
    done = exported.groupBy("trace_id").agg((F.max_by("tool", "position") == "supervisor__complete_task").alias("success"))
    out = apps.join(intent, "trace_id", "left").join(done, "trace_id", "left")
    return out.select(F.col("trace_id").alias("task_id"), F.coalesce("intent", F.lit("")).alias("intent"), "app_name", "apps", F.coalesce("success", F.lit(False)).alias("success")), steps


def catalog(spans: DataFrame) -> DataFrame:
    """Names listed or called in an export, without control tools, with their app."""
    s = spans.withColumn("attrs", A.as_map("attributes"))
    listed = [F.coalesce(F.from_json(A.first_attr("attrs", k), "array<string>"), F.array().cast("array<string>")) for k in ("mcp.tools.listed", "agent.tools")]
    names = s.select(F.explode(F.array_append(F.concat(*listed), A.first_attr("attrs", "tool.name"))).alias("tool_name"))
    return names.filter("tool_name <> ''").filter(~is_control("tool_name")).distinct().withColumn("app", app_of("tool_name"))
