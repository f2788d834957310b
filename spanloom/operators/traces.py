"""Traces: clean spans, roots, per-trace fields by priority, steps, and the projection onto trajectories.

Per-trace values are "first non-empty in a fixed order" aggregations: ``min_by`` over an ordering struct, one
``groupBy`` with map-side aggregation for all of them, so that no trace, however large, has to be in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import attrs as A
from ..functions.ids import canonical_id, parent_id
from ..joins import asof_last, next_in_order
from ..storage import Scratch
from . import hierarchy
from .twins import client_twins


@dataclass(frozen=True)
class ProjectionConfig:
    intent_strategy: str = "first_user"  # or last_user_before_tools
    accept_gen_ai_task_id: bool = False
    accept_task_status: bool = False
    success_tools: tuple[str, ...] = ()
    drop_tools: tuple[str, ...] = ()
    require_intent: bool = True
    require_tool_spans: bool = True
    require_known_success: bool = True
    max_observation_chars: int = 2000
    max_thought_chars: int = 2000


def clean_spans(deliveries: DataFrame, prefix: str | None = None) -> DataFrame:
    """One row per span: its first delivery, ids in one notation, attributes as maps of text, and what the collector noted.

    ``prefix`` is that of the collector's own keys; by default the setting's, else the one found in the data.
    """
    own = A.collector_prefix(deliveries) if prefix is None else prefix
    t = deliveries.select(
        canonical_id("trace_id", 16).alias("trace_id"),
        canonical_id("span_id", 8).alias("span_id"),
        F.struct("received_at", "delivery_id").alias("_at"),
        F.struct(parent_id("parent_span_id").alias("parent_span_id"), F.col("name"), F.col("start_time_unix_nano").alias("start"), F.col("end_time_unix_nano").alias("end"), F.col("status_code").alias("status"), "attributes", "resource").alias("_x"),
    ).filter("trace_id is not null and span_id is not null")
    one = t.groupBy("trace_id", "span_id").agg(F.min_by("_x", "_at").alias("_x")).select("trace_id", "span_id", "_x.*")
    out = one.withColumn("attrs", A.as_map("attributes")).withColumn("res", A.as_map("resource")).drop("attributes", "resource")
    noted = {f"own_{k}": A.association(own, k) for k in ("task_id", "intent", "app_name")}
    out = out.withColumns({"kind": A.kind(), "role": A.role(own), "is_task": A.is_task_root(own), "own_success": A.success_of_span(own), **noted})
    return out.withColumn("tool", F.when(F.col("role") == "tool", A.tool_of_span(own)))


def root_spans(spans: DataFrame) -> DataFrame:
    """Each trace's root: task span, outermost workflow or agent, parentless span, earliest span, in this order."""
    outer = F.col("kind").isin("workflow", "agent")
    parents = spans.filter(outer).select("trace_id", F.col("span_id").alias("parent_span_id"), F.lit(True).alias("_inner"))
    j = spans.join(parents, ["trace_id", "parent_span_id"], "left")
    rule = F.when(F.col("is_task"), 0).when(outer & F.col("_inner").isNull(), 1).when(F.col("parent_span_id").isNull(), 2).otherwise(3)
    return j.groupBy("trace_id").agg(F.min_by("span_id", F.struct(rule, "start", "span_id")).alias("root_span_id"), F.min(F.struct(rule, F.col("start"), F.col("span_id")))["col1"].alias("root_rule"))


def _pick(value: Column, order: Column, cond: Column | None = None) -> Column:
    keep = value.isNotNull() if cond is None else value.isNotNull() & cond
    return F.min_by(value, F.when(keep, order))


def trace_fields(spans: DataFrame, config: ProjectionConfig = ProjectionConfig()) -> DataFrame:
    """One row per trace: task, intent, success, app with their sources, role counts, framework and token sums."""
    roots = root_spans(spans)
    s = spans.join(roots, "trace_id")
    is_root = F.col("span_id") == F.col("root_span_id")
    by_start = F.struct(F.col("start"), F.col("span_id"))
    root_first = F.struct((~is_root).alias("r"), F.col("start"), F.col("span_id"))
    msgs = F.when(F.col("role") == "llm", A.input_messages())
    users = F.filter(F.transform(F.filter(msgs, lambda m: A.message_role(m).isin("user", "human")), A.message_text), lambda t: t != "")
    has_calls = F.exists(msgs, lambda m: F.size(A.message_calls(m)) > 0)
    s = s.withColumn("_users", users).withColumn("_calls", F.coalesce(has_calls, F.lit(False)))
    name = F.col("name")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    some = lambda c: F.coalesce(F.max(c), F.lit(False))
    number = lambda key: F.sum(F.coalesce(A.first_attr("attrs", key, key.replace("gen_ai.", "llm.")).try_cast("double").cast("long"), F.lit(0)))
    a = [
        F.first("root_span_id").alias("root_span_id"),
        _pick(F.col("own_task_id"), by_start, is_root).alias("assoc_task"),
        _pick(A.first_attr("attrs", "gen_ai.task.id"), by_start, F.col("role").isin("root", "agent")).alias("gen_ai_task"),
        _pick(A.first_attr("attrs", "gen_ai.conversation.id"), by_start).alias("conversation"),
        _pick(F.col("own_intent"), by_start, is_root).alias("assoc_intent"),
        _pick(F.nullif(A.strip(A.first_attr("attrs", "gen_ai.task.input")), F.lit("")), by_start).alias("task_input"),
        _pick(A.first_attr("attrs", "traceloop.entity.input"), by_start, is_root).alias("entity_input"),
        _pick(F.get("_users", F.lit(0)), by_start).alias("first_user"),
        F.min(F.when(F.col("_calls"), F.col("start"))).alias("first_call_start"),
        _pick(F.col("own_success"), root_first).alias("assoc_success"),
        _pick(F.lower(A.first_attr("attrs", "gen_ai.task.status")), root_first, F.lower(A.first_attr("attrs", "gen_ai.task.status")).isin("success", "failure")).alias("task_status"),
        F.max_by("tool", F.when(F.col("tool").isNotNull(), by_start)).alias("last_tool"),
        _pick(F.col("own_app_name"), by_start, is_root).alias("assoc_app"),
        _pick(A.first_attr("res", "service.name"), root_first).alias("service"),
        _pick(A.first_attr("attrs", "traceloop.workflow.name", "gen_ai.agent.name"), root_first).alias("workflow"),
        F.count(F.lit(1)).alias("spans_in"),
        *[count(F.col("role") == r).alias(f"n_{r}") for r in ("root", "tool", "llm", "agent", "task", "skip", "other")],
        count(F.col("tool").isNotNull()).alias("n_named_tools"),
        some(name.contains("mcp.server") | name.startswith("tools/call")).alias("_mcp"),
        some(name.startswith("execute_tool ")).alias("_execute"),
        some(name.contains("workflow")).alias("_workflow"),
        some(name.endswith(".tool")).alias("_tool"),
        some(name.contains(".agent")).alias("_agent"),
        some(name.startswith("function.")).alias("_function"),
        *[number(f"gen_ai.usage.{k}_tokens").alias(f"{k}_tokens") for k in ("input", "output", "total")],
    ]
    t = s.groupBy("trace_id").agg(*a)
    if config.intent_strategy == "last_user_before_tools":
        t = t.join(_last_user(s, t), "trace_id", "left")
        chosen, source = F.col("last_user"), "last_user_before_tools"
    else:
        chosen, source = F.col("first_user"), "user_message"
    framework = (
        F.when(F.col("_mcp") & (F.col("_execute") | F.col("_workflow")), "mixed").when(F.col("_mcp"), "mcp").when(F.col("_execute"), "langchain")
        .when(F.col("_tool") & F.col("_agent"), "openai_agents").when(F.col("_agent"), "crewai").when(F.col("_function"), "openinference").when(F.col("_tool"), "agno").otherwise("unknown")
    )
    unwrapped = lambda c: F.coalesce(F.get_json_object(c, "$.input"), F.get_json_object(c, "$.question"), F.get_json_object(c, "$.query"), F.when(~F.ltrim(c).startswith("{"), c), F.get_json_object(c, "$.content"), F.get_json_object(c, "$.text"))
    tried = [("association", F.col("assoc_intent")), ("task_input", unwrapped(F.col("task_input"))), (source, chosen), ("entity_input", unwrapped(F.col("entity_input")))]
    tried = [(n, F.nullif(A.strip(c), F.lit(""))) for n, c in tried]
    task = F.coalesce("assoc_task", *(["gen_ai_task"] if config.accept_gen_ai_task_id else []), "conversation", "trace_id")
    success, success_source = F.col("assoc_success"), F.when(F.col("assoc_success").isNotNull(), "association")
    if config.accept_task_status:
        success = F.coalesce(success, F.col("task_status") == "success")
        success_source = F.coalesce(success_source, F.when(F.col("task_status").isNotNull(), "task_status"))
    if config.success_tools:
        success = F.coalesce(success, F.col("last_tool").isin(*config.success_tools))
        success_source = F.coalesce(success_source, F.when(F.col("last_tool").isNotNull(), "heuristic"))
    t = t.withColumn("task_id", task).withColumn("intent", F.coalesce(*[c for _, c in tried], F.lit("")))
    t = t.withColumn("intent_source", F.coalesce(*[F.when(c.isNotNull(), n) for n, c in tried], F.lit("")))
    t = t.withColumn("success", F.coalesce(success, F.lit(False))).withColumn("success_source", F.coalesce(success_source, F.lit("unknown")))
    t = t.withColumn("app_name", F.coalesce("assoc_app", "service", "workflow", F.lit(""))).withColumn("framework", framework)
    return t.select("trace_id", "root_span_id", "task_id", "intent", "intent_source", "success", "success_source", "app_name", "framework", "conversation", "service", "spans_in", *[f"n_{r}" for r in ("root", "tool", "llm", "agent", "task", "skip", "other", "named_tools")], "input_tokens", "output_tokens", "total_tokens")


def _last_user(s: DataFrame, t: DataFrame) -> DataFrame:
    """The last user message of spans that start no later than the first one with a call; without one, the last of all."""
    u = s.join(t.select("trace_id", "first_call_start"), "trace_id").select("trace_id", "start", "span_id", "first_call_start", F.posexplode("_users").alias("i", "text"))
    at = F.struct("start", "span_id", "i")
    early = F.col("first_call_start").isNull() | (F.col("start") <= F.col("first_call_start"))
    return u.groupBy("trace_id").agg(F.coalesce(F.max_by("text", F.when(early, at)), F.max_by("text", at)).alias("last_user"))


def span_trees(spans: DataFrame, cap: int = hierarchy.GROUP_CAP) -> DataFrame:
    """Hierarchies of clean spans with ``agent_name``: the span's own agent, else that of the nearest span above, else ''.

    Small traces are solved whole, large ones by doubling, both in the same passes as the ranges.
    """
    trees = hierarchy.solve(hierarchy.span_links(spans, A.first_attr("attrs", "gen_ai.agent.name")), False, cap)
    return trees.withColumn("agent_name", F.coalesce("nearest", F.lit(""))).drop("nearest", "path")


def nearest_agents(spans: DataFrame, cap: int = hierarchy.GROUP_CAP) -> DataFrame:
    """(trace_id, span_id, agent_name)."""
    return span_trees(spans, cap).select("trace_id", "span_id", "agent_name")


def innermost_tools(spans: DataFrame, trees: DataFrame) -> DataFrame:
    """Named tool spans without the wrappers: of spans of one tool on one path downward only the innermost stays.

    A span wraps another of its tool if the next one of the tree in preorder lies in its range.
    """
    slim = spans.filter("tool is not null").select("trace_id", "span_id", "tool").join(trees.select("trace_id", "span_id", "root_span_id", "lo", "hi"), ["trace_id", "span_id"])
    wraps = next_in_order(slim.filter("lo is not null"), ["trace_id", "root_span_id", "tool"], ["lo", "span_id"], "lo", "_next").filter("_next <= hi")
    return spans.filter("tool is not null").join(wraps.select("trace_id", "span_id"), ["trace_id", "span_id"], "left_anti")


def previous_llm(spans: DataFrame) -> DataFrame:
    """As-of join: for each named tool span the model span that ended last at or before its start."""
    left = spans.filter("tool is not null").select("trace_id", "span_id", F.col("start").alias("t"))
    right = spans.filter("role = 'llm'").select("trace_id", F.col("end").alias("t"), F.col("span_id").alias("llm_span_id"))
    return asof_last(left, right, "trace_id", "t", "llm_span_id", 60_000_000_000).select("trace_id", "span_id", "llm_span_id")


def message_decisions(spans: DataFrame) -> DataFrame:
    """Tool calls of traces without a named tool span, read from the latest model span's input messages.

    A call with an id counts once, where it is first seen; without an id once per message, name and arguments, these as
    JSON values: order of keys and blanks don't matter. Calls that only the span's output has follow, if they have an id. The first response with its id is its observation.
    """
    per = spans.groupBy("trace_id").agg(F.max((F.col("tool").isNotNull())).alias("named"), F.max_by("attrs", F.when(F.col("role") == "llm", F.struct("start", "span_id"))).alias("attrs"))
    none = F.array().cast("array<string>")
    given, made = F.coalesce(A.input_messages(), none), F.coalesce(A.output_messages(), none)
    msgs = per.filter("not named and attrs is not null").select("trace_id", F.size(given).alias("n"), F.posexplode(F.concat(given, made)).alias("m", "msg"))
    calls = A.message_calls(F.col("msg"))
    msgs = msgs.withColumn("calls", F.when(F.col("m") < F.col("n"), calls).otherwise(F.filter(calls, lambda c: c["id"] != "")))
    responses = msgs.filter("m < n").filter(A.message_role(F.col("msg")).isin("tool", "function")).select("trace_id", "m", F.coalesce(F.get_json_object("msg", "$.tool_call_id"), F.get_json_object("msg", "$.id")).alias("call_id"), A.message_text(F.col("msg")).alias("text"))
    responses = responses.filter("call_id is not null and call_id <> ''").groupBy("trace_id", "call_id").agg(F.min_by("text", "m").alias("observation"))
    calls = msgs.select("trace_id", "m", F.posexplode("calls").alias("c", "call")).select("trace_id", "m", "c", F.col("call.id").alias("call_id"), F.trim(F.substring_index("call.name", "(", 1)).alias("tool"), F.col("call.arguments").alias("arguments")).filter("tool <> ''")
    has_id = F.col("call_id") != ""
    blank = lambda c: F.when(~has_id, F.col(c))
    calls = calls.withColumn("canonical", F.coalesce(F.to_json(F.try_parse_json("arguments")), "arguments"))
    first = calls.groupBy("trace_id", F.col("call_id").alias("k"), blank("tool").alias("kt"), blank("canonical").alias("ka"), blank("m").alias("km")).agg(F.min_by(F.struct("call_id", "tool", "arguments"), F.struct("m", "c")).alias("x"), F.min(F.struct("m", "c")).alias("at"))
    out = first.select("trace_id", "at.m", "at.c", "x.*").join(responses, ["trace_id", "call_id"], "left")
    return out.select("trace_id", F.col("m").alias("message"), F.col("c").alias("place"), "call_id", "tool", "arguments", F.coalesce("observation", F.lit("")).alias("observation"))


def drop_reason(config: ProjectionConfig) -> Column:
    """Why a trace gives no trajectory; null if it gives one."""
    r = F.lit(None).cast("string")
    if config.require_tool_spans:
        r = F.when(F.col("n_steps") == 0, "zero_tool_spans")
    if config.require_known_success:
        r = F.when(F.col("success_source") == "unknown", "success_unknown").otherwise(r)
    if config.require_intent:
        r = F.when(F.trim("intent") == "", "missing_intent").otherwise(r)
    return r


def project(deliveries: DataFrame, config: ProjectionConfig = ProjectionConfig(), prefix: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(traces with ``n_steps`` and ``drop_reason``, steps of all traces in order)."""
    scratch = Scratch(deliveries.sparkSession, "project")
    return project_spans(scratch.cut(clean_spans(deliveries, prefix), "spans"), config)


def project_spans(spans: DataFrame, config: ProjectionConfig = ProjectionConfig()) -> tuple[DataFrame, DataFrame]:
    """The same of clean spans, a written table."""
    scratch = Scratch(spans.sparkSession, "project")
    trees = scratch.cut(span_trees(spans), "trees")
    gone = client_twins(spans)  # settled before wrappers are folded
    tools = innermost_tools(spans if gone is None else spans.join(gone, ["trace_id", "span_id"], "left_anti"), trees)
    calls = message_decisions(spans)
    if config.drop_tools:
        tools, calls = (d.filter(~F.col("tool").isin(*config.drop_tools)) for d in (tools, calls))
    n_steps = tools.select("trace_id").unionByName(calls.select("trace_id")).groupBy("trace_id").agg(F.count(F.lit(1)).alias("n_steps"))
    fields = trace_fields(spans, config).join(n_steps, "trace_id", "left").fillna(0, ["n_steps"])

    steps = tools.join(trees.select("trace_id", "span_id", "agent_name"), ["trace_id", "span_id"], "left").join(previous_llm(spans), ["trace_id", "span_id"], "left")
    said = spans.filter("role = 'llm'").select("trace_id", F.col("span_id").alias("llm_span_id"), A.assistant_text(max_chars=config.max_thought_chars).alias("thoughts")).filter("thoughts <> ''")
    steps = steps.join(said, ["trace_id", "llm_span_id"], "left").withColumn("thoughts", F.coalesce("thoughts", F.lit("")))
    steps = steps.select("trace_id", F.struct(F.lit(0).alias("a"), F.col("start").alias("b"), F.col("span_id").alias("c")).alias("at"), F.coalesce("agent_name", F.lit("")).alias("agent_name"), F.col("tool").alias("action"), A.observation(max_chars=config.max_observation_chars).alias("observation"), A.tool_arguments().alias("arguments"), "thoughts", F.lit("tool").alias("origin"))
    more = calls.select("trace_id", F.struct(F.lit(1).alias("a"), (F.col("message").cast("long") * 2**31 + F.col("place")).alias("b"), F.lit("").alias("c")).alias("at"), F.lit("").alias("agent_name"), F.col("tool").alias("action"), F.substring("observation", 1, config.max_observation_chars).alias("observation"), "arguments", F.lit("").alias("thoughts"), F.lit("llm_fallback").alias("origin"))
    return fields.withColumn("drop_reason", drop_reason(config)), steps.unionByName(more)


def trajectories(fields: DataFrame, steps: DataFrame) -> DataFrame:
    """The kept traces as trajectories: their steps in order in one array, where they come from as metadata in JSON."""
    per = steps.groupBy("trace_id").agg(F.array_sort(F.collect_list(F.struct("at", "agent_name", "action", "observation", "thoughts"))).alias("x"))
    spans = F.transform("x", lambda s: F.struct(s["agent_name"].alias("agent_name"), s["action"].alias("action"), s["observation"].alias("observation"), s["thoughts"].alias("thoughts")))
    meta = F.to_json(F.struct("success_source", "intent_source", F.col("trace_id").alias("otel.trace_id"), F.col("framework").alias("projection.framework")))
    kept = fields.filter("drop_reason is null").join(per, "trace_id", "left")
    return kept.select("task_id", "intent", "app_name", "success", F.coalesce(spans, F.slice(spans, 1, 0)).alias("spans"), meta.alias("metadata"))
