"""Trajectories: records, corpus statistics, context without look-ahead, quality gate.

A record's steps lie in one array, so context at step k is computed from slices of it, without a shuffle. Statistics
are ordinary aggregations with map-side combination; pair counts collapse equal baskets first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import names as N

SEP = " | "


def success(own: str = "success", score: str = "score") -> Column:
    """The flag, else whether the score reaches 1, else true."""
    return F.coalesce(F.col(own), F.col(score) >= 1.0, F.lit(True))


def records(trajectories: DataFrame) -> DataFrame:
    """One row per record: canonical task and app, success, distinct tools, split, names of its steps (null: no tool)."""
    spans = F.coalesce("spans", F.slice("spans", 1, 0))
    return trajectories.select(
        "record_id", N.task_key("task_id").alias("task"), N.app_key("app_name").alias("app"), "intent", success().alias("success"), N.tools_of_record().alias("tools"),
        F.transform(F.coalesce(F.col("spans.action"), F.array().cast("array<string>")), N.tool_name).alias("names"), spans.alias("steps"), "metadata", N.split_key("split_name").alias("split_name"), "recorded_at",
    )


def tool_frequency(recs: DataFrame) -> DataFrame:
    return recs.select(F.explode("tools").alias("tool")).groupBy("tool").agg(F.count(F.lit(1)).alias("n_records"))


def guarded_frequency(rows: DataFrame, train_frequency: DataFrame, tool: str = "tool") -> DataFrame:
    """Adds ``tool_frequency`` as training has it, 0 for tools that training has not: nothing of other splits leaks in."""
    f = train_frequency.select(F.col("tool").alias(tool), F.col("n_records").alias("_n"))
    return rows.join(f, tool, "left").withColumn("tool_frequency", F.coalesce("_n", F.lit(0))).drop("_n")


def co_occurrence(recs: DataFrame) -> DataFrame:
    """Both directions of every pair, with the number of records that hold both."""
    baskets = recs.filter(F.size("tools") > 1).groupBy("tools").agg(F.count(F.lit(1)).alias("w"))
    pairs = baskets.select("w", "tools", F.explode("tools").alias("tool_a")).select("w", "tool_a", F.explode("tools").alias("tool_b")).filter("tool_a <> tool_b")
    return pairs.groupBy("tool_a", "tool_b").agg(F.sum("w").alias("n_together"))


def app_tools(recs: DataFrame) -> DataFrame:
    """Sorted tools of every app and their number."""
    each = recs.filter("app is not null").select("app", F.explode("tools").alias("tool")).distinct()
    return each.groupBy("app").agg(F.array_sort(F.collect_list("tool")).alias("tools"), F.count(F.lit(1)).alias("n_tools"))


def contexts(recs: DataFrame, history: int = 5, chars: int = 200) -> DataFrame:
    """One row per tool step, with what is known before it and nothing later."""
    r = recs.select("record_id", "task", "app", "intent", "steps", "names", F.posexplode("names").alias("k", "tool")).filter("tool is not null")
    before = F.slice("names", 1, F.col("k"))
    tools = F.filter(before, lambda x: x.isNotNull())
    last = F.get("steps", F.col("k") - 1)
    lines = F.transform(F.slice("steps", F.greatest(F.lit(1), F.col("k") - history + 1), F.least(F.lit(history), F.col("k"))), lambda s: F.concat(F.coalesce(N.tool_name(s["action"]), F.lit("think")), F.lit("→"), F.substring(F.coalesce(s["observation"], F.lit("")), 1, 50)))
    first = F.col("k") == 0
    return r.select(
        "record_id", "task", "app", "intent", "k", "tool",
        F.array_join(tools, SEP).alias("previous_tools"),
        F.col("k").alias("n_spans"),
        F.when(first, "").otherwise(F.coalesce(last["thoughts"], F.lit(""))).alias("last_thought"),
        F.coalesce(F.try_element_at(tools, F.lit(-1)), F.lit("")).alias("last_action"),
        F.when(first, "").otherwise(F.substring(F.coalesce(last["observation"], F.lit("")), 1, chars)).alias("last_observation"),
        F.size(F.array_distinct(tools)).alias("unique_tools_so_far"),
        F.when(first, "").otherwise(F.array_join(lines, SEP)).alias("history_summary"),
        (F.size(F.array_distinct(tools)) / F.greatest(F.col("k"), F.lit(1))).alias("tool_diversity"),
        F.array_sort(F.array_distinct(tools)).alias("used"),
    )


def expansions(recs: DataFrame) -> DataFrame:
    """Every tool step as a record of its own that ends there; ids are ``<record>_span_<k>``."""
    r = recs.select("record_id", "names", "tools", F.posexplode("names").alias("k", "tool")).filter("tool is not null")
    tools = F.filter(F.slice("names", 1, F.col("k")), lambda x: x.isNotNull())
    return r.select(F.concat(F.col("record_id").cast("string"), F.lit("_span_"), "k").alias("expanded_id"), F.col("k").alias("span_index"), F.size("names").alias("total_spans"), (F.col("k") + 1).alias("n_kept"), "tool", F.array_join(tools, SEP).alias("previous_tools"), F.array_join("tools", ",").alias("available_tools"))


def gate(recs: DataFrame, max_spans: int = 200, require_success: bool = True) -> DataFrame:
    """Adds ``drop_reason``: the first that applies, null for records that are kept.

    Of records with one trace id the first by time of record, then by id, counts.
    """
    trace = F.get_json_object("metadata", "$['otel.trace_id']")
    source = F.get_json_object("metadata", "$['success_source']")
    n_tools = F.size(F.filter("names", lambda x: x.isNotNull()))
    r = F.when(F.coalesce(F.btrim("intent", F.lit(" \t\r\n ")), F.lit("")) == "", "missing_intent").when(n_tools == 0, "zero_tool_spans").when(F.coalesce(source, F.lit("unknown")) == "unknown", "success_unknown")
    if require_success:
        r = r.when(~F.col("success"), "success_false")
    if max_spans:
        r = r.when(F.size("steps") > max_spans, "too_many_spans")
    g = recs.withColumn("trace", trace).withColumn("drop_reason", r)
    first = g.filter("drop_reason is null and trace is not null").groupBy("trace").agg(F.min_by("record_id", F.struct("recorded_at", "record_id")).alias("first_id"))
    g = g.join(first, "trace", "left")
    return g.withColumn("drop_reason", F.coalesce("drop_reason", F.when(F.col("first_id") != F.col("record_id"), "duplicate_trace"))).drop("first_id", "trace")
