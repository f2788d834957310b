"""Expressions over span attributes: one map of text values, whatever was native or JSON text at the source."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Operation names, span names and kinds (fixed values).
TOOL_OPS = ("execute_tool",)
LLM_OPS = ("chat", "text_completion", "completion", "llm_request")
SKIP_OPS = ("embeddings", "vector_db_retrieve", "handoff")
SKIP_KINDS = ("session", "handoff", "server")
SKIP_NAMES = ("mcp_tools", "tools/list")
#: Members of the collector's own namespace: the span of a task, and the attribute that only task spans have.
TASK, TASK_ROOT = "task", "task_root"
#: Setting that names the collector's prefix; where it is unset, the prefix is found in the data.
PREFIX_SETTING = "spanloom.collector.prefix"
_PREFIXED = r'"([A-Za-z0-9_-]+)\.task_root"\s*:'

_MESSAGE = "array<string>"


def strip(c: Column) -> Column:
    """Without blanks, line ends and no-break spaces around it."""
    return F.btrim(c, F.lit(" \t\r\n\u00a0"))


def as_map(json: Column | str) -> Column:
    """A JSON object's members as text; an empty map for anything else."""
    c = F.col(json) if isinstance(json, str) else json
    return F.coalesce(F.from_json(c, "map<string,string>"), F.from_json(F.lit("{}"), "map<string,string>"))


def first_attr(m: str, *keys: str) -> Column:
    """The first of the keys that is present and neither null nor empty."""
    return F.coalesce(*[F.nullif(F.element_at(m, F.lit(k)), F.lit("")) for k in keys])


def as_list(text: Column) -> Column:
    """Elements of a JSON array as text; an object counts as an array of one; null for anything else."""
    t = F.ltrim(text)
    return F.when(t.startswith("["), F.from_json(t, _MESSAGE)).when(t.startswith("{") & F.from_json(t, "map<string,string>").isNotNull(), F.array(t))


def optional_bool(c: Column) -> Column:
    """true/1/yes and false/0/no in any case, 0 and 1 as numbers; null for anything else."""
    t = F.lower(F.trim(c))
    return F.when(t.isin("true", "1", "yes", "1.0"), True).when(t.isin("false", "0", "no", "0.0"), False)


def collector_prefix(df: DataFrame, attributes: str = "attributes") -> str:
    """The prefix of the collector's own keys, with its dot: the setting's, else what stands before ``.task_root`` in most spans.

    Of equally frequent prefixes the first by name counts; '' if there is none. One number per prefix reaches the driver.
    """
    named = df.sparkSession.conf.get(PREFIX_SETTING, None)
    if named is not None:
        return named.rstrip(".") + "." if named else ""
    a = F.col(attributes)
    seen = df.filter(F.contains(a, F.lit(".task_root"))).select(F.regexp_extract(a, _PREFIXED, 1).alias("p")).filter("p <> ''")
    most = seen.groupBy("p").count().orderBy(F.desc("count"), "p").first()
    return most["p"] + "." if most else ""


def kind(m: str = "attrs") -> Column:
    return F.lower(F.coalesce(first_attr(m, "traceloop.span.kind", "openinference.span.kind"), F.lit("")))


def is_task_root(own: str, m: str = "attrs", name: str = "name") -> Column:
    """Whether a span is a task's: by its name or its flag in the collector's namespace ``own``."""
    if not own:
        return F.lit(False)
    flag = first_attr(m, own + TASK_ROOT)
    return F.coalesce(F.col(name) == own + TASK, F.lit(False)) | F.coalesce(flag.isNotNull() & ~flag.isin("false", "0"), F.lit(False))


def role(own: str = "", m: str = "attrs", name: str = "name") -> Column:
    """Exactly one of root, tool, llm, agent, task, skip, other; what is to be skipped goes first."""
    op = F.coalesce(first_attr(m, "gen_ai.operation.name", "llm.request.type"), F.lit(""))
    k, n = kind(m), F.coalesce(F.col(name), F.lit(""))
    return (
        F.when(op.isin(*SKIP_OPS) | k.isin(*SKIP_KINDS), "skip")
        .when(is_task_root(own, m, name), "root")
        .when(n.isin(*SKIP_NAMES), "skip")
        .when(op.isin(*TOOL_OPS) | first_attr(m, "gen_ai.tool.name", "tool.name").isNotNull(), "tool")
        .when(n.startswith("execute_tool ") | n.endswith(".tool") | (n.startswith("function.") & k.isin("tool", "")) | (k == "tool"), "tool")
        .when(op.isin(*LLM_OPS) | (k == "llm"), "llm")
        .when(k.isin("workflow", "agent") | (op == "invoke_agent"), "agent")
        .when((k == "task") | (op == "execute_task"), "task")
        .otherwise("other")
    )


def tool_of_name(name: Column) -> Column:
    """The tool in an instrumented span's name; empty if there is none."""
    return F.trim(
        F.when(name.startswith("execute_tool "), F.substr(name, F.lit(14)))
        .when(name == "tools/call.tool", "")
        .when(name.endswith(".tool"), F.regexp_replace(name, r"\.tool$", ""))
        .when(name.startswith("function."), F.substr(name, F.lit(10)))
        .otherwise("")
    )


def tool_of_span(own: str = "", m: str = "attrs", name: str = "name") -> Column:
    """A tool span's bare tool name; null for listings and spans without one."""
    called_by = first_attr(m, "gen_ai.tool.name", "tool.name")
    entity = F.when(kind(m) == "tool", first_attr(m, "traceloop.entity.name"))
    called = F.when(F.col(name) == "tools/call.tool", first_attr(m, "traceloop.entity.input.tool_name"))
    any_name = F.coalesce(called_by, entity, called, tool_of_name(F.coalesce(F.col(name), F.lit(""))))
    bare = F.trim(F.substring_index(any_name, "(", 1))
    return F.when((bare != "") & ~bare.isin(*SKIP_NAMES, *([own + TASK] if own else [])), bare)


def association(own: str, key: str, m: str = "attrs") -> Column:
    """An association property: the collector's own key before the JSON object's member."""
    blob = as_map(first_attr(m, "traceloop.association.properties"))
    member = F.nullif(F.element_at(blob, F.lit(key)), F.lit(""))
    return F.coalesce(first_attr(m, own + key), member) if own else member


def success_of_span(own: str, m: str = "attrs") -> Column:
    blob = as_map(first_attr(m, "traceloop.association.properties"))
    keys = [*([own + "success"] if own else []), "traceloop.association.properties.success"]
    return optional_bool(F.coalesce(first_attr(m, *keys), F.element_at(blob, F.lit("success"))))


def tool_arguments(m: str = "attrs") -> Column:
    """A call's arguments: an object's scalar ``arguments`` or ``input_str``, else the text as it stands, else empty."""
    raw = first_attr(m, "gen_ai.tool.call.arguments", "traceloop.entity.input", "input.value")
    inner = as_map(raw)
    scalar = [F.when(~F.element_at(inner, F.lit(k)).rlike(r"^\s*[\[{]"), F.element_at(inner, F.lit(k))) for k in ("arguments", "input_str")]
    return F.coalesce(*scalar, raw, F.lit(""))


def observation(m: str = "attrs", max_chars: int = 2000) -> Column:
    raw = first_attr(m, "gen_ai.tool.call.result", "traceloop.entity.output", "output.value", "gen_ai.task.output")
    return F.substring(F.coalesce(raw, F.lit("")), 1, max_chars)


def input_messages(m: str = "attrs") -> Column:
    """A span's input messages as JSON texts; the nested spelling of the key counts too."""
    nested = F.get_json_object(F.element_at(m, F.lit("gen_ai")), "$.input.messages")
    own = F.coalesce(first_attr(m, "gen_ai.input.messages", "llm.input_messages"), nested)
    indexed = r"^llm\.input_messages\.(\d+)\.message\.content$"
    each = F.transform(F.map_entries(F.map_filter(m, lambda k, v: k.rlike(indexed))), lambda e: F.struct(F.regexp_extract(e["key"], indexed, 1).cast("int").alias("i"), e["value"].alias("v")))
    users = F.transform(F.array_sort(each), lambda e: F.to_json(F.struct(F.lit("user").alias("role"), e["v"].alias("content"))))
    return F.coalesce(as_list(own), F.when(own.isNull() & (F.size(users) > 0), users))


def output_messages(m: str = "attrs") -> Column:
    return as_list(first_attr(m, "gen_ai.output.messages", "gen_ai.output.message", "llm.output_messages"))


def assistant_text(m: str = "attrs", max_chars: int = 2000) -> Column:
    """What a model span's assistant said before its first tool call, else its completion, else empty."""
    part = "array<struct<type:string,content:string>>"

    def said(msg: Column) -> Column:
        parts = F.from_json(F.get_json_object(msg, "$.parts"), part)
        calls = F.array_position(F.transform(parts, lambda p: p["type"].isin("tool_call", "function_call")), True)
        before = F.when(calls > 0, F.slice(parts, 1, (calls - 1).cast("int"))).otherwise(parts)
        texts = F.filter(F.transform(F.filter(before, lambda p: p["type"].isin("text", "input_text", "content")), lambda p: p["content"]), lambda t: strip(t) != "")
        return F.when(parts.isNotNull(), F.array_join(texts, " ")).otherwise(message_text(msg))

    texts = F.filter(F.transform(F.filter(output_messages(m), lambda x: message_role(x) == "assistant"), said), lambda t: t != "")
    listed = F.from_json(first_attr(m, "gen_ai.completion", "llm.completions"), "array<struct<text:string>>")
    completion = F.coalesce(F.array_join(F.transform(listed, lambda c: F.coalesce(c["text"], F.lit(""))), ", "), first_attr(m, "gen_ai.completion", "llm.completions"))
    return F.substring(F.coalesce(F.nullif(strip(F.array_join(texts, " ")), F.lit("")), completion, F.lit("")), 1, max_chars)


def message_role(msg: Column) -> Column:
    return F.lower(F.coalesce(F.get_json_object(msg, "$.role"), F.lit("")))


def message_text(msg: Column) -> Column:
    """Text of a message: its text parts joined by blanks, else its content, else its content's texts."""
    parts = F.from_json(F.get_json_object(msg, "$.parts"), "array<struct<type:string,content:string>>")
    from_parts = F.array_join(F.filter(F.transform(F.filter(parts, lambda p: p["type"].isin("text", "input_text", "content")), lambda p: p["content"]), lambda x: x != ""), " ")
    content = F.get_json_object(msg, "$.content")
    items = F.from_json(content, "array<struct<text:string>>")
    from_items = F.array_join(F.filter(F.transform(items, lambda p: p["text"]), lambda x: x != ""), " ")
    is_items = F.ltrim(content).startswith("[") & items.isNotNull()
    return strip(F.coalesce(F.nullif(from_parts, F.lit("")), F.when(is_items, from_items).otherwise(content), F.lit("")))


CALL = "array<struct<type:string,id:string,name:string,arguments:string,function:struct<name:string,arguments:string>>>"


def message_calls(msg: Column) -> Column:
    """(id, name, arguments) of a message's tool calls: those among its parts, then its ``tool_calls``."""
    def pick(items: Column, typed: bool) -> Column:
        ok = F.filter(items, lambda p: p.isNotNull() & (p["type"].isin("tool_call", "function_call") if typed else F.lit(True)))
        blank = lambda x: F.coalesce(x, F.lit(""))
        fn = lambda p, c: F.when(p["function"].isNotNull(), p["function"][c]).otherwise(p[c]) if not typed else p[c]
        return F.transform(ok, lambda p: F.struct(blank(p["id"]).alias("id"), blank(fn(p, "name")).alias("name"), blank(fn(p, "arguments")).alias("arguments")))

    none = F.from_json(F.lit("[]"), "array<struct<id:string,name:string,arguments:string>>")
    parts, calls = (F.from_json(F.get_json_object(msg, f"$.{f}"), CALL) for f in ("parts", "tool_calls"))
    return F.concat(F.coalesce(pick(parts, True), none), F.coalesce(pick(calls, False), none))
