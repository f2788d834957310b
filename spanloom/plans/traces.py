"""Queries that assemble, classify and project traces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import attrs as A
from ..functions.ids import canonical_id_sql
from ..operators import traces
from ..storage import Scratch
from .records import table


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.clean_spans(table(spark, sf_dir, "otel_spans"))


def _kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clean spans, written once, for queries that read them several times."""
    return Scratch(spark, "spans").cut(_spans(spark, sf_dir), "spans")


def classify_spans(spark, sf_dir):
    """PRJ5-PRJ8: role and tool of every span."""
    return _spans(spark, sf_dir).select("trace_id", "span_id", "role", "tool")


def tool_io(spark, sf_dir):
    """PRJ15, PRJ16: arguments and observation of named tool spans."""
    s = _spans(spark, sf_dir).filter("tool is not null")
    return s.select("trace_id", "span_id", "tool", A.tool_arguments().alias("arguments"), A.observation().alias("observation"))


def trace_roots(spark, sf_dir):
    """TK7: the root of each trace and the rule that chose it."""
    return traces.root_spans(_kept(spark, sf_dir))


def role_counts(spark, sf_dir):
    """AG5: spans by role in each trace."""
    return traces.trace_fields(_kept(spark, sf_dir)).select("trace_id", "spans_in", *[f"n_{r}" for r in ("root", "tool", "llm", "agent", "task", "skip", "other")])


def token_sums(spark, sf_dir):
    """AG6: token sums of each trace."""
    return traces.trace_fields(_kept(spark, sf_dir)).select("trace_id", "input_tokens", "output_tokens", "total_tokens")


def trace_fields(spark, sf_dir):
    """EXT1, EXT6-EXT8, PRJ10, PRJ21: task, success, app and framework of each trace."""
    return traces.trace_fields(_kept(spark, sf_dir)).select("trace_id", "task_id", "success", "success_source", "app_name", "framework")


def first_user_intent(spark, sf_dir):
    """EXT2-EXT4: intent and its source, first user message."""
    return traces.trace_fields(_kept(spark, sf_dir)).select("trace_id", "intent", "intent_source")


def last_user_intent(spark, sf_dir):
    """EXT3, EXT5: intent by the last user message before tools."""
    config = traces.ProjectionConfig(intent_strategy="last_user_before_tools")
    return traces.trace_fields(_kept(spark, sf_dir), config).select("trace_id", "intent", "intent_source")


def nearest_agent(spark, sf_dir):
    """JN2, JN3: agent of every span, its own or the nearest above."""
    return traces.nearest_agents(_kept(spark, sf_dir))


def asof_thoughts(spark, sf_dir):
    """JN4: the model span before each tool span."""
    return traces.previous_llm(_kept(spark, sf_dir))


def innermost_tools(spark, sf_dir):
    """JN6: tool spans without wrappers."""
    spans = _kept(spark, sf_dir)
    return traces.innermost_tools(spans, traces.span_trees(spans)).select("trace_id", "span_id", "tool")


def call_response_pairing(spark, sf_dir):
    """EXT12, JN7, PRJ17-PRJ19, WN16: calls in the latest messages of traces without named tool spans."""
    return traces.message_decisions(_kept(spark, sf_dir)).select("trace_id", "message", "place", "call_id", "tool", "observation")


def drop_reason_counts(spark, sf_dir):
    """EXT13, EXT15, FLT1, AG31: traces by drop reason."""
    fields, _ = traces.project(table(spark, sf_dir, "otel_spans"))
    return fields.groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("drop_reason")).agg(F.count(F.lit(1)).alias("n_traces"), F.sum("n_steps").alias("n_steps"))


def projected_steps(spark, sf_dir):
    """EXT13-EXT15, PRJ17, JN3, JN4: the steps of all traces, with agent, thought and a digest of the observation.

    The tables' model spans have no output, so all thoughts are empty there.
    """
    _, steps = traces.project(table(spark, sf_dir, "otel_spans"))
    return steps.select("trace_id", F.col("at.c").alias("span_id"), "agent_name", "action", F.md5("observation").alias("observation_md5"), "thoughts", "origin")


def catalog_first_source(spark, sf_dir):
    """AG8, SO1: tools seen in spans; the first description in order of start wins."""
    s = _spans(spark, sf_dir).filter("tool is not null")
    text = A.first_attr("attrs", "gen_ai.tool.description", "tool.description")
    return s.groupBy("tool").agg(F.coalesce(F.min_by(text, F.when(text.isNotNull(), F.struct("start", "span_id"))), F.lit("")).alias("description"), F.count(F.lit(1)).alias("n_spans"))


def idle_sessions(spark, sf_dir):
    """ST3 in batch: a trace's arrivals in sessions, closed by an idle gap of 30 s or more."""
    d = table(spark, sf_dir, "otel_spans").select(traces.canonical_id("trace_id", 16).alias("trace_id"), F.unix_micros(F.col("received_at").cast("timestamp")).alias("at")).filter("trace_id is not null")
    d = d.groupBy("trace_id", "at").agg(F.count(F.lit(1)).alias("n"))  # a burst is one row
    w = Window.partitionBy("trace_id").orderBy("at")
    new = F.coalesce((F.col("at") - F.lag("at").over(w) >= 30_000_000).cast("int"), F.lit(1))
    d = d.withColumn("new", new).withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return d.groupBy("trace_id", "session").agg(F.sum("n").alias("n_rows"), (F.max("at") - F.min("at")).alias("micros"))


def queries() -> dict:
    fs = (classify_spans, tool_io, trace_roots, role_counts, token_sums, trace_fields, first_user_intent, last_user_intent, nearest_agent, asof_thoughts, innermost_tools, call_response_pairing, drop_reason_counts, projected_steps, catalog_first_source, idle_sessions)
    return {f.__name__: f for f in fs}


def _attr(*keys: str, of: str = "j") -> str:
    return "coalesce(" + ", ".join(f"""nullif({of} ->> '$."{k}"', '')""" for k in keys) + ", NULL)"


def _own(key: str) -> str:
    """A member of the collector's own namespace."""
    return f"""nullif(j ->> ('$."' || own || '{key}"'), '')"""


def clean_spans_sql(copies: bool = False) -> str:
    """CTEs: s (clean spans with kind, role, tool; ``own`` is the collector's prefix, found in the data), with all ``copies`` or the first."""
    first = "" if copies else "QUALIFY row_number() OVER (PARTITION BY trace_id, span_id ORDER BY received_at, delivery_id) = 1"
    t, s, p = canonical_id_sql("trace_id", 16), canonical_id_sql("span_id", 8), canonical_id_sql("parent_span_id", 8)
    kind = f"lower(coalesce({_attr('traceloop.span.kind', 'openinference.span.kind')}, ''))"
    root = f"(coalesce(name = own || '{A.TASK}', false) OR coalesce({_own(A.TASK_ROOT)} NOT IN ('false', '0'), false))"
    called = f"coalesce({_attr('gen_ai.tool.name', 'tool.name')}, CASE WHEN kind = 'tool' THEN {_attr('traceloop.entity.name')} END, CASE WHEN name = 'tools/call.tool' THEN {_attr('traceloop.entity.input.tool_name')} END"
    named = "CASE WHEN name LIKE 'execute_tool %' THEN trim(substr(name, 14)) WHEN name = 'tools/call.tool' THEN '' WHEN name LIKE '%.tool' THEN trim(left(name, length(name) - 5)) WHEN name LIKE 'function.%' THEN trim(substr(name, 10)) ELSE '' END"
    bare = f"trim(split_part({called}, {named}), '(', 1))"
    prefix = """pf AS (SELECT coalesce((SELECT p FROM (SELECT regexp_extract(attributes, '"([A-Za-z0-9_-]+)\\.task_root"\\s*:', 1) AS p FROM otel_spans) WHERE p <> '' GROUP BY p ORDER BY count(*) DESC, p LIMIT 1), '') || '.' AS own)"""
    return f"""{prefix}, s0 AS (SELECT own, {t} AS trace_id, {s} AS span_id, {p} AS p, name, start_time_unix_nano AS t0, end_time_unix_nano AS t1, received_at, delivery_id,
        CASE WHEN json_valid(attributes) THEN CAST(attributes AS JSON) END AS j, CASE WHEN json_valid(resource) THEN CAST(resource AS JSON) END AS r FROM otel_spans, pf),
      s1 AS (SELECT * EXCLUDE (p), CASE WHEN NOT regexp_full_match(p, '0+') THEN p END AS p FROM s0 WHERE trace_id IS NOT NULL AND span_id IS NOT NULL {first}),
      s2 AS (SELECT *, {kind} AS kind, coalesce({_attr('gen_ai.operation.name', 'llm.request.type')}, '') AS op, {root} AS is_root FROM s1),
      s3 AS (SELECT *, CASE WHEN op IN ('embeddings', 'vector_db_retrieve', 'handoff') OR kind IN ('session', 'handoff', 'server') THEN 'skip' WHEN is_root THEN 'root' WHEN name IN ('mcp_tools', 'tools/list') THEN 'skip'
        WHEN op = 'execute_tool' OR {_attr('gen_ai.tool.name', 'tool.name')} IS NOT NULL OR name LIKE 'execute_tool %' OR name LIKE '%.tool' OR (name LIKE 'function.%' AND kind IN ('tool', '')) OR kind = 'tool' THEN 'tool'
        WHEN op IN ('chat', 'text_completion', 'completion', 'llm_request') OR kind = 'llm' THEN 'llm' WHEN kind IN ('workflow', 'agent') OR op = 'invoke_agent' THEN 'agent' WHEN kind = 'task' OR op = 'execute_task' THEN 'task' ELSE 'other' END AS role FROM s2),
      s AS (SELECT *, CASE WHEN role = 'tool' AND {bare} NOT IN ('', 'mcp_tools', 'tools/list', own || '{A.TASK}') THEN {bare} END AS tool FROM s3)"""


def oracle_sql() -> dict[str, str]:
    base = clean_spans_sql()
    roots = f"""{base}, rr AS (SELECT s.*, CASE WHEN is_root THEN 0 WHEN kind IN ('workflow', 'agent') AND NOT EXISTS (SELECT 1 FROM s u WHERE u.trace_id = s.trace_id AND u.span_id = s.p AND u.kind IN ('workflow', 'agent')) THEN 1
        WHEN p IS NULL THEN 2 ELSE 3 END AS rule FROM s), root AS (SELECT trace_id, arg_min(span_id, (rule, t0, span_id)) AS root_span_id, min(rule) AS root_rule FROM rr GROUP BY trace_id)"""
    blob = f"CASE WHEN json_valid({_attr('traceloop.association.properties')}) THEN CAST({_attr('traceloop.association.properties')} AS JSON) END"
    assoc = lambda k: f"coalesce({_own(k)}, nullif(b ->> '$.{k}', ''))"
    raw = f"lower(trim(coalesce({_own('success')}, {_attr('traceloop.association.properties.success')}, b ->> '$.success')))"
    x = f"{roots}, x AS (SELECT rr.*, root_span_id, span_id = root_span_id AS me, {blob} AS b FROM rr JOIN root USING (trace_id)), y AS (SELECT *, CASE WHEN {raw} IN ('true', '1', 'yes', '1.0') THEN true WHEN {raw} IN ('false', '0', 'no', '0.0') THEN false END AS ok, {_attr('service.name', of='r')} AS service, {_attr('traceloop.workflow.name', 'gen_ai.agent.name')} AS wf, {_attr('gen_ai.conversation.id')} AS conv FROM x)"
    pick = lambda v, o, c="true": f"arg_min({v}, {o}) FILTER (WHERE ({v}) IS NOT NULL AND {c})"
    start, first = "(t0, span_id)", "(NOT me, t0, span_id)"
    norm = lambda e: f"CASE WHEN json_type({e}) = 'VARCHAR' THEN CASE WHEN json_valid({e} ->> '$') THEN CAST({e} ->> '$' AS JSON) END ELSE {e} END"
    m1, m2 = norm("""json_extract(j, '$."gen_ai.input.messages"')"""), norm("""json_extract(j, '$."gen_ai"."input"."messages"')""")
    some = lambda e: f"CASE json_type({e}) WHEN 'ARRAY' THEN {e} WHEN 'OBJECT' THEN json_array({e}) END"
    given = """nullif(j ->> '$."gen_ai.input.messages"', '')"""
    ms = f"CASE WHEN {given} IS NOT NULL THEN {some(m1)} ELSE {some(m2)} END"
    msg = f"""ms AS (SELECT *, {ms} AS ms FROM s WHERE role = 'llm'), mi AS (SELECT trace_id, span_id, t0, i, json_extract(ms, '$[' || i || ']') AS m FROM (SELECT *, unnest(range(CAST(json_array_length(ms) AS BIGINT))) AS i FROM ms WHERE ms IS NOT NULL)),
      mt AS (SELECT *, lower(coalesce(m ->> '$.role', '')) AS who, trim(coalesce(nullif(array_to_string([z ->> '$.content' FOR z IN CAST(m -> '$.parts' AS JSON[]) IF z ->> '$.type' IN ('text', 'input_text', 'content') AND z ->> '$.content' <> ''], ' '), ''),
        CASE WHEN json_type(m -> '$.content') = 'ARRAY' THEN array_to_string([z ->> '$.text' FOR z IN CAST(m -> '$.content' AS JSON[]) IF z ->> '$.text' <> ''], ' ') ELSE m ->> '$.content' END, ''), ' \t\r\n\u00a0') AS text FROM mi WHERE json_type(m) = 'OBJECT'),
      us AS (SELECT * FROM mt WHERE who IN ('user', 'human') AND text <> '')"""
    calls = """cl AS (SELECT trace_id, span_id, t0, i, row_number() OVER (PARTITION BY trace_id, span_id, i ORDER BY o, k) - 1 AS c, coalesce(y ->> '$.id', '') AS call_id, trim(split_part(coalesce(CASE WHEN o = 1 AND json_type(y -> '$.function') = 'OBJECT' THEN y ->> '$.function.name' ELSE y ->> '$.name' END, ''), '(', 1)) AS tool,
        coalesce(CASE WHEN o = 1 AND json_type(y -> '$.function') = 'OBJECT' THEN y ->> '$.function.arguments' ELSE y ->> '$.arguments' END, '') AS arguments
        FROM (SELECT *, json_extract(l, '$[' || k || ']') AS y FROM (SELECT *, unnest(range(CAST(json_array_length(l) AS BIGINT))) AS k FROM (SELECT mt.*, o, json_extract(m, f) AS l FROM mt, (VALUES (0, '$.parts'), (1, '$.tool_calls')) v(o, f)) WHERE json_type(l) = 'ARRAY'))
        WHERE json_type(y) = 'OBJECT' AND (o = 1 OR y ->> '$.type' IN ('tool_call', 'function_call')))"""
    fields = f"""{x}, {msg}, u1 AS (SELECT trace_id, arg_min(text, (t0, span_id, i)) AS text FROM us GROUP BY trace_id),
      f AS (SELECT trace_id, coalesce({pick(assoc('task_id'), start, 'me')}, {pick('conv', start)}, trace_id) AS task_id, {pick('ok', first)} AS ok, coalesce({pick(assoc('app_name'), start, 'me')}, {pick('service', first)}, {pick('wf', first)}, '') AS app_name,
        nullif(trim({pick(assoc('intent'), start, 'me')}, ' \t\r\n\u00a0'), '') AS said, count(*) AS spans_in, bool_or(name LIKE 'tools/call%' OR name LIKE '%mcp.server%') AS mcp, bool_or(name LIKE 'execute_tool %') AS ex, bool_or(name LIKE '%workflow%') AS w, bool_or(name LIKE '%.tool') AS tl, bool_or(name LIKE '%.agent%') AS ag, bool_or(name LIKE 'function.%') AS fn FROM y GROUP BY trace_id),
      g AS (SELECT f.*, coalesce(said, u1.text, '') AS intent, CASE WHEN said IS NOT NULL THEN 'association' WHEN u1.text IS NOT NULL THEN 'user_message' ELSE '' END AS intent_source FROM f LEFT JOIN u1 USING (trace_id))"""
    d, sp, pp = canonical_id_sql("trace_id", 16), canonical_id_sql("span_id", 8), canonical_id_sql("parent_span_id", 8)
    up = "up AS (SELECT l.trace_id, l.span_id, l.span_id AS at, l.p, l.agent, 0 AS n FROM l UNION ALL SELECT up.trace_id, up.span_id, l.span_id, l.p, l.agent, n + 1 FROM up JOIN l ON l.trace_id = up.trace_id AND l.span_id = up.p WHERE up.agent IS NULL AND n < 600)"
    above = "ab AS (SELECT trace_id, span_id, tool, p, 0 AS n FROM s WHERE tool IS NOT NULL UNION ALL SELECT ab.trace_id, ab.span_id, ab.tool, s.p, n + 1 FROM ab JOIN s ON s.trace_id = ab.trace_id AND s.span_id = ab.p WHERE n < 600)"
    inner = f"""{above}, rt AS (SELECT DISTINCT ab.trace_id, ab.span_id FROM ab WHERE p IS NULL OR NOT EXISTS (SELECT 1 FROM s WHERE s.trace_id = ab.trace_id AND s.span_id = ab.p)),
      wr AS (SELECT DISTINCT s.trace_id, s.span_id FROM ab JOIN rt USING (trace_id, span_id) JOIN s ON s.trace_id = ab.trace_id AND s.span_id = ab.p AND s.tool = ab.tool)"""
    decided = f"""{msg}, {calls}, tr AS (SELECT trace_id, bool_or(tool IS NOT NULL) AS named, arg_max(span_id, (t0, span_id)) FILTER (WHERE role = 'llm') AS last FROM s GROUP BY trace_id),
      la AS (SELECT cl.* FROM cl JOIN tr ON tr.trace_id = cl.trace_id AND tr.last = cl.span_id AND NOT named WHERE cl.tool <> ''),
      lc AS (SELECT * FROM la QUALIFY row_number() OVER (PARTITION BY trace_id, CASE WHEN call_id <> '' THEN call_id ELSE i || '|' || tool || '|' || arguments END, call_id = '' ORDER BY i, c) = 1),
      rs AS (SELECT mt.trace_id, call_id, arg_min(text, i) AS text FROM (SELECT *, coalesce(m ->> '$.tool_call_id', m ->> '$.id') AS call_id FROM mt WHERE who IN ('tool', 'function')) mt JOIN tr ON tr.trace_id = mt.trace_id AND tr.last = mt.span_id AND NOT named WHERE call_id <> '' GROUP BY ALL)"""
    args = _attr("gen_ai.tool.call.arguments", "traceloop.entity.input", "input.value")
    tokens = lambda k: f"CAST(sum(coalesce(CAST(trunc(TRY_CAST({_attr(f'gen_ai.usage.{k}_tokens', f'llm.usage.{k}_tokens')} AS DOUBLE)) AS BIGINT), 0)) AS BIGINT) AS {k}_tokens"
    return {
        "classify_spans": f"WITH {base} SELECT trace_id, span_id, role, tool FROM s",
        "tool_io": f"""WITH {base}, a AS (SELECT *, {args} AS args FROM s WHERE tool IS NOT NULL), b AS (SELECT *, CASE WHEN json_valid(args) THEN CAST(args AS JSON) END AS aj FROM a)
          SELECT trace_id, span_id, tool, coalesce(CASE WHEN json_type(aj -> '$.arguments') NOT IN ('OBJECT', 'ARRAY') THEN aj ->> '$.arguments' END, CASE WHEN json_type(aj -> '$.input_str') NOT IN ('OBJECT', 'ARRAY') THEN aj ->> '$.input_str' END, args, '') AS arguments,
          left(coalesce({_attr('gen_ai.tool.call.result', 'traceloop.entity.output', 'output.value', 'gen_ai.task.output')}, ''), 2000) AS observation FROM b""",
        "trace_roots": f"WITH {roots} SELECT trace_id, root_span_id, CAST(root_rule AS INTEGER) AS root_rule FROM root",
        "role_counts": f"WITH {base} SELECT trace_id, count(*) AS spans_in, " + ", ".join(f"count(*) FILTER (WHERE role = '{r}') AS n_{r}" for r in ("root", "tool", "llm", "agent", "task", "skip", "other")) + " FROM s GROUP BY trace_id",
        "token_sums": f"WITH {base} SELECT trace_id, {tokens('input')}, {tokens('output')}, {tokens('total')} FROM s GROUP BY trace_id",
        "trace_fields": f"""WITH {fields} SELECT trace_id, task_id, coalesce(ok, false) AS success, CASE WHEN ok IS NULL THEN 'unknown' ELSE 'association' END AS success_source, app_name,
          CASE WHEN mcp AND (ex OR w) THEN 'mixed' WHEN mcp THEN 'mcp' WHEN ex THEN 'langchain' WHEN tl AND ag THEN 'openai_agents' WHEN ag THEN 'crewai' WHEN fn THEN 'openinference' WHEN tl THEN 'agno' ELSE 'unknown' END AS framework FROM g""",
        "first_user_intent": f"WITH {fields} SELECT trace_id, intent, intent_source FROM g",
        "last_user_intent": f"""WITH {fields}, {calls}, fc AS (SELECT trace_id, min(t0) AS t FROM cl GROUP BY trace_id),
          lu AS (SELECT us.trace_id, coalesce(arg_max(text, (t0, span_id, i)) FILTER (WHERE t IS NULL OR t0 <= t), arg_max(text, (t0, span_id, i))) AS text FROM us LEFT JOIN fc USING (trace_id) GROUP BY us.trace_id)
          SELECT trace_id, coalesce(said, lu.text, '') AS intent, CASE WHEN said IS NOT NULL THEN 'association' WHEN lu.text IS NOT NULL THEN 'last_user_before_tools' ELSE '' END AS intent_source FROM g LEFT JOIN lu USING (trace_id)""",
        "nearest_agent": f"WITH RECURSIVE {base}, l AS (SELECT trace_id, span_id, p, {_attr('gen_ai.agent.name')} AS agent FROM s), {up} SELECT trace_id, span_id, coalesce(arg_min(agent, n) FILTER (WHERE agent IS NOT NULL), '') AS agent_name FROM up GROUP BY trace_id, span_id",
        "asof_thoughts": f"WITH {base} SELECT a.trace_id, a.span_id, arg_max(b.span_id, (b.t1, b.span_id)) AS llm_span_id FROM (SELECT * FROM s WHERE tool IS NOT NULL) a LEFT JOIN (SELECT * FROM s WHERE role = 'llm') b ON b.trace_id = a.trace_id AND b.t1 <= a.t0 GROUP BY a.trace_id, a.span_id",
        "innermost_tools": f"WITH RECURSIVE {base}, {inner} SELECT s.trace_id, s.span_id, s.tool FROM s LEFT JOIN wr USING (trace_id, span_id) WHERE s.tool IS NOT NULL AND wr.span_id IS NULL",
        "call_response_pairing": f"WITH {base}, {decided} SELECT lc.trace_id, CAST(i AS INTEGER) AS message, CAST(c AS INTEGER) AS place, lc.call_id, lc.tool, coalesce(rs.text, '') AS observation FROM lc LEFT JOIN rs ON rs.trace_id = lc.trace_id AND rs.call_id = lc.call_id",
        "drop_reason_counts": f"""WITH RECURSIVE {fields}, {inner}, {calls}, tr AS (SELECT trace_id, bool_or(tool IS NOT NULL) AS named, arg_max(span_id, (t0, span_id)) FILTER (WHERE role = 'llm') AS last FROM s GROUP BY trace_id),
          la AS (SELECT cl.* FROM cl JOIN tr ON tr.trace_id = cl.trace_id AND tr.last = cl.span_id AND NOT named WHERE cl.tool <> ''),
          n AS (SELECT trace_id, sum(k) AS k FROM (SELECT s.trace_id, count(*) AS k FROM s LEFT JOIN wr USING (trace_id, span_id) WHERE s.tool IS NOT NULL AND wr.span_id IS NULL GROUP BY s.trace_id
            UNION ALL SELECT trace_id, count(DISTINCT (CASE WHEN call_id <> '' THEN call_id ELSE i || '|' || tool || '|' || arguments END, call_id = '')) FROM la GROUP BY trace_id) GROUP BY trace_id)
          SELECT CASE WHEN intent = '' THEN 'missing_intent' WHEN ok IS NULL THEN 'success_unknown' WHEN k IS NULL THEN 'zero_tool_spans' ELSE 'kept' END AS drop_reason, count(*) AS n_traces, CAST(sum(coalesce(k, 0)) AS BIGINT) AS n_steps FROM g LEFT JOIN n USING (trace_id) GROUP BY 1""",
        "projected_steps": f"""WITH RECURSIVE {base}, {inner}, {decided}, l AS (SELECT trace_id, span_id, p, {_attr('gen_ai.agent.name')} AS agent FROM s), {up},
          ag AS (SELECT trace_id, span_id, coalesce(arg_min(agent, n) FILTER (WHERE agent IS NOT NULL), '') AS agent_name FROM up GROUP BY trace_id, span_id)
          SELECT s.trace_id, s.span_id, agent_name, s.tool AS action, md5(left(coalesce({_attr('gen_ai.tool.call.result', 'traceloop.entity.output', 'output.value', 'gen_ai.task.output')}, ''), 2000)) AS observation_md5, '' AS thoughts, 'tool' AS origin
          FROM s JOIN ag USING (trace_id, span_id) LEFT JOIN wr USING (trace_id, span_id) WHERE s.tool IS NOT NULL AND wr.span_id IS NULL
          UNION ALL SELECT lc.trace_id, '', '', lc.tool, md5(left(coalesce(rs.text, ''), 2000)), '', 'llm_fallback' FROM lc LEFT JOIN rs ON rs.trace_id = lc.trace_id AND rs.call_id = lc.call_id""",
        "catalog_first_source": f"WITH {base}, a AS (SELECT *, {_attr('gen_ai.tool.description', 'tool.description')} AS d FROM s WHERE tool IS NOT NULL) SELECT tool, coalesce(arg_min(d, (t0, span_id)) FILTER (WHERE d IS NOT NULL), '') AS description, count(*) AS n_spans FROM a GROUP BY tool",
        "idle_sessions": f"""WITH a AS (SELECT {d} AS trace_id, epoch_us(received_at) AS ts FROM otel_spans), b AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= 30000000 OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM a WHERE trace_id IS NOT NULL WINDOW w AS (PARTITION BY trace_id ORDER BY ts)),
          c AS (SELECT *, sum(new) OVER (PARTITION BY trace_id ORDER BY ts) AS session FROM b) SELECT trace_id, CAST(session AS BIGINT) AS session, count(*) AS n_rows, max(ts) - min(ts) AS micros FROM c GROUP BY trace_id, session""",
    }
