"""Queries over trajectories: statistics, context, negatives, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import corpus, sampling
from .records import table


def _recs(spark, sf_dir):
    return corpus.records(table(spark, sf_dir, "trajectories"))


def _catalog(spark, sf_dir):
    return table(spark, sf_dir, "tool_catalog").select(N.tool_name("tool_name").alias("tool"), "description").filter("tool is not null")


def tool_frequency(spark, sf_dir):
    """AG1."""
    return corpus.tool_frequency(_recs(spark, sf_dir))


def tool_cooccurrence(spark, sf_dir):
    """AG2."""
    return corpus.co_occurrence(_recs(spark, sf_dir))


def total_records(spark, sf_dir):
    """AG4, TK5: records in all and the five most common tools."""
    recs = _recs(spark, sf_dir)
    top = corpus.tool_frequency(recs).orderBy(F.desc("n_records"), "tool").limit(5)
    return top.crossJoin(F.broadcast(recs.agg(F.count(F.lit(1)).alias("n_total"))))


def app_tool_sets(spark, sf_dir):
    """AG3, AG11."""
    return corpus.app_tools(_recs(spark, sf_dir)).withColumn("tools", F.array_join("tools", ","))


def dominant_app(spark, sf_dir):
    """AG12: the family most of a record's tools belong to; ties go to the one seen first."""
    fam = F.broadcast(table(spark, sf_dir, "tool_catalog").select(N.tool_name("tool_name").alias("tool"), "app_family"))
    r = _recs(spark, sf_dir).select("record_id", F.posexplode(F.array_distinct(F.filter("names", lambda x: x.isNotNull()))).alias("pos", "tool")).join(fam, "tool")
    per = r.groupBy("record_id", "app_family").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("pos"))
    return per.groupBy("record_id").agg(F.min_by("app_family", F.struct(-F.col("n"), "pos")).alias("app_family"))


def quality_gate(spark, sf_dir):
    """FLT1-FLT3: every record's drop reason."""
    return corpus.gate(_recs(spark, sf_dir)).select("record_id", "drop_reason")


def gate_counts(spark, sf_dir):
    """AG31: records by drop reason."""
    return quality_gate(spark, sf_dir).groupBy(F.coalesce("drop_reason", F.lit("kept")).alias("drop_reason")).agg(F.count(F.lit(1)).alias("n"))


def prev_tools_context(spark, sf_dir):
    """WN2-WN7, WN9: context of every tool step."""
    return corpus.contexts(_recs(spark, sf_dir)).select("record_id", "k", "tool", "previous_tools", "n_spans", "last_thought", "last_action", "last_observation", "unique_tools_so_far", F.round("tool_diversity", 6).alias("tool_diversity"))


def history_summary(spark, sf_dir):
    """WN8."""
    return corpus.contexts(_recs(spark, sf_dir)).select("record_id", "k", "history_summary")


def span_expansion(spark, sf_dir):
    """WN10."""
    return corpus.expansions(_recs(spark, sf_dir))


def catalog_merge(spark, sf_dir):
    """JN16, AG9, SRC23: the catalog joined with tools that only records show; the catalog's text wins."""
    seen = corpus.tool_frequency(_recs(spark, sf_dir)).select("tool", F.lit("").alias("derived"), "n_records")
    j = _catalog(spark, sf_dir).join(seen, "tool", "full")
    return j.select("tool", F.coalesce(F.nullif("description", F.lit("")), "derived", F.lit("")).alias("description"), F.coalesce("n_records", F.lit(0)).alias("tool_frequency"))


def tool_features(spark, sf_dir):
    """PRJ29, PRJ30, JN12, JN15: features of every catalog tool."""
    t, p = table(spark, sf_dir, "tool_catalog"), "parameters"
    n = lambda f: F.size(F.filter(F.coalesce(p, F.slice(p, 1, 0)), f)).cast("long")
    of_kind = lambda k: n(lambda x: x["type"] == k)
    kinds = [of_kind(k).alias(f"n_{k}_params") for k in ("string", "integer", "number", "boolean", "array")]
    freq = corpus.tool_frequency(_recs(spark, sf_dir)).withColumnRenamed("tool", "tool_name")
    t = t.select("tool_name", F.length("tool_name").alias("tool_name_length"), (F.coalesce("description", F.lit("")) != "").alias("has_description"), n(lambda x: F.lit(True)).alias("n_params"), *kinds, n(lambda x: F.size(x["enum"]) > 0).alias("n_enum_params"))
    return t.withColumn("has_parameters", F.col("n_params") > 0).join(freq, "tool_name", "left").withColumn("tool_frequency", F.coalesce("n_records", F.lit(0))).drop("n_records")


def candidate_text(spark, sf_dir):
    """PRJ24, SRC22: a tool with description and arguments as one text."""
    arg = F.transform("parameters", lambda p: F.concat(p["name"], F.lit(" ("), p["type"], F.lit(")"), F.when(F.coalesce(p["description"], F.lit("")) != "", F.concat(F.lit(": "), p["description"])).otherwise(F.lit(""))))
    args = F.when(F.size("parameters") > 0, F.concat(F.lit("args: "), F.array_join(arg, "; ")))
    return table(spark, sf_dir, "tool_catalog").select("tool_name", F.concat_ws(" | ", "tool_name", F.nullif("description", F.lit("")), args).alias("text"))


def spec_coverage(spark, sf_dir):
    """AG28, AG29: how many tools in use the catalog knows, and the share."""
    used = corpus.tool_frequency(_recs(spark, sf_dir)).select("tool").join(_catalog(spark, sf_dir).select("tool", F.lit(1).alias("known")), "tool", "left")
    return used.agg(F.count(F.lit(1)).alias("n_used"), F.coalesce(F.sum("known"), F.lit(0)).alias("n_resolved")).withColumn("coverage", F.round(F.coalesce(F.try_divide("n_resolved", "n_used"), F.lit(0.0)), 6))


def missing_specs(spark, sf_dir):
    """JN20, SO4: tools in use that the catalog lacks, one row each."""
    return corpus.tool_frequency(_recs(spark, sf_dir)).join(_catalog(spark, sf_dir).select("tool"), "tool", "left_anti")


def train_frequency_guard(spark, sf_dir):
    """FLT9: rows of other splits whose tools training has never seen, by how many; their frequency must count as 0."""
    recs = _recs(spark, sf_dir)
    freq = corpus.tool_frequency(recs.filter("split_name = 'train'"))
    ev = recs.filter("split_name in ('test', 'validation')").select("record_id", F.explode("tools").alias("tool"))
    return corpus.guarded_frequency(ev, freq).groupBy("record_id").agg(F.sum((F.col("tool_frequency") == 0).cast("long")).alias("n_unseen"), F.sum("tool_frequency").alias("frequency"))


def tool_app_match(spark, sf_dir):
    """JN13: whether the app is known to use the step's tool, by the other records' statistics."""
    recs = _recs(spark, sf_dir)
    known = recs.filter("split_name = 'train' and app is not null").select("app", F.explode("tools").alias("tool")).distinct().withColumn("tool_app_match", F.lit(1))
    return corpus.contexts(recs).select("record_id", "k", "app", "tool").join(known, ["app", "tool"], "left").select("record_id", "k", "tool", F.coalesce("tool_app_match", F.lit(0)).alias("tool_app_match"))


def cooccurrence_score(spark, sf_dir):
    """JN14: mean frozen count of the step's tool with the tools before it, repeats counted."""
    frozen = table(spark, sf_dir, "co_occurrence").select("tool_a", "tool_b", "n_together")
    c = corpus.contexts(_recs(spark, sf_dir)).filter("previous_tools <> ''").select("record_id", "k", "tool", F.explode(F.split("previous_tools", r" \| ")).alias("prev"))
    j = c.join(frozen, (c.tool == frozen.tool_a) & (c.prev == frozen.tool_b), "left")
    return j.groupBy("record_id", "k", "tool").agg(F.round(F.sum(F.coalesce("n_together", F.lit(0))) / F.count(F.lit(1)), 6).alias("tool_co_occurrence"))


def random_negatives(spark, sf_dir):
    """SP1, JN17, SO2."""
    recs = _recs(spark, sf_dir).select("record_id", "tools")
    d = sampling.random_negatives(recs, _catalog(spark, sf_dir), "record_id", "tools", 3)
    return d.select("record_id", F.array_join("negatives", ",").alias("negatives"))


def hard_negatives(spark, sf_dir):
    """SP2, SP4."""
    recs = _recs(spark, sf_dir)
    train = recs.filter("split_name = 'train'")
    d = sampling.hard_negatives(recs.select("record_id", "app", "tools"), _catalog(spark, sf_dir), corpus.app_tools(train), corpus.co_occurrence(train), n=10)
    return d.select("record_id", F.array_join("negatives", ",").alias("negatives"))


def mixed_negatives(spark, sf_dir):
    """SP3."""
    recs = _recs(spark, sf_dir)
    train = recs.filter("split_name = 'train'")
    d = sampling.mixed_negatives(recs.select("record_id", "app", "tools"), _catalog(spark, sf_dir), corpus.app_tools(train), corpus.co_occurrence(train), n=6)
    return d.select("record_id", F.array_join("negatives", ",").alias("negatives"))


def pointwise_rows(spark, sf_dir):
    """SP5: positives and three negatives for each."""
    recs = _recs(spark, sf_dir).select("record_id", "tools").withColumn("n", F.size("tools") * 3)
    d = sampling.random_negatives(recs, _catalog(spark, sf_dir), "record_id", "tools", F.col("n"))
    return sampling.pointwise(d, "tools", ["record_id"])


def per_decision_rows(spark, sf_dir):
    """SP6, WN11, FLT8: one positive per step; negatives leave out what was used before."""
    c = corpus.contexts(_recs(spark, sf_dir)).select("record_id", "k", "tool", "used").withColumn("decision", F.concat(F.col("record_id").cast("string"), F.lit(":"), "k")).withColumn("out", F.array_append("used", F.col("tool")))
    d = sampling.random_negatives(c, _catalog(spark, sf_dir), "decision", "out", 3).withColumn("pos", F.array("tool"))
    return sampling.pointwise(d, "pos", ["record_id", "k"])


def app_scoped_candidates(spark, sf_dir):
    """JN10, JN11, SP7: candidates of each record, the tools its app uses in training, with labels."""
    recs = _recs(spark, sf_dir)
    per = corpus.app_tools(recs.filter("split_name = 'train'")).select("app", F.col("tools").alias("pool"))
    return recs.select("record_id", "app", "tools").join(per, "app").select("record_id", F.explode("pool").alias("tool_name"), "tools").select("record_id", "tool_name", F.array_contains("tools", F.col("tool_name")).cast("int").alias("label"))


def group_split(spark, sf_dir):
    """SP8: tasks in training and test."""
    return sampling.group_split(_recs(spark, sf_dir), "task")


def random_tasks(spark, sf_dir):
    """SP13: a hundred tasks by chance."""
    return sampling.random_groups(_recs(spark, sf_dir), "task", 100)


def group_kfold(spark, sf_dir):
    """SP9: tasks in five folds."""
    return sampling.group_kfold(_recs(spark, sf_dir), "task")


def unseen_tasks(spark, sf_dir):
    """AG27, FLT9: evaluation records none of whose tools occurs in training."""
    recs = _recs(spark, sf_dir)
    known = recs.filter("split_name = 'train'").select(F.explode("tools").alias("tool")).distinct().withColumn("known", F.lit(1))
    ev = recs.filter("split_name in ('test', 'validation')").select("record_id", F.explode("tools").alias("tool")).join(known, "tool", "left")
    return ev.groupBy("record_id").agg(F.count(F.lit(1)).alias("n_tools"), F.coalesce(F.sum("known"), F.lit(0)).alias("n_known")).withColumn("unseen", F.col("n_known") == 0)


QUERIES = (tool_frequency, tool_cooccurrence, app_tool_sets, dominant_app, quality_gate, gate_counts, prev_tools_context, history_summary, span_expansion, catalog_merge, tool_features, candidate_text, spec_coverage, missing_specs, train_frequency_guard, total_records, tool_app_match, cooccurrence_score, random_negatives, hard_negatives, mixed_negatives, pointwise_rows, per_decision_rows, app_scoped_candidates, group_split, random_tasks, group_kfold, unseen_tasks)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def records_sql() -> str:
    """CTEs: rec (records with their tools) and st (steps, k from 0)."""
    name = N.tool_name_sql
    names = lambda c: f"[z FOR z IN [{name('x')} FOR x IN {c}] IF z IS NOT NULL]"
    return f"""rec AS (SELECT record_id, {N.task_key_sql('task_id')} AS task, {N.app_key_sql('app_name')} AS app, intent, coalesce(success, score >= 1, true) AS success, {N.split_key_sql('split_name')} AS split_name, recorded_at, metadata, spans,
        list_sort(list_distinct(CASE WHEN len(tools_used) > 0 THEN {names('tools_used')} ELSE coalesce({names('[y.action FOR y IN spans]')}, []) END)) AS tools FROM trajectories),
      st AS (SELECT record_id, k, {name('s.action')} AS tool, s.observation AS obs, s.thoughts AS th FROM (SELECT record_id, unnest(range(len(spans))) AS k, unnest(spans) AS s FROM trajectories)),
      ut AS (SELECT record_id, app, split_name, unnest(tools) AS tool FROM rec), cat AS (SELECT {name('tool_name')} AS tool, description FROM tool_catalog)"""


def contexts_sql() -> str:
    """CTEs of ``records_sql`` and ctx (context of every tool step)."""
    base = records_sql()
    return f"""{base}, w AS (SELECT *, string_agg(tool, ' | ') OVER p AS prev, lag(th) OVER o AS th0, lag(obs) OVER o AS obs0, last_value(tool IGNORE NULLS) OVER p AS act, len(list_distinct(list(tool) FILTER (WHERE tool IS NOT NULL) OVER p)) AS uniq,
        string_agg(coalesce(tool, 'think') || '→' || left(coalesce(obs, ''), 50), ' | ') OVER h AS hist FROM st
        WINDOW o AS (PARTITION BY record_id ORDER BY k), p AS (PARTITION BY record_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), h AS (PARTITION BY record_id ORDER BY k ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING)),
      ctx AS (SELECT * FROM w WHERE tool IS NOT NULL)"""


def _number_sql(seed: str, d: str, what: str) -> str:
    return f"CAST(('0x' || substr(md5('{seed}:' || {d} || ':' || {what}), 1, 8)) AS BIGINT)"


def drawn_sql(pool: str, seed: str, d: str, n: str) -> str:
    """n tools of a list, as ``sampling`` draws them."""
    m, k = f"len({pool})", f"least({n}, len({pool}))"
    edge = lambda j: f"(({j}) * {m} // {k})"
    at = f"({_number_sql(seed, d, chr(39) + 'off' + chr(39))} + {edge('j')} + {_number_sql(seed, d, 'j')} % ({edge('j + 1')} - {edge('j')})) % {m}"
    return f"[{pool}[1 + {at}] FOR j IN range({k})]"


def negatives_sql(n: str, seed: str = "neg") -> str:
    """CTEs up to ng: ``negatives`` of the rows x (``id``, ``ex``)."""
    return f"cl AS (SELECT list(tool ORDER BY tool) AS cl FROM cat), pl AS (SELECT x.*, [t FOR t IN cl IF NOT list_contains(ex, t)] AS pool FROM x, cl), ng AS (SELECT *, {drawn_sql('pool', seed, 'id', n)} AS negatives FROM pl)"


def oracle_sql() -> dict[str, str]:
    base, ctx, drawn, neg = records_sql(), contexts_sql(), drawn_sql, negatives_sql
    gate = f"""{base}, g AS (SELECT *, metadata ->> '$."otel.trace_id"' AS trace, CASE WHEN coalesce(trim(intent, ' \t\r\n '), '') = '' THEN 'missing_intent' WHEN NOT EXISTS (SELECT 1 FROM st WHERE st.record_id = rec.record_id AND tool IS NOT NULL) THEN 'zero_tool_spans'
        WHEN coalesce(metadata ->> '$."success_source"', 'unknown') = 'unknown' THEN 'success_unknown' WHEN NOT success THEN 'success_false' WHEN len(spans) > 200 THEN 'too_many_spans' END AS r FROM rec),
      q AS (SELECT record_id, CASE WHEN r IS NOT NULL THEN r WHEN trace IS NOT NULL AND row_number() OVER (PARTITION BY trace, r IS NULL ORDER BY recorded_at, record_id) > 1 THEN 'duplicate_trace' END AS drop_reason FROM g)"""
    n_of = lambda k: f"CAST(len([p FOR p IN parameters IF p.type = '{k}']) AS BIGINT) AS n_{k}_params"
    tr = "split_name = 'train'"
    hard = lambda n, a, c, s: f"""{base}, ap AS (SELECT DISTINCT app, tool FROM ut WHERE {tr} AND app IS NOT NULL), co AS (SELECT a.tool AS a, b.tool AS b, count(*) AS n FROM ut a JOIN ut b ON a.record_id = b.record_id AND a.tool <> b.tool WHERE a.{tr} GROUP BY ALL),
      po AS (SELECT rec.record_id AS d, app, tools, cat.tool FROM rec, cat WHERE NOT list_contains(tools, cat.tool)),
      sa AS (SELECT d, list(po.tool ORDER BY po.tool) AS pool FROM po JOIN ap ON ap.app = po.app AND ap.tool = po.tool GROUP BY d),
      s1 AS (SELECT d, unnest(l) AS tool, unnest(range(len(l))) AS n FROM (SELECT d, {drawn("pool", "neg:app", "d", str(a))} AS l FROM sa)),
      c1 AS (SELECT ut.record_id AS d, ut.tool AS a, co.b AS tool, row_number() OVER (PARTITION BY ut.record_id ORDER BY ut.tool, n DESC, co.b DESC) AS o FROM ut JOIN co ON co.a = ut.tool),
      s2 AS (SELECT d, tool, row_number() OVER (PARTITION BY d ORDER BY o) AS n FROM (SELECT c1.d, c1.tool, min(o) AS o FROM c1 JOIN po ON po.d = c1.d AND po.tool = c1.tool WHERE NOT EXISTS (SELECT 1 FROM s1 WHERE s1.d = c1.d AND s1.tool = c1.tool) GROUP BY ALL)),
      wd AS (SELECT tool, [x FOR x IN list_distinct(string_split_regex(lower(coalesce(nullif(description, ''), tool)), '\\s+')) IF x <> ''] AS words FROM cat),
      mw AS (SELECT record_id AS d, list_distinct(flatten(list(words))) AS words FROM ut JOIN wd USING (tool) GROUP BY 1),
      s3 AS (SELECT po.d, po.tool, row_number() OVER (PARTITION BY po.d ORDER BY len(list_intersect(wd.words, coalesce(mw.words, []))) DESC, po.tool) AS n FROM po JOIN wd USING (tool) LEFT JOIN mw ON mw.d = po.d
        WHERE NOT EXISTS (SELECT 1 FROM s1 WHERE s1.d = po.d AND s1.tool = po.tool) AND NOT EXISTS (SELECT 1 FROM s2 WHERE s2.d = po.d AND s2.tool = po.tool) QUALIFY n <= {s}),
      hd AS (SELECT d, tool, 1 AS st, n FROM s1 UNION ALL SELECT d, tool, 2, n FROM s2 WHERE n <= {c} UNION ALL SELECT d, tool, 3, n FROM s3),
      fp AS (SELECT po.d, list(po.tool ORDER BY po.tool) AS pool, {n} - (SELECT count(*) FROM hd WHERE hd.d = po.d) AS n FROM po WHERE NOT EXISTS (SELECT 1 FROM hd WHERE hd.d = po.d AND hd.tool = po.tool) GROUP BY po.d),
      fl AS (SELECT d, unnest(l) AS tool, 4 AS st, unnest(range(len(l))) AS n FROM (SELECT d, {drawn("pool", "neg:fill", "d", "greatest(0, n)")} AS l FROM fp)),
      al AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY st, n) AS r FROM (SELECT * FROM hd UNION ALL SELECT * FROM fl) QUALIFY r <= {n})"""  # noqa: E731
    return {
        "tool_frequency": f"WITH {base} SELECT tool, count(*) AS n_records FROM ut GROUP BY tool",
        "tool_cooccurrence": f"WITH {base} SELECT a.tool AS tool_a, b.tool AS tool_b, count(*) AS n_together FROM ut a JOIN ut b ON a.record_id = b.record_id AND a.tool <> b.tool GROUP BY ALL",
        "total_records": f"WITH {base} SELECT tool, count(*) AS n_records, (SELECT count(*) FROM trajectories) AS n_total FROM ut GROUP BY tool ORDER BY n_records DESC, tool LIMIT 5",
        "app_tool_sets": f"WITH {base} SELECT app, string_agg(tool, ',' ORDER BY tool) AS tools, count(*) AS n_tools FROM (SELECT DISTINCT app, tool FROM ut WHERE app IS NOT NULL) GROUP BY app",
        "dominant_app": f"WITH {base}, u AS (SELECT record_id, tool, min(k) AS k FROM st WHERE tool IS NOT NULL GROUP BY ALL), f AS (SELECT record_id, app_family, count(*) AS n, min(k) AS k FROM u JOIN tool_catalog ON tool_name = tool GROUP BY ALL) SELECT record_id, arg_min(app_family, (-n, k)) AS app_family FROM f GROUP BY record_id",
        "quality_gate": f"WITH {gate} SELECT record_id, drop_reason FROM q",
        "gate_counts": f"WITH {gate} SELECT coalesce(drop_reason, 'kept') AS drop_reason, count(*) AS n FROM q GROUP BY 1",
        "prev_tools_context": f"""WITH {ctx} SELECT record_id, CAST(k AS INTEGER) AS k, tool, coalesce(prev, '') AS previous_tools, CAST(k AS INTEGER) AS n_spans, coalesce(th0, '') AS last_thought, coalesce(act, '') AS last_action, left(coalesce(obs0, ''), 200) AS last_observation,
          CAST(coalesce(uniq, 0) AS INTEGER) AS unique_tools_so_far, round(coalesce(uniq, 0) / greatest(k, 1), 6) AS tool_diversity FROM ctx""",
        "history_summary": f"WITH {ctx} SELECT record_id, CAST(k AS INTEGER) AS k, coalesce(hist, '') AS history_summary FROM ctx",
        "span_expansion": f"WITH {ctx} SELECT ctx.record_id || '_span_' || k AS expanded_id, CAST(k AS INTEGER) AS span_index, CAST(len(spans) AS INTEGER) AS total_spans, CAST(k + 1 AS INTEGER) AS n_kept, tool, coalesce(prev, '') AS previous_tools, array_to_string(tools, ',') AS available_tools FROM ctx JOIN rec USING (record_id)",
        "catalog_merge": f"WITH {base}, f AS (SELECT tool, count(*) AS n FROM ut GROUP BY tool) SELECT tool, coalesce(nullif(description, ''), '') AS description, coalesce(n, 0) AS tool_frequency FROM cat FULL JOIN f USING (tool)",
        "tool_features": f"""WITH {base}, f AS (SELECT tool, count(*) AS n FROM ut GROUP BY tool) SELECT tool_name, CAST(length(tool_name) AS INTEGER) AS tool_name_length, coalesce(description, '') <> '' AS has_description, CAST(coalesce(len(parameters), 0) AS BIGINT) AS n_params, {', '.join(map(n_of, ('string', 'integer', 'number', 'boolean', 'array')))},
          CAST(len([p FOR p IN parameters IF len(p.enum) > 0]) AS BIGINT) AS n_enum_params, coalesce(len(parameters), 0) > 0 AS has_parameters, coalesce(n, 0) AS tool_frequency FROM tool_catalog LEFT JOIN f ON tool = tool_name""",
        "candidate_text": "SELECT tool_name, concat_ws(' | ', tool_name, nullif(description, ''), CASE WHEN len(parameters) > 0 THEN 'args: ' || array_to_string([p.name || ' (' || p.type || ')' || CASE WHEN coalesce(p.description, '') <> '' THEN ': ' || p.description ELSE '' END FOR p IN parameters], '; ') END) AS text FROM tool_catalog",
        "spec_coverage": f"WITH {base}, u AS (SELECT DISTINCT tool FROM ut) SELECT count(*) AS n_used, count(cat.tool) AS n_resolved, round(count(cat.tool) / count(*), 6) AS coverage FROM u LEFT JOIN cat USING (tool)",
        "missing_specs": f"WITH {base} SELECT ut.tool, count(*) AS n_records FROM ut LEFT JOIN cat USING (tool) WHERE cat.tool IS NULL GROUP BY ut.tool",
        "train_frequency_guard": f"WITH {base}, f AS (SELECT tool, count(*) AS n FROM ut WHERE {tr} GROUP BY tool) SELECT record_id, CAST(count(*) FILTER (WHERE n IS NULL) AS BIGINT) AS n_unseen, CAST(sum(coalesce(n, 0)) AS BIGINT) AS frequency FROM ut LEFT JOIN f USING (tool) WHERE split_name IN ('test', 'validation') GROUP BY record_id",
        "tool_app_match": f"WITH {base}, k AS (SELECT DISTINCT app, tool FROM ut WHERE {tr} AND app IS NOT NULL) SELECT st.record_id, CAST(st.k AS INTEGER) AS k, st.tool, CAST(k.tool IS NOT NULL AS INTEGER) AS tool_app_match FROM st JOIN rec USING (record_id) LEFT JOIN k ON k.app = rec.app AND k.tool = st.tool WHERE st.tool IS NOT NULL",
        "cooccurrence_score": f"WITH {base} SELECT a.record_id, CAST(a.k AS INTEGER) AS k, a.tool, round(sum(coalesce(n_together, 0)) / count(*), 6) AS tool_co_occurrence FROM st a JOIN st b ON a.record_id = b.record_id AND b.k < a.k AND b.tool IS NOT NULL LEFT JOIN co_occurrence c ON c.tool_a = a.tool AND c.tool_b = b.tool WHERE a.tool IS NOT NULL GROUP BY ALL",
        "random_negatives": f"WITH {base}, x AS (SELECT record_id AS id, tools AS ex FROM rec), {neg('3')} SELECT id AS record_id, array_to_string(negatives, ',') AS negatives FROM ng",
        "hard_negatives": f"WITH {hard(10, 4, 3, 3)} SELECT record_id, coalesce(string_agg(al.tool, ',' ORDER BY r), '') AS negatives FROM rec LEFT JOIN al ON d = record_id GROUP BY record_id",
        "mixed_negatives": f"""WITH {hard(3, 1, 1, 1)}, hl AS (SELECT record_id AS id, tools, list(al.tool ORDER BY r) FILTER (WHERE al.tool IS NOT NULL) AS h FROM rec LEFT JOIN al ON d = record_id GROUP BY ALL),
          x AS (SELECT id, coalesce(h, []) AS h, list_concat(tools, coalesce(h, [])) AS ex FROM hl), {neg('3', 'neg:mix')} SELECT id AS record_id, array_to_string(list_concat(h, negatives), ',') AS negatives FROM ng""",
        "pointwise_rows": f"WITH {base}, x AS (SELECT record_id AS id, tools AS ex FROM rec), {neg('3 * len(ex)')} SELECT record_id, tool AS tool_name, 1 AS label FROM ut UNION ALL SELECT id, unnest(negatives), 0 FROM ng",
        "per_decision_rows": f"""WITH {base}, x AS (SELECT record_id, k, tool, record_id || ':' || k AS id, list_append(coalesce(list(tool) FILTER (WHERE tool IS NOT NULL) OVER (PARTITION BY record_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []), tool) AS ex FROM st QUALIFY tool IS NOT NULL),
          {neg('3')} SELECT record_id, CAST(k AS INTEGER) AS k, tool AS tool_name, 1 AS label FROM x UNION ALL SELECT record_id, CAST(k AS INTEGER), unnest(negatives), 0 FROM ng""",
        "app_scoped_candidates": f"WITH {base}, ap AS (SELECT DISTINCT app, tool FROM ut WHERE {tr} AND app IS NOT NULL) SELECT record_id, ap.tool AS tool_name, CAST(list_contains(tools, ap.tool) AS INTEGER) AS label FROM rec JOIN ap USING (app)",
        "group_split": f"WITH {base}, g AS (SELECT DISTINCT task FROM rec WHERE task IS NOT NULL), r AS (SELECT task, row_number() OVER (ORDER BY md5('split:' || task), task) AS n, count(*) OVER () AS c FROM g) SELECT task, CASE WHEN n <= ceil(c * 0.2) THEN 'test' ELSE 'train' END AS part FROM r",
        "random_tasks": f"WITH {base}, g AS (SELECT DISTINCT task FROM rec WHERE task IS NOT NULL) SELECT task FROM g QUALIFY row_number() OVER (ORDER BY md5('subset:' || task), task) <= 100",
        "group_kfold": f"""WITH RECURSIVE {base}, sz AS (SELECT task, count(*) AS n FROM rec WHERE task IS NOT NULL GROUP BY task), al AS (SELECT CAST(sum(n) AS BIGINT) AS total FROM sz),
          big AS (SELECT task, n, row_number() OVER (ORDER BY n DESC, task) AS k FROM sz WHERE n > 0.001::DOUBLE * (SELECT total FROM al)),
          pl AS (SELECT 0::BIGINT AS k, NULL::VARCHAR AS task, -1::BIGINT AS fold, [0::BIGINT, 0, 0, 0, 0] AS l UNION ALL SELECT big.k, big.task, CAST(list_position(l, list_min(l)) - 1 AS BIGINT), [CASE WHEN i = list_position(l, list_min(l)) THEN l[i] + big.n ELSE l[i] END FOR i IN range(1, 6)] FROM pl JOIN big ON big.k = pl.k + 1),
          lk AS (SELECT [greatest(0.0::DOUBLE, total / 5.0::DOUBLE - z) FOR z IN l] AS r FROM (SELECT l FROM pl ORDER BY k DESC LIMIT 1), al), w AS (SELECT r, CASE WHEN r[1] + r[2] + r[3] + r[4] + r[5] > 0 THEN r[1] + r[2] + r[3] + r[4] + r[5] ELSE 1 END AS whole FROM lk),
          u AS (SELECT sz.task, CAST(('0x' || substr(md5('fold:' || task), 1, 12)) AS BIGINT) / 281474976710656.0::DOUBLE AS u FROM sz)
          SELECT u.task, CAST(coalesce(pl.fold, CASE WHEN u < r[1] / whole THEN 0 WHEN u < r[1] / whole + r[2] / whole THEN 1 WHEN u < r[1] / whole + r[2] / whole + r[3] / whole THEN 2 WHEN u < r[1] / whole + r[2] / whole + r[3] / whole + r[4] / whole THEN 3 ELSE 4 END) AS INTEGER) AS fold
          FROM u CROSS JOIN w LEFT JOIN pl ON pl.task = u.task""",
        "unseen_tasks": f"WITH {base}, k AS (SELECT DISTINCT tool FROM ut WHERE {tr}) SELECT record_id, count(*) AS n_tools, count(k.tool) AS n_known, count(k.tool) = 0 AS unseen FROM ut LEFT JOIN k USING (tool) WHERE split_name IN ('test', 'validation') GROUP BY record_id",
    }
