"""Queries over the span records: repeats, nested objects, hierarchies (problems 2, 4 and 7)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import canonical_id_sql
from ..operators import dedup, flatten, hierarchy
from ..storage import Scratch, new_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.surplus_deliveries(table(spark, sf_dir, "otel_spans"))


def p2_per_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per batch, the rows that came and those of them that are kept."""
    df = table(spark, sf_dir, "otel_spans")
    gone = dedup.surplus_deliveries(df).withColumn("gone", F.lit(1))
    rows = df.select("delivery_id", "batch_id").join(gone, "delivery_id", "left")
    return rows.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_rows"), F.sum(F.when(F.col("gone").isNull(), 1).otherwise(0)).cast("long").alias("n_kept"))


def _flat(spark: SparkSession, sf_dir: str, rules=flatten.RULES) -> dict[str, DataFrame]:
    return flatten.flat_tables(table(spark, sf_dir, "otel_spans"), new_path(spark, "nested"), rules)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of all rows of the flat tables."""
    tables = _flat(spark, sf_dir)
    keys = [t.select(F.col("row_id").alias("delivery_id"), "node_path") for t in tables.values()]
    return reduce(DataFrame.unionByName, keys)


def p4_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of messages; ``content`` where it is plain text."""
    plain = F.when(~F.col("content").rlike(r"^\s*[\[{]"), F.col("content"))
    return _flat(spark, sf_dir)["message"].select(F.col("row_id").alias("delivery_id"), "node_path", "place", "role", "tool_call_id", plain.alias("content"))


def p4_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of tool calls, each with its message's role."""
    tables = _flat(spark, sf_dir)
    parents = tables["message"].select("row_id", F.col("node_path").alias("parent_path"), "role")
    return tables["call"].join(parents, ["row_id", "parent_path"], "left").select(F.col("row_id").alias("delivery_id"), "node_path", "parent_path", "place", "role", "call_id", "name")


def p4_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat table of events."""
    return _flat(spark, sf_dir)["event"].select(F.col("row_id").alias("delivery_id"), "node_path", "place", "name", "time_unix_nano")


def p4_event_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events' attributes member by member, down to plain values, each with its parent row."""
    rows = _flat(spark, sf_dir, flatten.WITH_ATTRIBUTES)["attribute"]
    return rows.select(F.col("row_id").alias("delivery_id"), "node_path", "parent_path", "key", "value")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.hierarchies(table(spark, sf_dir, "otel_spans"), with_path=False).select("trace_id", "span_id", "root_span_id", "tree_depth")


def p7_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path and number of spans below, for every span that has a root."""
    trees = hierarchy.hierarchies(table(spark, sf_dir, "otel_spans"))
    return trees.filter("tree_depth >= 0").select("trace_id", "span_id", "path", (F.col("subtree_size") - 1).alias("n_below"))


def p7_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All spans below every span, with their distance."""
    trees = hierarchy.hierarchies(table(spark, sf_dir, "otel_spans"), with_path=False)
    return hierarchy.descendants(Scratch(spark, "trees").cut(trees, "trees"))


def queries() -> dict:
    return {f.__name__: f for f in (p2_found, p2_per_batch, p4_found, p4_messages, p4_calls, p4_events, p4_event_attributes, p7_found, p7_paths, p7_descendants)}


def oracle_sql() -> dict[str, str]:
    t, s, p = canonical_id_sql("trace_id", 16), canonical_id_sql("span_id", 8), canonical_id_sql("parent_span_id", 8)
    gone = f"""WITH k AS (SELECT delivery_id, batch_id, received_at, {t} AS t, {s} AS s FROM otel_spans),
      r AS (SELECT *, row_number() OVER (PARTITION BY t, s ORDER BY received_at, delivery_id) AS n FROM k)"""
    norm = lambda x: f"CASE WHEN json_type({x}) = 'VARCHAR' THEN CASE WHEN json_valid({x} ->> '$') THEN CAST({x} ->> '$' AS JSON) END ELSE {x} END"
    tried = [norm(f"json_extract(j, '{path}')") for path in ('$."gen_ai.input.messages"', '$."gen_ai"."input"."messages"', '$."gen_ai"."input.messages"', '$."gen_ai.input"."messages"')]
    usable = ", ".join(f"CASE json_type({x}) WHEN 'ARRAY' THEN {x} WHEN 'OBJECT' THEN json_array({x}) END" for x in tried)
    nodes = f"""WITH a AS (SELECT delivery_id, CASE WHEN json_valid(attributes) THEN CAST(attributes AS JSON) END AS j FROM otel_spans),
      m AS (SELECT delivery_id, coalesce({usable}) AS ms FROM a),
      mi AS (SELECT delivery_id, ms, unnest(range(CAST(json_array_length(ms) AS BIGINT))) AS i FROM m WHERE ms IS NOT NULL),
      msg AS (SELECT delivery_id, i, json_extract(ms, '$[' || i || ']') AS x FROM mi WHERE json_type(json_extract(ms, '$[' || i || ']')) = 'OBJECT'),
      f AS (SELECT delivery_id, i, x, field, json_extract(x, '$.' || field) AS l FROM msg, (VALUES ('tool_calls'), ('parts'), ('content')) v(field)),
      fj AS (SELECT *, unnest(range(CAST(json_array_length(l) AS BIGINT))) AS k FROM f WHERE json_type(l) = 'ARRAY'),
      c AS (SELECT *, json_extract(l, '$[' || k || ']') AS y FROM fj),
      calls AS (SELECT * FROM c WHERE json_type(y) = 'OBJECT' AND (field = 'tool_calls' OR y ->> '$.type' IN ('tool_call', 'function_call'))),
      e AS (SELECT delivery_id, events, unnest(range(len(events))) AS k FROM otel_spans WHERE len(events) > 0)"""
    graph = f"""d AS (SELECT t, s, arg_min(CASE WHEN p IS NULL OR regexp_full_match(p, '0+') THEN '' ELSE p END, (received_at, delivery_id)) AS p, arg_min(coalesce(start_time_unix_nano, 0), (received_at, delivery_id)) AS o
        FROM (SELECT {t} AS t, {s} AS s, {p} AS p, * FROM otel_spans) WHERE t IS NOT NULL AND s IS NOT NULL GROUP BY t, s),
      l AS (SELECT d.t, d.s, u.s AS p FROM d LEFT JOIN d u ON u.t = d.t AND u.s = d.p),
      w AS (SELECT t, s, s AS r, 0 AS n, s AS path FROM l WHERE p IS NULL UNION ALL SELECT l.t, l.s, w.r, w.n + 1, w.path || '/' || l.s FROM w JOIN l ON l.t = w.t AND l.p = w.s)"""
    return {
        "p2_found": f"{gone} SELECT delivery_id FROM r WHERE n > 1 AND t IS NOT NULL AND s IS NOT NULL",
        "p2_per_batch": f"{gone} SELECT batch_id, count(*) AS n_rows, CAST(count(*) FILTER (WHERE n = 1 OR t IS NULL OR s IS NULL) AS BIGINT) AS n_kept FROM r GROUP BY batch_id",
        "p4_found": f"""{nodes} SELECT delivery_id, 'messages.' || i AS node_path FROM msg UNION ALL SELECT delivery_id, 'messages.' || i || '.' || field || '.' || k FROM calls
          UNION ALL SELECT delivery_id, 'events.' || k FROM e WHERE CASE WHEN json_valid(events[k + 1]) THEN json_type(CAST(events[k + 1] AS JSON)) = 'OBJECT' ELSE false END""",
        "p4_calls": f"""{nodes} SELECT delivery_id, 'messages.' || i || '.' || field || '.' || k AS node_path, 'messages.' || i AS parent_path, CAST(k AS INTEGER) AS place, x ->> '$.role' AS "role", y ->> '$.id' AS call_id,
          CASE WHEN json_type(y -> '$.function') = 'OBJECT' THEN y ->> '$.function.name' ELSE y ->> '$.name' END AS name FROM calls""",
        "p4_messages": f"""{nodes} SELECT delivery_id, 'messages.' || i AS node_path, CAST(i AS INTEGER) AS place, x ->> '$.role' AS "role", x ->> '$.tool_call_id' AS tool_call_id,
          CASE WHEN json_type(x -> '$.content') = 'VARCHAR' AND NOT regexp_matches(x ->> '$.content', '^\\s*[\\[{{]') THEN x ->> '$.content' END AS content FROM msg""",
        "p4_events": f"""{nodes}, ej AS (SELECT delivery_id, k, CASE WHEN json_valid(events[k + 1]) THEN CAST(events[k + 1] AS JSON) END AS x FROM e)
          SELECT delivery_id, 'events.' || k AS node_path, CAST(k AS INTEGER) AS place, x ->> '$.name' AS name, x ->> '$.time_unix_nano' AS time_unix_nano FROM ej WHERE json_type(x) = 'OBJECT'""",
        "p4_event_attributes": f"""WITH RECURSIVE e AS (SELECT delivery_id, events, unnest(range(len(events))) AS k FROM otel_spans WHERE len(events) > 0), ej AS (SELECT delivery_id, 'events.' || k AS path, CASE WHEN json_valid(events[k + 1]) THEN CAST(events[k + 1] AS JSON) END AS x FROM e),
          t AS (SELECT delivery_id, path AS parent_path, path || '.attributes' AS prefix, x -> '$.attributes' AS v FROM ej WHERE json_type(x) = 'OBJECT'),
          m AS (SELECT delivery_id, parent_path, prefix, unnest(json_keys(v)) AS key, v FROM t WHERE json_type(v) = 'OBJECT'
            UNION ALL SELECT delivery_id, parent_path, prefix, CAST(unnest(range(CAST(json_array_length(v) AS BIGINT))) AS VARCHAR), v FROM t WHERE json_type(v) = 'ARRAY'),
          r AS (SELECT delivery_id, parent_path, prefix || '.' || key AS node_path, key, CASE json_type(v) WHEN 'OBJECT' THEN json_extract(v, '$."' || key || '"') ELSE json_extract(v, '$[' || key || ']') END AS v FROM m
            UNION ALL SELECT delivery_id, node_path, node_path || '.' || k, k, CASE json_type(v) WHEN 'OBJECT' THEN json_extract(v, '$."' || k || '"') ELSE json_extract(v, '$[' || k || ']') END
            FROM (SELECT r.*, unnest(CASE json_type(v) WHEN 'OBJECT' THEN json_keys(v) ELSE [CAST(z AS VARCHAR) FOR z IN range(CAST(json_array_length(v) AS BIGINT))] END) AS k FROM r WHERE json_type(v) IN ('OBJECT', 'ARRAY')))
          SELECT delivery_id, node_path, parent_path, key, CASE WHEN json_type(v) NOT IN ('OBJECT', 'ARRAY') THEN v ->> '$' END AS value FROM r""",
        "p7_found": f"WITH RECURSIVE {graph} SELECT l.t AS trace_id, l.s AS span_id, coalesce(w.r, '') AS root_span_id, CAST(coalesce(w.n, -1) AS INTEGER) AS tree_depth FROM l LEFT JOIN w ON w.t = l.t AND w.s = l.s",
        "p7_paths": f"""WITH RECURSIVE {graph}, b AS (SELECT t, a, count(*) AS n FROM (SELECT t, unnest(string_split(path, '/')) AS a FROM w) GROUP BY t, a)
          SELECT w.t AS trace_id, w.s AS span_id, path, b.n - 1 AS n_below FROM w JOIN b ON b.t = w.t AND b.a = w.s""",
        "p7_descendants": f"WITH RECURSIVE {graph}, a AS (SELECT t, s, n, unnest(string_split(path, '/')) AS a, unnest(range(n + 1)) AS k FROM w) SELECT t AS trace_id, a AS ancestor_span_id, s AS span_id, CAST(n - k AS INTEGER) AS distance FROM a WHERE k < n",
    }
