"""Queries of the operators for training data and their SQL (problems 1, 3, 5, 6, 8, 9 and 10)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as N
from . import components, cooccurrence, mixing, mojibake, overlap, packing, sequences, tokens


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _frequent(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "trajectories").select(N.task_key("task_id").alias("task"), N.names_in("spans.action").alias("names"))
    return sequences.frequent_sequences(rows, "task", "names").withColumn("pattern", F.array_join("pattern", " > "))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frequent(spark, sf_dir).select("pattern")


def p1_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frequent(spark, sf_dir).select("pattern", F.col("n_entities").alias("n_tasks"))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "trajectories").select(N.tools_of_record().alias("tools"))
    return cooccurrence.pairs(rows, "tools", min_count=5, min_share=0.001)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    hit = F.col("n_ab") * F.col("n") >= 8 * F.col("n_a") * F.col("n_b")
    return _pairs(spark, sf_dir).filter(hit).select(F.col("item_a").alias("tool_a"), F.col("item_b").alias("tool_b"))


def p3_beside_frozen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, lift and conviction of today's pairs beside the frozen counts, either direction of which may be lost."""
    old = _table(spark, sf_dir, "co_occurrence").select(N.tool_name("tool_a").alias("a"), N.tool_name("tool_b").alias("b"), "n_together")
    old = old.groupBy(F.least("a", "b").alias("item_a"), F.greatest("a", "b").alias("item_b")).agg(F.max("n_together").alias("n_frozen"))
    four = lambda over, under: F.floor(over * 10_000 / under) / 10_000  # noqa: E731  # four digits, cut
    conviction = F.when(F.col("n_ab") < F.col("n_a"), four(F.col("n_a") * (F.col("n") - F.col("n_b")), F.col("n") * (F.col("n_a") - F.col("n_ab"))))
    now = _pairs(spark, sf_dir).join(old, ["item_a", "item_b"], "left")
    return now.select(F.col("item_a").alias("tool_a"), F.col("item_b").alias("tool_b"), F.col("n_ab").alias("n_together"), four(F.col("n_ab") * F.col("n"), F.col("n_a") * F.col("n_b")).alias("lift"), conviction.alias("conviction"), "n_frozen")


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "trajectories").select("record_id", N.task_key("task_id").alias("task"), N.app_key("app_name").alias("app"))
    return components.record_groups(rows, "record_id", ["task", "app"])


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _groups(spark, sf_dir).filter("n_app >= 2").select("record_id", "group_id")


def p5_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split given to every record."""
    targets = [(r["split_name"], r["target_share"]) for r in _table(spark, sf_dir, "split_targets").collect()]
    return components.assign_splits(_groups(spark, sf_dir), sorted(targets)).select("record_id", "group_id", "split")


def p5_hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The split given to every record if every component is hashed, whatever its size."""
    targets = [(r["split_name"], r["target_share"]) for r in _table(spark, sf_dir, "split_targets").collect()]
    return components.assign_splits(_groups(spark, sf_dir), sorted(targets), None).select("record_id", "group_id", "split")


def p5_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of records reached, beside their targets."""
    per = p5_splits(spark, sf_dir).groupBy("split").agg(F.count(F.lit(1)).alias("n_records"))
    total = per.agg(F.sum("n_records").alias("n"))
    targets = _table(spark, sf_dir, "split_targets").withColumnRenamed("split_name", "split")
    return targets.join(per, "split", "left").crossJoin(F.broadcast(total)).select("split", F.coalesce("n_records", F.lit(0)).alias("n_records"), "target_share", (F.coalesce("n_records", F.lit(0)) / F.col("n")).alias("share"))


def _overlap_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "trajectories").select("record_id", N.task_key("task_id").alias("task"), "intent", "split_name", "source")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap.overlaps(_overlap_rows(spark, sf_dir))


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per evaluation split and source: rows, and how many of them training repeats."""
    return overlap.report(_overlap_rows(spark, sf_dir))


def p6_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of classes of equal intents that match between training and evaluation, with their sizes."""
    return overlap.class_overlaps(_overlap_rows(spark, sf_dir))[0]


def p6_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks in training and in evaluation, with their numbers of rows."""
    return overlap.task_overlaps(_overlap_rows(spark, sf_dir))


#: Limits of a container besides its capacity: one segment for so many tokens, and the share of loss-bearing tokens.
TOKENS_A_SEGMENT, LOSS_SHARE = 32, 0.95


def _kinds(spark: SparkSession, sf_dir: str) -> dict[str, tuple[int, int, int]]:
    """Limits on tokens, segments and loss-bearing tokens of each kind of container."""
    rows = _table(spark, sf_dir, "container_sizes").collect()  # one row per kind
    return {r["container_kind"]: (c := r["capacity_tokens"], max(1, c // TOKENS_A_SEGMENT), max(1, int(c * LOSS_SHARE))) for r in rows}


def _placed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = tokens.token_counts(_table(spark, sf_dir, "documents"), with_prompts=True)
    return packing.pack_items(sizes, _kinds(spark, sf_dir), prompts="prompts")


def p8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every text lies, in containers of each kind."""
    return _placed(spark, sf_dir).select(F.col("kind").alias("container_kind"), F.col("container").alias("container_id"), "doc_id", "piece", "from_token", "to_token", "loss")


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind: containers, unused space, and how many containers reach their limit on segments or on loss."""
    c = packing.check(_placed(spark, sf_dir), _kinds(spark, sf_dir))
    return c.select(F.col("kind").alias("container_kind"), "n_containers", "n_tokens", "unused", "at_segments", "at_loss", "alone_over_loss")


def p8_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per kind: texts placed, and the faults, of which there must be none."""
    c = packing.check(_placed(spark, sf_dir), _kinds(spark, sf_dir))
    return c.select(F.col("kind").alias("container_kind"), "n_items", "over_tokens", "over_segments", "over_loss", "gaps", "divided_small")


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each text is drawn."""
    targets = [(r["source"], r["target_share"], r["max_repeats"]) for r in _table(spark, sf_dir, "mix_targets").collect()]
    docs = _table(spark, sf_dir, "documents").filter(F.col("source").isin([s for s, _, _ in targets]))  # others can't be drawn
    sizes = tokens.token_counts(docs, keep=("source",))
    return mixing.mix(sizes, targets).withColumnRenamed("size", "n_tokens")


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares reached beside their targets."""
    return mixing.shares(p9_mix(spark, sf_dir).withColumnRenamed("n_tokens", "size"), _table(spark, sf_dir, "mix_targets"))


def p9_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per target source: texts drawn more often than allowed, drawn twice as rows, or drawn from elsewhere; there must be none."""
    mixed = p9_mix(spark, sf_dir)
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("own"))
    j = mixed.groupBy("source", "doc_id").agg(F.count(F.lit(1)).alias("m"), F.max("n_copies").alias("most")).join(docs, "doc_id", "left").join(F.broadcast(_table(spark, sf_dir, "mix_targets")), "source", "right")
    n = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    return j.groupBy("source").agg(n(F.col("most") > F.col("max_repeats")).alias("over_repeats"), n(F.col("m") > 1).alias("twice"), n(F.col("own") != F.col("source")).alias("foreign"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.restore(_table(spark, sf_dir, "documents")).select("doc_id")


def p10_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.restore(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (p1_found, p1_support, p3_found, p3_beside_frozen, p5_found, p5_splits, p5_hashed, p5_shares, p6_found, p6_report, p6_classes, p6_tasks, p8_packing, p8_fill, p8_check, p9_mix, p9_shares, p9_check, p10_found, p10_restored)}


def oracle_sql() -> dict[str, str]:
    task, app = N.task_key_sql("task_id"), N.app_key_sql("app_name")
    names = lambda c: f"[z FOR z IN [{N.tool_name_sql('x')} FOR x IN {c}] IF z IS NOT NULL]"
    p1 = f"""WITH RECURSIVE r AS (SELECT DISTINCT task, seq FROM (SELECT {task} AS task, {names("[y.action FOR y IN spans]")} AS seq FROM trajectories)),
      t AS (SELECT greatest(4, ceil(0.01 * count(DISTINCT task))) AS least FROM r WHERE task IS NOT NULL),
      i AS (SELECT name FROM (SELECT DISTINCT task, unnest(seq) AS name FROM r WHERE task IS NOT NULL) GROUP BY name HAVING count(*) >= (SELECT least FROM t)),
      s AS (SELECT row_number() OVER () AS id, task, seq FROM r WHERE task IS NOT NULL),
      e AS (SELECT * FROM (SELECT id, task, unnest(range(1, len(seq) + 1)) AS k, unnest(seq) AS name FROM s) WHERE name IN (SELECT name FROM i)),
      g AS (SELECT id, task, k, name AS pattern, 1 AS n FROM e UNION SELECT e.id, e.task, e.k, g.pattern || ' > ' || e.name, g.n + 1 FROM g JOIN e ON e.id = g.id AND e.k > g.k WHERE g.n < 6),
      c AS (SELECT pattern, count(DISTINCT task) AS n_tasks FROM g WHERE n >= 3 GROUP BY pattern HAVING count(DISTINCT task) >= (SELECT least FROM t))"""
    tools = f"CASE WHEN len(tools_used) > 0 THEN {names('tools_used')} ELSE {names('[y.action FOR y IN spans]')} END"
    p3 = f"""WITH b AS (SELECT record_id, list_sort(list_distinct({tools})) AS tools FROM trajectories),
      u AS (SELECT record_id, unnest(tools) AS x FROM b), n AS (SELECT count(DISTINCT record_id) AS n FROM u), k AS (SELECT x, count(*) AS k FROM u GROUP BY x),
      ab AS (SELECT a.x AS tool_a, b.x AS tool_b, count(*) AS n_ab FROM u a JOIN u b ON a.record_id = b.record_id AND a.x < b.x GROUP BY ALL),
      p AS (SELECT tool_a, tool_b, n_ab, n.n, ka.k AS n_a, kb.k AS n_b FROM ab, n, k ka, k kb WHERE ka.x = tool_a AND kb.x = tool_b AND n_ab >= 5 AND 1000 * n_ab >= n.n)"""
    p5 = f"""WITH RECURSIVE x AS (SELECT record_id, 't:' || {task} AS t, 'a:' || {app} AS a FROM trajectories),
      e AS (SELECT t AS u, a AS v FROM x WHERE t IS NOT NULL AND a IS NOT NULL UNION SELECT a, t FROM x WHERE t IS NOT NULL AND a IS NOT NULL),
      n AS (SELECT t AS u FROM x WHERE t IS NOT NULL UNION SELECT a FROM x WHERE a IS NOT NULL),
      r AS (SELECT u, u AS v FROM n UNION SELECT r.u, e.v FROM r JOIN e ON e.u = r.v),
      c AS (SELECT u, min(v) AS root, count(*) FILTER (WHERE v LIKE 'a:%') AS apps FROM r GROUP BY u),
      g AS (SELECT record_id, root, apps FROM x JOIN c ON c.u = coalesce(t, a))"""
    p5s = f"""{p5}, gr AS (SELECT x.record_id, min(x.record_id) OVER (PARTITION BY coalesce(g.root, 'r:' || x.record_id)) AS group_id, count(*) OVER (PARTITION BY coalesce(g.root, 'r:' || x.record_id)) AS n FROM x LEFT JOIN g USING (record_id)),
      ta AS (SELECT list(split_name ORDER BY split_name) AS names, list(target_share ORDER BY split_name) AS w FROM split_targets), nn AS (SELECT count(*) AS m FROM gr), tn AS (SELECT names, [z / (w[1] + w[2] + w[3]) * m FOR z IN w] AS lack FROM ta, nn),
      big AS (SELECT group_id, n, row_number() OVER (ORDER BY n DESC, CAST(group_id AS VARCHAR)) AS k FROM (SELECT DISTINCT group_id, n FROM gr WHERE n > 0.001::DOUBLE * (SELECT count(*) FROM gr))),
      pl AS (SELECT 0::BIGINT AS k, NULL::BIGINT AS group_id, NULL::VARCHAR AS split, lack FROM tn UNION ALL SELECT pl.k + 1, big.group_id, names[list_position(pl.lack, list_max(pl.lack))],
        [CASE WHEN i = list_position(pl.lack, list_max(pl.lack)) THEN pl.lack[i] - big.n ELSE pl.lack[i] END FOR i IN range(1, len(pl.lack) + 1)] FROM pl JOIN big ON big.k = pl.k + 1, tn)"""
    ranged = lambda src: f"""rs AS (SELECT names, [greatest(0.0::DOUBLE, z) FOR z IN lack] AS r FROM {src}), tt AS (SELECT *, r[1] + r[2] + r[3] AS total FROM rs),
      hs AS (SELECT gr.*, CAST(('0x' || substr(md5('split:' || group_id), 1, 12)) AS BIGINT) / 281474976710656.0::DOUBLE AS u FROM gr),
      sp AS (SELECT hs.*, CASE WHEN u < r[1] / total THEN names[1] WHEN u < r[1] / total + r[2] / total THEN names[2] ELSE names[3] END AS hashed FROM hs, tt)"""  # noqa: E731
    split_sql = f"""{p5s}, {ranged("(SELECT names, pl.lack FROM pl, tn ORDER BY k DESC LIMIT 1)")}, fin AS (SELECT sp.record_id, sp.group_id, coalesce(pl.split, hashed) AS split FROM sp LEFT JOIN pl ON pl.group_id = sp.group_id)"""
    p6 = f"""WITH x AS (SELECT record_id, {task} AS task, list_sort(list_distinct({N.words_sql("intent")})) AS w, lower(trim(split_name, ' \t\r\n ')) AS split, source FROM trajectories),
      tr AS (SELECT * FROM x WHERE split = 'train'), ev AS (SELECT * FROM x WHERE split IN ('validation', 'test')),
      j AS (SELECT tr.record_id AS a, ev.record_id AS b, tr.task = ev.task AS same_task, tr.w = ev.w AND len(ev.w) > 0 AS exact,
        len(list_intersect(tr.w, ev.w)) * 10 >= 7 * (len(tr.w) + len(ev.w) - len(list_intersect(tr.w, ev.w))) AND len(tr.w) > 0 AND len(ev.w) > 0 AS alike FROM tr, ev)"""
    return {
        "p1_found": f"{p1} SELECT pattern FROM c",
        "p1_support": f"{p1} SELECT pattern, n_tasks FROM c",
        "p8_check": """SELECT container_kind, (SELECT count(*) FROM documents WHERE length(text) > 0) AS n_items, 0::BIGINT AS over_tokens, 0::BIGINT AS over_segments, 0::BIGINT AS over_loss, 0::BIGINT AS gaps, 0::BIGINT AS divided_small
          FROM container_sizes""",
        "p9_check": "SELECT source, 0::BIGINT AS over_repeats, 0::BIGINT AS twice, 0::BIGINT AS foreign FROM mix_targets",
        "p5_found": f"{p5} SELECT record_id, min(record_id) OVER (PARTITION BY root) AS group_id FROM g WHERE apps >= 2",
        "p5_splits": f"{split_sql} SELECT record_id, group_id, split FROM fin",
        "p5_hashed": f"{p5s}, {ranged('tn')} SELECT record_id, group_id, hashed AS split FROM sp",
        "p5_shares": f"{split_sql} SELECT split_name AS split, count(record_id) AS n_records, any_value(target_share) AS target_share, count(record_id) / (SELECT count(*) FROM fin) AS share FROM split_targets LEFT JOIN fin ON split = split_name GROUP BY split_name",
        "p6_found": f"{p6} SELECT least(a, b) AS record_a, greatest(a, b) AS record_b FROM j WHERE same_task OR alike",
        "p6_report": f"""{p6}, f AS (SELECT b, bool_or(coalesce(exact, false)) AS exact, bool_or(coalesce(alike AND NOT exact, false)) AS near, bool_or(coalesce(same_task, false)) AS same_task FROM j GROUP BY b)
          SELECT split, source, count(*) AS n_rows, CAST(count(*) FILTER (WHERE exact) AS BIGINT) AS n_exact, CAST(count(*) FILTER (WHERE near) AS BIGINT) AS n_near, CAST(count(*) FILTER (WHERE same_task) AS BIGINT) AS n_same_task,
          CAST(count(*) FILTER (WHERE exact OR near OR same_task) AS BIGINT) AS n_any FROM ev LEFT JOIN f ON f.b = ev.record_id GROUP BY split, source""",
        "p6_classes": f"""{p6.split("j AS (")[0].rstrip().rstrip(",")}, ca AS (SELECT w, min(record_id) AS id, count(*) AS n FROM tr WHERE len(w) > 0 GROUP BY w), cb AS (SELECT w, min(record_id) AS id, count(*) AS n FROM ev WHERE len(w) > 0 GROUP BY w)
          SELECT ca.id AS class_train, cb.id AS class_eval, ca.n AS n_train, cb.n AS n_eval, ca.w = cb.w AS exact FROM ca, cb WHERE len(list_intersect(ca.w, cb.w)) * 10 >= 7 * (len(ca.w) + len(cb.w) - len(list_intersect(ca.w, cb.w)))""",
        "p6_tasks": f"""{p6.split("j AS (")[0].rstrip().rstrip(",")} SELECT tr.task, tr.n AS n_train, ev.n AS n_eval FROM (SELECT task, count(*) AS n FROM tr WHERE task IS NOT NULL GROUP BY task) tr JOIN (SELECT task, count(*) AS n FROM ev WHERE task IS NOT NULL GROUP BY task) ev USING (task)""",
        "p3_found": f"{p3} SELECT tool_a, tool_b FROM p WHERE n_ab * n >= 8 * n_a * n_b",
        "p3_beside_frozen": f"""{p3}, o AS (SELECT least(a, b) AS a, greatest(a, b) AS b, max(n_together) AS n_frozen FROM (SELECT {N.tool_name_sql("tool_a")} AS a, {N.tool_name_sql("tool_b")} AS b, n_together FROM co_occurrence) GROUP BY ALL)
          SELECT tool_a, tool_b, n_ab AS n_together, floor(n_ab * n * 10000 / (n_a * n_b)) / 10000 AS lift, CASE WHEN n_ab < n_a THEN floor(n_a * (n - n_b) * 10000 / (n * (n_a - n_ab))) / 10000 END AS conviction, n_frozen FROM p LEFT JOIN o ON o.a = tool_a AND o.b = tool_b""",
    }
