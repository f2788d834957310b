"""Queries that rank candidates and evaluate the rankings.

``scored`` gives each candidate a score from its training frequency and a hash, so that every figure can be held
against SQL. Records are the tasks, as each is ranked for itself.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names as N
from ..operators import corpus, ranking
from ..storage import Scratch
from .corpus import records_sql
from .records import table

METRICS = ["r_precision", "mrr", *[f"recall_{k}" for k in ranking.KS], *[f"ndcg_{k}" for k in ranking.KS]]


def _recs(spark, sf_dir):
    return corpus.records(table(spark, sf_dir, "trajectories"))


def _u(text):
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0


def scored(spark, sf_dir):
    """Candidates of each record's app with label, score and popularity."""
    recs = Scratch(spark, "recs").cut(_recs(spark, sf_dir).select("record_id", "app", "tools", "split_name"), "recs")
    train = recs.filter("split_name = 'train'")
    freq = corpus.tool_frequency(train)
    top = freq.agg(F.max("n_records").alias("most"))
    pop = freq.crossJoin(F.broadcast(top)).select(F.col("tool").alias("tool_name"), (F.col("n_records") / F.col("most")).alias("popularity"))
    pool = corpus.app_tools(train).select("app", F.explode("tools").alias("tool_name")).join(pop, "tool_name").groupBy("app").agg(F.collect_list(F.struct("tool_name", "popularity")).alias("pool"))
    c = recs.join(pool, "app").select(F.col("record_id").alias("task_id"), "tools", F.explode("pool").alias("c")).select("task_id", "c.*", F.array_contains("tools", F.col("c.tool_name")).cast("int").alias("label"))
    scores = c.withColumn("score", _u(F.concat(F.col("task_id").cast("string"), F.lit(":"), "tool_name")) * 0.5 + F.col("popularity") * 0.25 + F.col("label") * 0.25)
    return Scratch(spark, "scored").cut(scores.select("task_id", "tool_name", "label", "popularity", "score"), "scored")  # read many times


def topk_per_task(spark, sf_dir):
    """TK1, TK2, WN12: shortlists of seven."""
    return ranking.top_k(scored(spark, sf_dir)).select("task_id", "tool_name", "rank")


def _round(df, columns, n=6):
    return df.select(*[F.round(c, n).alias(c) if c in columns else c for c in df.columns])


def task_metrics(spark, sf_dir):
    """MT1-MT5: every task's metrics."""
    return _round(ranking.task_metrics(scored(spark, sf_dir)), METRICS)


def macro_metrics(spark, sf_dir):
    """AG13, MT6: means over tasks."""
    return _round(ranking.macro(ranking.task_metrics(scored(spark, sf_dir)), METRICS), METRICS)


def metrics_by_app(spark, sf_dir):
    """AG25: means by app."""
    m = ranking.task_metrics(scored(spark, sf_dir)).join(_recs(spark, sf_dir).select(F.col("record_id").alias("task_id"), "app"), "task_id")
    return _round(ranking.macro(m, ["r_precision", "recall_3"], ["app"]), ["r_precision", "recall_3"])


def score_table(spark, sf_dir):
    """D14, AG23, AG30: the long table's means by method and metric, for the scores and the popularity baseline (BL2)."""
    s = scored(spark, sf_dir)
    cols = ["r_precision", "recall_3", "mrr"]
    a = ranking.long_scores(ranking.task_metrics(s), cols, "app", "score")
    b = ranking.long_scores(ranking.task_metrics(s, score="popularity"), cols, "app", "popularity")
    return a.unionByName(b).groupBy("pool", "method", "metric").agg(F.count(F.lit(1)).alias("n_tasks"), F.round(F.avg("value"), 6).alias("value"))


def confusion_metrics(spark, sf_dir):
    """AG14."""
    return _round(ranking.confusion(scored(spark, sf_dir)), ["accuracy", "precision", "recall", "f1"])


def roc_auc(spark, sf_dir):
    """AG15."""
    return _round(ranking.roc_auc(scored(spark, sf_dir)), ["roc_auc"])


def reliability_bins(spark, sf_dir):
    """AG16."""
    return _round(ranking.reliability(scored(spark, sf_dir)), ["confidence", "accuracy"])


def ece(spark, sf_dir):
    """AG17."""
    return _round(ranking.ece(ranking.reliability(scored(spark, sf_dir))), ["ece"])


def shortlist_confidence(spark, sf_dir):
    """TK3, TK4, MT9: top-one hit and whole-shortlist correctness of every task."""
    s = scored(spark, sf_dir)
    full = ranking.full_shortlists(s).select("task_id", F.col("correct").alias("all_correct"), F.round("confidence", 9).alias("top_r_score"))
    return ranking.confidences(s).select("task_id", "correct", F.round("confidence", 9).alias("confidence")).join(full, "task_id", "left")


_TAUS = [i / 20 for i in range(21)]


def _curve(spark, sf_dir):
    return ranking.risk_curve(ranking.confidences(scored(spark, sf_dir)), _TAUS)


def hybrid_curve(spark, sf_dir):
    """JN21, AG18, AG19."""
    return _round(_curve(spark, sf_dir), ["coverage", "risk", "hybrid_risk", "cost", "latency"])


def coverage_at_risk(spark, sf_dir):
    """AG20."""
    return _round(ranking.coverage_at_risk(_curve(spark, sf_dir), [0.0, 0.1, 0.25, 0.5]), ["coverage"])


def risk_area(spark, sf_dir):
    """AG21."""
    return _round(ranking.curve_area(_curve(spark, sf_dir)), ["aurc"])


def quantile_thresholds(spark, sf_dir):
    """SP14: interior deciles of the confidences."""
    c = ranking.confidences(scored(spark, sf_dir))
    q = c.agg(F.percentile("confidence", F.array(*[F.lit(i / 10) for i in range(1, 10)])).alias("q"))
    return q.select(F.posexplode("q").alias("i", "tau")).select("i", F.round("tau", 9).alias("tau"))


def bootstrap_ci(spark, sf_dir):
    """SP10: interval of mean R-precision."""
    b = ranking.bootstrap(ranking.task_metrics(scored(spark, sf_dir)), "r_precision")
    return _round(b.drop("p_value"), ["mean", "lower", "upper"])


def paired_holm(spark, sf_dir):
    """SP11, SP12, JN18, WN15: scores against popularity by app, with Holm's correction."""
    s = scored(spark, sf_dir)
    app = _recs(spark, sf_dir).select(F.col("record_id").alias("task_id"), "app")
    a = ranking.task_metrics(s).join(app, "task_id")
    t = ranking.paired_bootstrap(a, ranking.task_metrics(s, score="popularity"), "mrr", by=["app"])
    return _round(ranking.holm(t, name="app"), ["mean", "lower", "upper", "p_value"])


def random_baseline(spark, sf_dir):
    """BL1: means over tasks of a uniformly random ranking."""
    rows = ranking.random_scores(scored(spark, sf_dir).drop("score"))
    return _round(ranking.macro(ranking.task_metrics(rows), METRICS), METRICS)


def listed_metrics(spark, sf_dir):
    """MT8, JN19, AG30: metrics of ranked lists, as a model's replies give them, against the tools of the task."""
    top = ranking.top_k(scored(spark, sf_dir)).groupBy("task_id").agg(F.array_sort(F.collect_list(F.struct("rank", "tool_name"))).alias("x"))
    lists = top.select("task_id", F.transform("x", lambda x: x["tool_name"]).alias("ranked"))
    names = ["r_precision", "mrr", *[f"recall_{k}" for k in ranking.KS]]
    relevant = _recs(spark, sf_dir).select(F.col("record_id").alias("task_id"), F.col("tools").alias("relevant"))
    return _round(ranking.list_metrics(lists, relevant), names)


def repeat_prev(spark, sf_dir):
    """BL5, WN14: how often a step repeats the tool before it."""
    c = corpus.contexts(_recs(spark, sf_dir))
    return c.groupBy("app").agg(F.count(F.lit(1)).alias("n_steps"), F.sum((F.col("last_action") == F.col("tool")).cast("long")).alias("n_repeats"))


def depth_buckets(spark, sf_dir):
    """AG26: share of repeated tools by depth."""
    k = F.col("k")
    bucket = F.when(k == 0, "0").when(k <= 2, "1-2").when(k <= 9, "3-9").otherwise("10+")
    c = corpus.contexts(_recs(spark, sf_dir))
    return c.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n_steps"), F.round(F.avg(F.array_contains("used", F.col("tool")).cast("double")), 4).alias("share"))


def tfidf_cosine(spark, sf_dir):
    """BL3, PRJ25: the best tool for each intent by TF-IDF."""
    norm = lambda c: F.trim(F.replace(F.replace(F.lower(c), F.lit("__"), F.lit(" ")), F.lit("_"), F.lit(" ")))
    docs = table(spark, sf_dir, "tool_catalog").select("tool_name", norm(F.concat_ws(" ", "tool_name", "description")).alias("text"))
    vectors, idf = ranking.tfidf(docs, "tool_name", "text")
    q = ranking.tfidf_queries(table(spark, sf_dir, "trajectories").select("record_id", norm(F.col("intent")).alias("text")), "record_id", "text", idf)
    s = ranking.cosine(q, vectors, "record_id", "tool_name").withColumn("score", F.round("score", 6))
    return s.groupBy("record_id").agg(F.max_by("tool_name", F.struct("score", F.col("tool_name"))).alias("tool_name"), F.max("score").alias("score"))


def dense_cosine(spark, sf_dir):
    """BL4: the five nearest vectors of every hundredth vector."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", ranking.unit("embedding").alias("v"))
    q = v.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("task_id"), F.col("v").alias("q"))
    s = q.crossJoin(v).filter("vec_id <> task_id").select("task_id", F.col("vec_id").alias("tool_name"), F.round(ranking.dot("q", "v"), 6).alias("score"))
    return ranking.top_k(s, 5).select(F.col("task_id").alias("query_id"), F.col("tool_name").alias("vec_id"), "rank", "score")


QUERIES = (topk_per_task, task_metrics, macro_metrics, metrics_by_app, score_table, confusion_metrics, roc_auc, reliability_bins, ece, shortlist_confidence, hybrid_curve, coverage_at_risk, risk_area, quantile_thresholds, bootstrap_ci, paired_holm, random_baseline, listed_metrics, repeat_prev, depth_buckets, tfidf_cosine, dense_cosine)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    hexa = lambda t: f"CAST(('0x' || substr(md5({t}), 1, 8)) AS UBIGINT)::DOUBLE / 4294967296.0"
    base = records_sql() + f""", fr AS (SELECT tool, count(*) AS n FROM ut WHERE split_name = 'train' GROUP BY tool), po AS (SELECT DISTINCT app, tool FROM ut WHERE split_name = 'train' AND app IS NOT NULL),
      sc AS (SELECT *, {hexa("task_id || ':' || tool_name")} * 0.5 + popularity * 0.25 + label * 0.25 AS score FROM
        (SELECT record_id AS task_id, po.tool AS tool_name, fr.n / (SELECT max(n) FROM fr) AS popularity, CAST(list_contains(tools, po.tool) AS INTEGER) AS label FROM rec JOIN po USING (app) JOIN fr ON fr.tool = po.tool)),
      rk AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY score DESC, tool_name) AS rank, sum(label) OVER (PARTITION BY task_id) AS r FROM sc),
      rp AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY popularity DESC, tool_name) AS rank, sum(label) OVER (PARTITION BY task_id) AS r FROM sc)"""
    metric = lambda rk: f"""SELECT task_id, CAST(max(r) AS BIGINT) AS n_relevant, sum(CASE WHEN label = 1 AND rank <= r THEN 1 ELSE 0 END) / max(r) AS r_precision, 1 / min(CASE WHEN label = 1 THEN rank END) AS mrr, """ + ", ".join(
        [f"sum(CASE WHEN label = 1 AND rank <= {k} THEN 1 ELSE 0 END) / max(r) AS recall_{k}" for k in ranking.KS]
        + [f"sum(CASE WHEN label = 1 AND rank <= {k} THEN 1 / log2(rank + 1) ELSE 0 END) / sum(CASE WHEN rank <= least(r, {k}) THEN 1 / log2(rank + 1) ELSE 0 END) AS ndcg_{k}" for k in ranking.KS]
    ) + f" FROM {rk} WHERE r > 0 GROUP BY task_id"
    m = f"{base}, m AS ({metric('rk')}), mp AS ({metric('rp')})"
    rounded = ", ".join(f"round({c}, 6) AS {c}" for c in METRICS)
    means = ", ".join(f"round(coalesce(avg({c}), 0), 6) AS {c}" for c in METRICS)
    cf = f"{base}, cf AS (SELECT task_id, score AS confidence, label AS correct FROM rk WHERE rank = 1)"
    bins = f"""{base}, b AS (SELECT {' + '.join(f'CAST(score >= {i / 10!r} AS INTEGER)' for i in range(1, 10))} AS bin, avg(score) AS confidence, avg(label) AS accuracy, count(*) AS n FROM sc GROUP BY 1),
      bn AS (SELECT CAST(x AS INTEGER) AS bin, coalesce(confidence, 0) AS confidence, coalesce(accuracy, 0) AS accuracy, coalesce(n, 0) AS n FROM range(10) t(x) LEFT JOIN b ON b.bin = x)"""
    curve = f"""{cf}, c0 AS (SELECT i / 20 AS tau, avg(CASE WHEN confidence >= i / 20 THEN 1.0::DOUBLE ELSE 0 END) AS coverage, avg(CASE WHEN confidence >= i / 20 THEN 1.0::DOUBLE - correct END) AS risk, avg(CASE WHEN confidence >= i / 20 THEN correct::DOUBLE ELSE 0.95::DOUBLE END) AS acc FROM cf, range(21) t(i) GROUP BY i),
      cv AS (SELECT tau, coverage, coalesce(risk, 1) AS risk, 1 - acc AS hybrid_risk, coverage * 2e-7 + (1 - coverage) * 2e-3 AS cost, coverage * 0.3::DOUBLE + (1 - coverage) * 900 AS latency FROM c0)"""
    weight = lambda key: "(" + " + ".join(f"CAST(u >= {x!r}::DOUBLE AS INTEGER)" for x in ranking.POISSON) + ")"
    boot = lambda src, by: f"""SELECT {by} b, sum({weight('')} * s) / sum({weight('')} * c) AS m FROM (SELECT *, {hexa("('42:' || b || ':' || block)")} AS u FROM
      (SELECT {by} CAST(('0x' || substr(md5('block:' || task_id), 1, 8)) AS BIGINT) % {ranking.BLOCKS} AS block, sum(v) AS s, count(*) AS c FROM {src} GROUP BY ALL), range(2000) t(b)) GROUP BY {by} b"""  # noqa: E731
    norm = lambda c: f"trim(replace(replace(lower({c}), '__', ' '), '_', ' '))"
    rx = r"\b\w\w+\b"
    return {
        "topk_per_task": f"WITH {base} SELECT task_id, tool_name, CAST(rank AS INTEGER) AS rank FROM rk WHERE rank <= 7",
        "task_metrics": f"WITH {m} SELECT task_id, n_relevant, {rounded} FROM m",
        "macro_metrics": f"WITH {m} SELECT count(*) AS n_tasks, {means} FROM m",
        "metrics_by_app": f"WITH {m} SELECT app, count(*) AS n_tasks, round(avg(r_precision), 6) AS r_precision, round(avg(recall_3), 6) AS recall_3 FROM m JOIN rec ON record_id = task_id GROUP BY app",
        "score_table": f"""WITH {m}, l AS (SELECT 'score' AS method, * FROM m UNION ALL SELECT 'popularity', * FROM mp), w AS (UNPIVOT (SELECT method, r_precision, recall_3, mrr FROM l) ON r_precision, recall_3, mrr INTO NAME metric VALUE value)
          SELECT 'app' AS pool, method, metric, count(*) AS n_tasks, round(avg(value), 6) AS value FROM w GROUP BY ALL""",
        "confusion_metrics": f"""WITH {base}, t AS (SELECT CAST(sum(CASE WHEN label = 1 AND score >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS tp, CAST(sum(CASE WHEN label = 0 AND score >= 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS fp, CAST(sum(CASE WHEN label = 1 AND score < 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS fn,
          CAST(sum(CASE WHEN label = 0 AND score < 0.5 THEN 1 ELSE 0 END) AS BIGINT) AS tn FROM sc) SELECT tp, fp, fn, tn, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM t""",
        "roc_auc": f"WITH {base}, a AS (SELECT label, rank() OVER (ORDER BY score) AS lo, count(*) OVER (PARTITION BY score) AS c FROM sc), s AS (SELECT sum(CASE WHEN label = 1 THEN lo + (c - 1) / 2 ELSE 0 END) AS u, sum(label)::DOUBLE AS p, sum(1 - label)::DOUBLE AS n FROM a) SELECT round((u - p * (p + 1) / 2) / (p * n), 6) AS roc_auc FROM s",
        "reliability_bins": f"WITH {bins} SELECT bin, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy, n FROM bn",
        "ece": f"WITH {bins} SELECT round(sum(n * abs(accuracy - confidence)) / sum(n), 6) AS ece FROM bn",
        "shortlist_confidence": f"WITH {cf}, fu AS (SELECT task_id, min(label) AS all_correct, round(max(score), 9) AS top_r_score FROM rk WHERE r > 0 AND rank <= r GROUP BY task_id) SELECT cf.task_id, correct, round(confidence, 9) AS confidence, all_correct, top_r_score FROM cf LEFT JOIN fu USING (task_id)",
        "hybrid_curve": f"WITH {curve} SELECT tau, round(coverage, 6) AS coverage, round(risk, 6) AS risk, round(hybrid_risk, 6) AS hybrid_risk, round(cost, 6) AS cost, round(latency, 6) AS latency FROM cv",
        "coverage_at_risk": f"WITH {curve} SELECT t AS target, round(max(CASE WHEN risk <= t THEN coverage END), 6) AS coverage FROM cv, (VALUES (0.0::DOUBLE), (0.1::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE)) v(t) GROUP BY t",
        "risk_area": f"WITH {curve}, d AS (SELECT coverage - lag(coverage) OVER w AS dx, (risk + lag(risk) OVER w) / 2 AS y FROM cv WINDOW w AS (ORDER BY coverage, tau)) SELECT round(sum(dx * y), 6) AS aurc FROM d",
        "quantile_thresholds": f"WITH {cf}, q AS (SELECT quantile_cont(confidence, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM cf) SELECT CAST(i AS INTEGER) AS i, round(q[i + 1], 9) AS tau FROM q, range(9) t(i)",
        "bootstrap_ci": f"WITH {m}, v AS (SELECT task_id, r_precision AS v FROM m), bs AS ({boot('v', '')}) SELECT (SELECT count(*) FROM v) AS n, round((SELECT avg(v) FROM v), 6) AS mean, round(quantile_cont(m, 0.025), 6) AS lower, round(quantile_cont(m, 0.975), 6) AS upper FROM bs",
        "paired_holm": f"""WITH {m}, v AS (SELECT app, m.task_id, m.mrr - mp.mrr AS v FROM m JOIN mp USING (task_id) JOIN rec ON record_id = m.task_id), bs AS ({boot('v', 'app,')}),
          t AS (SELECT app, n, mean, quantile_cont(m, 0.025) AS lower, quantile_cont(m, 0.975) AS upper, least(1.0::DOUBLE, 2 * least(avg(CAST(m <= 0 AS DOUBLE)), avg(CAST(m >= 0 AS DOUBLE)))) AS p_value FROM bs JOIN (SELECT app, count(*) AS n, avg(v) AS mean FROM v GROUP BY app) USING (app) GROUP BY app, n, mean),
          k AS (SELECT *, p_value <= 0.05::DOUBLE / (count(*) OVER () - row_number() OVER (ORDER BY p_value, app) + 1) AS ok FROM t) SELECT app, n, round(mean, 6) AS mean, round(lower, 6) AS lower, round(upper, 6) AS upper, round(p_value, 6) AS p_value, bool_and(ok) OVER (ORDER BY p_value, app ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reject FROM k""",
        "random_baseline": f"""WITH {base}, ra AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY {hexa("'random:' || task_id || ':' || tool_name")} DESC, tool_name) AS rank, sum(label) OVER (PARTITION BY task_id) AS r FROM sc), m AS ({metric('ra')}) SELECT count(*) AS n_tasks, {means} FROM m""",
        "listed_metrics": f"""WITH {base}, t AS (SELECT task_id, list(rank) FILTER (WHERE label = 1) AS at FROM rk WHERE rank <= 7 GROUP BY task_id), n AS (SELECT task_id, coalesce("at", []) AS p, len(tools) AS r FROM t JOIN rec ON record_id = task_id)
          SELECT task_id, round(CASE WHEN r > 0 THEN len([x FOR x IN p IF x <= r]) / r ELSE 0 END, 6) AS r_precision, round(coalesce(1 / list_min(p), 0), 6) AS mrr, {", ".join(f"round(CASE WHEN r > 0 THEN len([x FOR x IN p IF x <= {k}]) / r ELSE 0 END, 6) AS recall_{k}" for k in ranking.KS)} FROM n""",
        "repeat_prev": f"WITH {records_sql()}, w AS (SELECT st.*, app, last_value(tool IGNORE NULLS) OVER (PARTITION BY record_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM st JOIN rec USING (record_id)) SELECT app, count(*) AS n_steps, CAST(sum(CASE WHEN prev = tool THEN 1 ELSE 0 END) AS BIGINT) AS n_repeats FROM w WHERE tool IS NOT NULL GROUP BY app",
        "depth_buckets": f"""WITH {records_sql()}, w AS (SELECT *, row_number() OVER (PARTITION BY record_id, tool ORDER BY k) > 1 AS again FROM st WHERE tool IS NOT NULL)
          SELECT CASE WHEN k = 0 THEN '0' WHEN k <= 2 THEN '1-2' WHEN k <= 9 THEN '3-9' ELSE '10+' END AS bucket, count(*) AS n_steps, round(avg(CASE WHEN again THEN 1.0::DOUBLE ELSE 0 END), 4) AS share FROM w GROUP BY 1""",
        "tfidf_cosine": f"""WITH d AS (SELECT tool_name, unnest(regexp_extract_all({norm("concat_ws(' ', tool_name, description)")}, '{rx}')) AS term FROM tool_catalog), dc AS (SELECT tool_name, term, count(*) AS tf FROM d GROUP BY ALL),
          idf AS (SELECT term, ln((1 + (SELECT count(*) FROM tool_catalog)) / (1 + count(*))) + 1 AS idf FROM dc GROUP BY term), dw AS (SELECT tool_name, term, tf * idf AS w FROM dc JOIN idf USING (term)), dn AS (SELECT tool_name, sqrt(sum(w * w)) AS norm FROM dw GROUP BY 1),
          q AS (SELECT record_id, unnest(regexp_extract_all({norm('intent')}, '{rx}')) AS term FROM trajectories), qw AS (SELECT record_id, term, count(*) * any_value(idf) AS w FROM q JOIN idf USING (term) GROUP BY ALL), qn AS (SELECT record_id, sqrt(sum(w * w)) AS norm FROM qw GROUP BY 1),
          s AS (SELECT record_id, tool_name, round(sum(qw.w / qn.norm * (dw.w / dn.norm)), 6) AS score FROM qw JOIN qn USING (record_id) JOIN dw USING (term) JOIN dn USING (tool_name) GROUP BY ALL) SELECT record_id, arg_max(tool_name, (score, tool_name)) AS tool_name, max(score) AS score FROM s GROUP BY record_id""",
        "dense_cosine": """WITH v AS (SELECT vec_id, [x::DOUBLE / sqrt(list_sum([y::DOUBLE * y::DOUBLE FOR y IN embedding])) FOR x IN embedding] AS v FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id, round(list_inner_product(q.v, v.v), 6) AS score FROM v q, v WHERE q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id)
          SELECT query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, score FROM s QUALIFY rank <= 5""",
    }
