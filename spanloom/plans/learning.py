"""Queries that train and apply models. Rows, features and weights have SQL; of fitted models tests look at ranks, not scores."""

from __future__ import annotations

from pyspark.ml.feature import StringIndexer
from pyspark.sql import functions as F

from ..config import ModelConfig
from ..operators import corpus, learn, ranking, sampling
from ..storage import Scratch
from .corpus import _catalog, contexts_sql, negatives_sql, records_sql
from .evaluation import scored
from .records import table

_MODEL = ModelConfig(kind="logistic")
TEXTS = ("intent", "previous_tools", "last_thought", "last_observation", "history_summary")


def _training(spark, sf_dir):
    """Pointwise rows of every step with context and tool features, and the split of their record."""
    recs = Scratch(spark, "learn").cut(corpus.records(table(spark, sf_dir, "trajectories")), "recs")
    c = corpus.contexts(recs).withColumn("decision", F.concat(F.col("record_id").cast("string"), F.lit(":"), "k"))
    d = sampling.random_negatives(c.withColumn("out", F.array_append("used", F.col("tool"))), _catalog(spark, sf_dir), "decision", "out", 3)
    keep = ["decision", "record_id", "task", *TEXTS, "n_spans", "unique_tools_so_far", "tool_diversity", "app_name"]
    rows = sampling.pointwise(d.withColumn("pos", F.array("tool")).withColumnRenamed("app", "app_name"), "pos", keep)
    names = _catalog(spark, sf_dir).select(F.col("tool").alias("tool_name"), F.col("description").alias("tool_description"))
    rows = corpus.guarded_frequency(rows, corpus.tool_frequency(recs.filter("split_name = 'train'")), "tool_name").join(names, "tool_name", "left")
    rows = rows.withColumn("tool_name_length", F.length("tool_name")).withColumn("has_description", F.coalesce("tool_description", F.lit("")) != "")
    return rows.join(recs.select("record_id", F.col("split_name").alias("part")), "record_id")


def training_rows(spark, sf_dir):
    """D11: the rows that models are trained on and evaluated with."""
    return _training(spark, sf_dir).withColumn("tool_diversity", F.round("tool_diversity", 6)).drop("tool_description")


def imputed_features(spark, sf_dir):
    """ML5, ML6: numbers and flags of the rows as the features take them, nulls as 0."""
    rows = _training(spark, sf_dir).withColumn("tool_frequency", F.nullif("tool_frequency", F.lit(0))).withColumn("has_description", F.when(F.col("has_description"), True))
    return learn.prepared(rows).select("decision", "tool_name", "tool_frequency", "tool_name_length", F.round("tool_diversity", 6).alias("tool_diversity"), "has_description", "app_name")


def label_encoding(spark, sf_dir):
    """ML4: the number of every app."""
    apps = learn.prepared(corpus.records(table(spark, sf_dir, "trajectories")).select(F.col("app").alias("app_name"))).distinct()
    model = StringIndexer(inputCol="app_name", outputCol="i", stringOrderType="alphabetAsc", handleInvalid="keep").fit(apps)
    return model.transform(apps).select("app_name", F.col("i").cast("int").alias("number"))


def text_vocabulary(spark, sf_dir):
    """ML1: the vocabulary of the intents with document frequencies and weights."""
    v = learn.vocabulary(table(spark, sf_dir, "trajectories"), ["intent"], 5000)
    return v.select("term", F.col("df").cast("long").alias("df"), F.round("idf", 9).alias("idf"))


def model_metrics(spark, sf_dir):
    """ML1, ML4-ML7, ML10, ML11, ML14: a logistic model of the training split, evaluated on the other splits."""
    rows = Scratch(spark, "learn").cut(_training(spark, sf_dir), "rows")
    model = learn.fit(rows.filter("part = 'train'"), _MODEL)
    s = learn.predict(model, rows.filter("part in ('test', 'validation')"), ["decision", "tool_name", "label"])
    return ranking.macro(ranking.task_metrics(s, task="decision"), ["r_precision", "mrr", "recall_1"])


def calibration_report(spark, sf_dir):
    """ML15-ML18: calibration error before and after, each fold calibrated on the others."""
    s = scored(spark, sf_dir).withColumn("fold", F.pmod(F.xxhash64("task_id"), F.lit(3)).cast("int"))
    s = Scratch(spark, "learn").cut(s.select("task_id", "tool_name", "label", "score", "fold"), "scored")
    out = None
    for name, d in (("none", s), ("platt", learn.cross_calibrated(s)), ("isotonic", learn.cross_calibrated(s, "isotonic"))):
        e = ranking.ece(ranking.reliability(d)).select(F.lit(name).alias("method"), "ece")
        out = e if out is None else out.unionByName(e)
    return out


def queries() -> dict:
    return {f.__name__: f for f in (training_rows, imputed_features, label_encoding, text_vocabulary, model_metrics, calibration_report)}


def oracle_sql() -> dict[str, str]:
    rows = f"""{contexts_sql()}, x AS (SELECT record_id, k, tool, record_id || ':' || k AS id, list_append(coalesce(list(tool) FILTER (WHERE tool IS NOT NULL) OVER (PARTITION BY record_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []), tool) AS ex FROM st QUALIFY tool IS NOT NULL),
      {negatives_sql('3')}, pw AS (SELECT record_id, k, tool AS tool_name, 1 AS label FROM x UNION ALL SELECT record_id, k, unnest(negatives), 0 FROM ng), f AS (SELECT tool, count(*) AS n FROM ut WHERE split_name = 'train' GROUP BY tool),
      tr AS (SELECT pw.record_id || ':' || pw.k AS decision, pw.record_id, task, intent, coalesce(prev, '') AS previous_tools, coalesce(th0, '') AS last_thought, left(coalesce(obs0, ''), 200) AS last_observation, coalesce(hist, '') AS history_summary, CAST(pw.k AS INTEGER) AS n_spans,
        CAST(coalesce(uniq, 0) AS INTEGER) AS unique_tools_so_far, round(coalesce(uniq, 0) / greatest(pw.k, 1), 6) AS tool_diversity, app AS app_name, tool_name, label, coalesce(f.n, 0) AS tool_frequency, CAST(length(tool_name) AS INTEGER) AS tool_name_length, coalesce(description, '') <> '' AS has_description, split_name AS part
        FROM pw JOIN ctx ON ctx.record_id = pw.record_id AND ctx.k = pw.k JOIN rec ON rec.record_id = pw.record_id LEFT JOIN f ON f.tool = tool_name LEFT JOIN cat ON cat.tool = tool_name)"""
    return {
        "training_rows": f"WITH {rows} SELECT * FROM tr",
        "imputed_features": f"WITH {rows} SELECT decision, tool_name, CAST(tool_frequency AS DOUBLE) AS tool_frequency, CAST(tool_name_length AS DOUBLE) AS tool_name_length, tool_diversity, CAST(has_description AS DOUBLE) AS has_description, coalesce(app_name, '__unknown__') AS app_name FROM tr",
        "label_encoding": f"WITH {records_sql()}, a AS (SELECT DISTINCT coalesce(app, '__unknown__') AS app_name FROM rec) SELECT app_name, CAST(row_number() OVER (ORDER BY app_name) - 1 AS INTEGER) AS number FROM a",
        "text_vocabulary": """WITH d AS (SELECT regexp_extract_all(lower(coalesce(intent, '')), '[\\p{L}\\p{M}\\p{Nd}\\p{Pc}]{2,}') AS w FROM trajectories), t AS (SELECT unnest(w) AS term FROM d), f AS (SELECT unnest(list_distinct(w)) AS term FROM d),
          c AS (SELECT term, count(*) AS tf FROM t GROUP BY term), e AS (SELECT term, count(*) AS df FROM f GROUP BY term)
          SELECT term, df, round(ln((1.0::DOUBLE + (SELECT count(*) FROM d)) / (1 + df)) + 1, 9) AS idf FROM c JOIN e USING (term) QUALIFY row_number() OVER (ORDER BY tf DESC, term) <= 5000""",
    }
