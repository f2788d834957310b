"""Feature pipelines, classifiers, cross-validation, calibration and shortlists on Spark ML.

Vectors stay sparse. Text weights follow the usual TF-IDF with 1 + ln(tf) and idf = ln((1 + n) / (1 + df)) + 1, of unit
length. Vocabularies are found by SQL; weights are made batch by batch in Arrow arrays, for all text columns in one pass.
All stages can be saved, so a fitted model is one folder.

Defined results: null texts are empty, null categories a class of their own, as are unknown ones, null numbers 0. Of
terms that are equally frequent at the vocabulary's end the first by name stay.
"""

from __future__ import annotations

import json
import warnings
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import keyword_only
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel, Transformer
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols, HasOutputCols
from pyspark.ml.regression import IsotonicRegression
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import ModelConfig
from . import ranking, sampling

# Columns that features are made of: the layout of the datasets (fixed values).
TEXT = ("intent", "previous_tools", "last_thought", "tool_name", "tool_description", "history_summary", "last_observation")
CATEGORY = ("app_name",)
NUMERIC = ("n_spans", "span_index", "unique_tools_so_far", "tool_diversity", "app_tool_count", "tool_name_length", "tool_frequency", "tool_co_occurrence", "n_params", "n_string_params", "n_integer_params", "n_number_params", "n_boolean_params", "n_array_params", "n_enum_params")
BOOLEAN = ("has_description", "tool_app_match", "has_parameters")
VERSION = 2
_HELD = "_held_out"


def terms(text: Column | str) -> Column:
    """Words of two and more letters or digits, lower-cased, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))


def vocabulary(rows: DataFrame, columns: list[str], max_terms: int) -> DataFrame:
    """(``column``, ``term``, ``df``, ``idf``): the ``max_terms`` most frequent terms of each text column."""
    n = rows.count()
    kind = "array<struct<column:string,term:string,tf:int,df:int>>"

    def counted(words: Column, column: str, tf: int) -> Column:
        return F.transform(words, lambda t: F.struct(F.lit(column).alias("column"), t.alias("term"), F.lit(tf).alias("tf"), F.lit(1 - tf).alias("df"))).cast(kind)

    both = [x for c in columns for x in (counted(terms(c), c, 1), counted(F.array_distinct(terms(c)), c, 0))]
    seen = rows.select(F.explode(F.flatten(F.array(*both))).alias("t")).groupBy("t.column", "t.term").agg(F.sum("t.tf").alias("tf"), F.sum("t.df").alias("df"))
    top = seen.withColumn("r", F.row_number().over(Window.partitionBy("column").orderBy(F.desc("tf"), "term"))).filter(F.col("r") <= max_terms)
    return top.select("column", "term", "df", (F.log((F.lit(1.0) + n) / (1 + F.col("df"))) + 1).alias("idf"))


_SPARSE = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])


def weigh(words: pa.ListArray, known: pa.Array, idf: np.ndarray) -> pa.StructArray:
    """Sparse vectors of unit length for lists of words, in the layout of vector columns."""
    n, width = len(words), max(1, len(known))
    row = np.repeat(np.arange(n), pc.list_value_length(words).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = pc.index_in(words.flatten(), value_set=known).to_numpy(zero_copy_only=False) if len(known) else np.full(len(row), np.nan)
    ok = ~np.isnan(at.astype(float))
    pair, tf = np.unique(row[ok] * width + at[ok].astype(np.int64), return_counts=True)
    of, term = pair // width, (pair % width).astype(np.int32)
    w = (1 + np.log(tf)) * idf[term]
    w = w / np.sqrt(np.bincount(of, w * w, n))[of]
    ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))]).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x)) for x in (term, w)]
    return pa.StructArray.from_arrays([pa.array(np.zeros(n, np.int8)), pa.array(np.full(n, len(known), np.int32)), *lists], fields=list(_SPARSE))


class TextWeights(Estimator, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Text columns to sublinear TF-IDF vectors of unit length."""

    maxTerms = Param(Params._dummy(), "maxTerms", "most terms of a column", TypeConverters.toInt)

    @keyword_only
    def __init__(self, inputCols=None, outputCols=None, maxTerms=5000):
        super().__init__()
        self._setDefault(maxTerms=5000)
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> TextWeightsModel:
        columns = self.getInputCols()
        known: dict[str, list] = {c: [] for c in columns}
        for r in vocabulary(df, columns, self.getOrDefault(self.maxTerms)).orderBy("column", "term").collect():  # at most maxTerms a column
            known[r["column"]].append([r["term"], r["idf"]])
        return TextWeightsModel(inputCols=columns, outputCols=self.getOutputCols(), known=json.dumps(known))


class TextWeightsModel(Model, HasInputCols, HasOutputCols, DefaultParamsReadable, DefaultParamsWritable):
    known = Param(Params._dummy(), "known", "terms and weights of each column, as JSON", TypeConverters.toString)

    @keyword_only
    def __init__(self, inputCols=None, outputCols=None, known=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        known = json.loads(self.getOrDefault(self.known))
        tables = [(pa.array([t for t, _ in known[c]], pa.string()), np.array([w for _, w in known[c]], float)) for c in self.getInputCols()]
        before, outs = df.columns, self.getOutputCols()
        words = [f"_words_{i}" for i in range(len(outs))]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rb in batches:
                vectors = [weigh(rb.column(w), *t) for w, t in zip(words, tables)]
                yield pa.record_batch([*[rb.column(c) for c in before], *vectors], names=[*before, *outs])

        schema = T.StructType([*df.schema.fields, *[T.StructField(o, VectorUDT()) for o in outs]])
        return df.select("*", *[terms(c).alias(w) for c, w in zip(self.getInputCols(), words)]).mapInArrow(run, schema)


class DenseText(Transformer, HasInputCols, HasOutputCols):
    """Text columns to vectors by a function of one's own from texts to rows of numbers; it isn't saved with the model."""

    def __init__(self, inputCols: list[str], outputCols: list[str], embed: Callable[[list[str]], np.ndarray]):
        super().__init__()
        self._set(inputCols=inputCols, outputCols=outputCols)
        self.embed = embed

    def _transform(self, df: DataFrame) -> DataFrame:
        embed, ins, outs = self.embed, self.getInputCols(), self.getOutputCols()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rb in batches:
                vectors = []
                for c in ins:
                    x = np.asarray(embed([t or "" for t in rb.column(c).to_pylist()]), float).reshape(rb.num_rows, -1)
                    ends = pa.array(np.arange(rb.num_rows + 1, dtype=np.int32) * x.shape[1])
                    lists = [pa.nulls(rb.num_rows, pa.list_(pa.int32())), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))]
                    vectors.append(pa.StructArray.from_arrays([pa.array(np.ones(rb.num_rows, np.int8)), pa.nulls(rb.num_rows, pa.int32()), *lists], fields=list(_SPARSE)))
                yield pa.record_batch([*rb.columns, *vectors], names=[*rb.schema.names, *outs])

        return df.mapInArrow(run, T.StructType([*df.schema.fields, *[T.StructField(o, VectorUDT()) for o in outs]]))


def text_encoder(name: str, columns: list[str], max_terms: int = 5000, embed: Callable | None = None):
    """The stage for text columns: ``tfidf``; ``dense`` by ``embed``; ``auto`` is dense if there is an ``embed``.

    Without an ``embed`` dense falls back to TF-IDF, with a warning.
    """
    name, outs = name.lower().strip(), [f"_{c}_v" for c in columns]
    if name not in ("tfidf", "dense", "auto"):
        raise ValueError(f"no such encoder: {name!r}; there are tfidf, dense, auto")
    if name != "tfidf" and embed is not None:
        return DenseText(columns, outs, embed)
    if name == "dense":
        warnings.warn("no function to embed texts with: TF-IDF instead", stacklevel=2)
    return TextWeights(inputCols=columns, outputCols=outs, maxTerms=max_terms)


def prepared(rows: DataFrame) -> DataFrame:
    """Columns that exist, with nulls filled: '' for text, the own class '__unknown__' for categories, 0 for numbers."""
    have = set(rows.columns)
    for c in TEXT:
        if c in have:
            rows = rows.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit("")))
    for c in CATEGORY:
        if c in have:
            rows = rows.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit("__unknown__")))
    for c in NUMERIC + BOOLEAN:
        if c in have:
            rows = rows.withColumn(c, F.coalesce(F.col(c).try_cast("double") if dict(rows.dtypes)[c] == "string" else F.col(c).cast("double"), F.lit(0.0)))
    return rows


def feature_stages(rows: DataFrame, max_terms: int = 5000, encoder: str = "tfidf", embed: Callable | None = None) -> list:
    """The stages for the columns that ``rows`` have."""
    have, stages, parts = set(rows.columns), [], []
    if texts := [c for c in TEXT if c in have]:
        stages.append(text_encoder(encoder, texts, max_terms, embed))
        parts += [f"_{c}_v" for c in texts]
    for c in (c for c in CATEGORY if c in have):
        stages.append(StringIndexer(inputCol=c, outputCol=f"_{c}_i", stringOrderType="alphabetAsc", handleInvalid="keep"))
        parts.append(f"_{c}_i")
    parts += [c for c in NUMERIC + BOOLEAN if c in have]
    if not parts:
        raise ValueError("there is no column to make features of")
    return [*stages, VectorAssembler(inputCols=parts, outputCol="features")]


def estimator(config: ModelConfig, n_rows: int):
    if config.kind == "gbt":
        return GBTClassifier(labelCol="label", featuresCol="features", **({"validationIndicatorCol": _HELD} if config.holdout else {}), **config.gbt)
    if config.kind == "forest":
        return RandomForestClassifier(labelCol="label", featuresCol="features", **config.forest)
    if config.kind == "logistic":
        o = dict(config.logistic)
        return LogisticRegression(labelCol="label", featuresCol="features", regParam=1 / (o.pop("c") * max(1, n_rows)), standardization=False, **o)
    raise ValueError(f"no such classifier: {config.kind}")


def fit(rows: DataFrame, config: ModelConfig = ModelConfig(), embed: Callable | None = None) -> PipelineModel:
    """A fitted pipeline. Boosted trees stop early by a ``holdout`` share of the rows, chosen by their hash."""
    rows = prepared(rows)
    if config.kind == "gbt" and config.holdout:
        u = F.pmod(F.xxhash64(F.lit("holdout"), *rows.columns), F.lit(10_000)) / 10_000
        rows = rows.withColumn(_HELD, u < config.holdout)
    return Pipeline(stages=[*feature_stages(rows, config.max_terms, config.encoder, embed), estimator(config, rows.count())]).fit(rows)


def inputs(model: PipelineModel) -> list[str]:
    """The columns that a fitted pipeline reads."""
    used = {c for s in model.stages for p in ("inputCols", "inputCol") if s.hasParam(p) and s.isDefined(p) for c in np.atleast_1d(s.getOrDefault(p)).tolist()}
    return [c for c in (*TEXT, *CATEGORY, *NUMERIC, *BOOLEAN) if c in used]


def predict(model: PipelineModel, rows: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` and ``score``, the probability of label 1; columns that rows lack count as null."""
    rows = rows.withColumns({c: F.lit(None).cast("string") for c in inputs(model) if c not in rows.columns})
    return model.transform(prepared(rows)).select(*keep, vector_to_array("probability")[1].alias("score"))


def shortlist(model: PipelineModel, candidates: DataFrame, k: int = 7, task: str = "task_id", keep: tuple[str, ...] = ()) -> DataFrame:
    return ranking.top_k(predict(model, candidates, [task, "tool_name", *keep]), k or 7, task)


def candidates(contexts: DataFrame, catalog: DataFrame) -> DataFrame:
    """Every context with every tool of the catalog (``tool_name``, ``tool_description`` and further features).

    A join without a key: contexts stay where they are and the catalog is sent to them, by broadcast where Spark finds it
    small.
    """
    return contexts.crossJoin(catalog)


def shortlist_one(model: PipelineModel, spark: SparkSession, context: dict, tools: list[dict], k: int = 7) -> list[tuple[str, float]]:
    """The best k tools, highest score first, for one context; ``tools`` have ``tool_name`` and perhaps more."""
    rows = [{"task_id": "one", **{k: None if v is None else str(v) for k, v in (context | t).items()}} for t in tools]
    names = sorted({k for r in rows for k in r})
    df = spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], ", ".join(f"`{c}` string" for c in names))
    return [(r["tool_name"], r["score"]) for r in shortlist(model, df, k).orderBy("rank").collect()]


def save(model: PipelineModel, config: ModelConfig, path: str) -> None:
    """The fitted pipeline and its settings, in one folder, with the version of this layout."""
    model.write().overwrite().save(f"{path}/pipeline")
    about = json.dumps({"version": VERSION, "config": config.__dict__})
    SparkSession.active().createDataFrame([(about,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def load(path: str) -> tuple[PipelineModel, ModelConfig]:
    about = json.loads(SparkSession.active().read.text(f"{path}/about").first()["value"])
    if about["version"] != VERSION:
        raise ValueError(f"a model of layout {about['version']}; this reads {VERSION}")
    return PipelineModel.load(f"{path}/pipeline"), ModelConfig(**about["config"])


def cross_validate(rows: DataFrame, folds: DataFrame, group: str, config: ModelConfig = ModelConfig(), task: str = "task_id") -> DataFrame:
    """Mean metrics of each fold, trained on the others."""
    r = rows.join(folds, group)
    out = None
    for f in sorted(x["fold"] for x in folds.select("fold").distinct().collect()):
        model = fit(r.filter(F.col("fold") != f), config)
        scored = predict(model, r.filter(F.col("fold") == f), [task, "tool_name", "label"])
        m = ranking.macro(ranking.task_metrics(scored, task=task), ["r_precision", "mrr", "recall_3"]).withColumn("fold", F.lit(f))
        out = m if out is None else out.unionByName(m)
    return out


def fold_average(folds: DataFrame) -> DataFrame:
    """The mean of every metric over folds."""
    return folds.agg(*[F.avg(c).alias(c) for c in folds.columns if c not in ("fold", "n_tasks")], F.count(F.lit(1)).alias("n_folds"))


def seed_average(rows: DataFrame, group: str, seeds: list[str], config: ModelConfig = ModelConfig(), n_splits: int = 5, task: str = "task_id") -> DataFrame:
    """(task, metric, value): each task's metrics, averaged over one set of folds per seed."""
    out = None
    for seed in seeds:
        folds = sampling.group_kfold(rows, group, n_splits, seed=seed)
        r = rows.join(folds, group)
        for f in range(n_splits):
            scored = predict(fit(r.filter(F.col("fold") != f), config), r.filter(F.col("fold") == f), [task, "tool_name", "label"])
            m = ranking.long_scores(ranking.task_metrics(scored, task=task), ["r_precision", "mrr", "recall_3"], "seeds", config.kind, task)
            out = m if out is None else out.unionByName(m)
    return out.groupBy("method", "task_id", "metric").agg(F.avg("value").alias("value"))


def _log_odds(p: str):
    q = F.least(F.greatest(F.col(p), F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def calibrated(fit_rows: DataFrame, rows: DataFrame, method: str = "platt", p: str = "score", label: str = "label") -> DataFrame:
    """``rows`` with their scores calibrated on ``fit_rows``; unchanged where only one class is there to fit on."""
    if fit_rows.select(label).distinct().count() < 2:
        return rows
    if method == "platt":
        asm = VectorAssembler(inputCols=["_x"], outputCol="_v")
        prep = lambda d: asm.transform(d.withColumn("_x", _log_odds(p)))
        n = fit_rows.count()
        m = LogisticRegression(labelCol=label, featuresCol="_v", regParam=1 / (1e4 * n), standardization=False, probabilityCol="_p", rawPredictionCol="_r", predictionCol="_y").fit(prep(fit_rows))
        return m.transform(prep(rows)).withColumn(p, vector_to_array("_p")[1]).drop("_x", "_v", "_p", "_r", "_y")
    if method == "isotonic":
        m = IsotonicRegression(labelCol=label, featuresCol=p, predictionCol="_y").fit(fit_rows.select(F.col(label).cast("double").alias(label), p))
        return m.transform(rows).withColumn(p, F.col("_y")).drop("_y")
    raise ValueError(f"no such calibration: {method}")


def cross_calibrated(rows: DataFrame, method: str = "platt", fold: str = "fold") -> DataFrame:
    """Each fold calibrated on the others."""
    out = None
    for f in sorted(x[0] for x in rows.select(fold).distinct().collect()):
        part = calibrated(rows.filter(F.col(fold) != f), rows.filter(F.col(fold) == f), method)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else rows
