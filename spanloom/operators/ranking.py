"""Rankings of candidate tools and their evaluation: per-task metrics, calibration, risk and coverage, resampling.

Windows are per task; what needs an order over everything (ROC area, curves) first collapses to distinct values and then
uses prefix sums in two levels, so no window runs over all rows in one task.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import Scratch

KS = (1, 3, 5, 7, 9)


def ranked(rows: DataFrame, task: str = "task_id", score: str = "score", tool: str = "tool_name") -> DataFrame:
    """Adds ``rank``: by score, highest first, then by tool."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(task).orderBy(F.desc(score), tool)))


def top_k(rows: DataFrame, k: int = 7, task: str = "task_id", **kw) -> DataFrame:
    return ranked(rows, task, **kw).filter(F.col("rank") <= k)


def task_metrics(rows: DataFrame, ks: tuple[int, ...] = KS, task: str = "task_id", label: str = "label", score: str = "score", tool: str = "tool_name") -> DataFrame:
    """R-precision, recall and nDCG at each k, and MRR of every task that has a relevant tool."""
    r = ranked(rows, task, score, tool).withColumn("_r", F.sum(label).over(Window.partitionBy(task)))
    hit = F.col(label) == 1
    gain = 1 / (F.log2(F.col("rank") + 1))
    dcg = lambda k: F.sum(F.when(hit & (F.col("rank") <= k), gain).otherwise(0.0))
    ideal = lambda k: F.sum(F.when(F.col("rank") <= F.least(F.col("_r"), F.lit(k)), gain).otherwise(0.0))
    aggs = [
        F.max("_r").alias("n_relevant"),
        (F.sum(F.when(hit & (F.col("rank") <= F.col("_r")), 1).otherwise(0)) / F.max("_r")).alias("r_precision"),
        (1 / F.min(F.when(hit, F.col("rank")))).alias("mrr"),
        *[(F.sum(F.when(hit & (F.col("rank") <= k), 1).otherwise(0)) / F.max("_r")).alias(f"recall_{k}") for k in ks],
        *[(dcg(k) / ideal(k)).alias(f"ndcg_{k}") for k in ks],
    ]
    return r.filter("_r > 0").groupBy(task).agg(*aggs)


def macro(metrics: DataFrame, columns: list[str], by: list[str] = ()) -> DataFrame:
    """Means over tasks; 0 where there are none."""
    return metrics.groupBy(*by).agg(F.count(F.lit(1)).alias("n_tasks"), *[F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in columns])


def long_scores(metrics: DataFrame, columns: list[str], pool: str, method: str, task: str = "task_id") -> DataFrame:
    """(pool, method, metric, task_id, value)."""
    return metrics.select(F.lit(pool).alias("pool"), F.lit(method).alias("method"), F.col(task).alias("task_id"), F.explode(F.map_from_arrays(F.array(*map(F.lit, columns)), F.array(*[F.col(c).cast("double") for c in columns]))).alias("metric", "value"))


def format_metrics(metrics: dict[str, float]) -> str:
    """One line per metric, by name, with four digits."""
    return "\n".join(f"{k}: {v:.4f}" if isinstance(v, float) else f"{k}: {v}" for k, v in sorted(metrics.items()))


def list_metrics(lists: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = KS, task: str = "task_id") -> DataFrame:
    """The metrics of ranked lists of names (``ranked``, in order, as a model replies) against ``relevant`` (arrays), inner by task.

    A name counts where it first occurs. Without a relevant tool all are 0; null and blank names take no place.
    """
    names = F.array_distinct(F.filter("ranked", lambda x: F.coalesce(F.trim(x), F.lit("")) != ""))
    j = lists.select(task, names.alias("_l")).join(relevant.select(task, F.array_distinct("relevant").alias("_r")), task)
    at = F.filter(F.transform("_r", lambda t: F.array_position("_l", t)), lambda p: p > 0)
    r = F.size("_r")
    share = lambda k: F.coalesce(F.try_divide(F.size(F.filter("_at", lambda p: p <= k)), r), F.lit(0.0))
    j = j.withColumn("_at", at)
    return j.select(task, share(r).alias("r_precision"), F.coalesce(F.try_divide(F.lit(1.0), F.array_min("_at")), F.lit(0.0)).alias("mrr"), *[share(F.lit(k)).alias(f"recall_{k}") for k in ks])


def random_scores(rows: DataFrame, seed: str = "random", task: str = "task_id", tool: str = "tool_name") -> DataFrame:
    """Adds ``score``: uniform in [0, 1), by the hash of seed, task and tool."""
    text = F.concat(F.lit(seed + ":"), F.col(task).cast("string"), F.lit(":"), F.col(tool))
    return rows.withColumn("score", F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / 4294967296.0)


def latency_means(rows: DataFrame, method: str = "method", ms: str = "latency_ms") -> DataFrame:
    """Mean latency of a decision by method; rows without a latency don't count."""
    known = rows.filter(F.col(ms).isNotNull())
    return known.groupBy(method).agg(F.count(F.lit(1)).alias("n"), (F.sum(ms) / F.count(F.lit(1))).alias("mean_ms"))


def timed(method: str, n_decisions: int, run: Callable[[], object]) -> tuple[str, int, float]:
    """(method, decisions, milliseconds a decision) of a call."""
    began = time.perf_counter()
    run()
    return method, n_decisions, (time.perf_counter() - began) * 1000 / max(1, n_decisions)


def confusion(rows: DataFrame, label: str = "label", p: str = "score", threshold: float = 0.5) -> DataFrame:
    y, q = F.col(label) == 1, F.col(p) >= threshold
    n = lambda c: F.sum(F.when(c, 1).otherwise(0))
    t = rows.agg(n(y & q).alias("tp"), n(~y & q).alias("fp"), n(y & ~q).alias("fn"), n(~y & ~q).alias("tn"))
    div = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return t.select("tp", "fp", "fn", "tn", div(tp + tn, tp + fp + fn + tn).alias("accuracy"), div(tp, tp + fp).alias("precision"), div(tp, tp + fn).alias("recall"), div(2 * tp, 2 * tp + fp + fn).alias("f1"))


def prefix_sums(df: DataFrame, order: str, value: str, out: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows of smaller ``order`` (distinct): within ranges, then over the ranges' sums."""
    scratch = Scratch(df.sparkSession, "prefix")
    parts = scratch.cut(df.repartitionByRange(order).withColumn("_part", F.spark_partition_id()), "parts")
    sums = parts.groupBy("_part").agg(F.sum(value).alias("_s"))  # one row per partition
    ahead = sums.withColumn("_ahead", F.coalesce(F.sum("_s").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    within = F.sum(value).over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col(value)
    return parts.withColumn(out, within).join(F.broadcast(ahead), "_part").withColumn(out, F.col(out) + F.col("_ahead")).drop("_part", "_ahead")


def roc_auc(rows: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """Area under the ROC curve, ties counting half; null unless both classes are present."""
    per = rows.groupBy(score).agg(F.sum(label).alias("p"), F.sum(1 - F.col(label)).alias("n"))
    below = prefix_sums(per, score, "n", "below")
    t = below.agg(F.sum(F.col("p") * (F.col("below") + F.col("n") / 2)).alias("u"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return t.select(F.try_divide("u", F.col("p") * F.col("n")).alias("roc_auc"))


def reliability(rows: DataFrame, label: str = "label", p: str = "score", n_bins: int = 10) -> DataFrame:
    """Mean confidence, accuracy and count of each bin; empty bins hold zeros."""
    edges = sum(((F.col(p) >= F.lit(i / n_bins)).cast("int") for i in range(1, n_bins)), F.lit(0))
    per = rows.filter(F.col(p).isNotNull()).groupBy(edges.alias("bin")).agg(F.avg(p).alias("confidence"), F.avg(label).alias("accuracy"), F.count(F.lit(1)).alias("n"))
    bins = rows.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    return bins.join(per, "bin", "left").fillna(0.0, ["confidence", "accuracy"]).fillna(0, ["n"])


def ece(bins: DataFrame) -> DataFrame:
    return bins.agg(F.coalesce(F.try_divide(F.sum(F.col("n") * F.abs(F.col("accuracy") - F.col("confidence"))), F.sum("n")), F.lit(0.0)).alias("ece"))


def confidences(rows: DataFrame, k: int = 1, task: str = "task_id") -> DataFrame:
    """Per task: highest score of the top k and whether one of them is relevant."""
    return top_k(rows, k, task).groupBy(task).agg(F.max("score").alias("confidence"), F.max("label").alias("correct"))


def full_shortlists(rows: DataFrame, task: str = "task_id") -> DataFrame:
    """Per task: whether the top R are exactly the R relevant tools, and their highest score."""
    r = ranked(rows, task).withColumn("_r", F.sum("label").over(Window.partitionBy(task)))
    return r.filter((F.col("_r") > 0) & (F.col("rank") <= F.col("_r"))).groupBy(task).agg(F.max("score").alias("confidence"), F.min("label").alias("correct"))


def risk_curve(conf: DataFrame, taus: list[float], deferred_accuracy: float = 0.95, local: tuple[float, float] = (2e-7, 0.3), deferred: tuple[float, float] = (2e-3, 900.0)) -> DataFrame:
    """Coverage, risk, and the hybrid's risk, cost and latency at every threshold; ``local`` and ``deferred`` are cost and latency."""
    t = conf.sparkSession.createDataFrame([(float(x),) for x in taus], "tau double")
    kept = F.col("confidence") >= F.col("tau")
    c = conf.crossJoin(F.broadcast(t)).groupBy("tau").agg(F.avg(kept.cast("double")).alias("coverage"), F.avg(F.when(kept, 1.0 - F.col("correct"))).alias("risk"), F.avg(F.when(kept, F.col("correct").cast("double")).otherwise(deferred_accuracy)).alias("acc"))
    mix = lambda i: F.col("coverage") * local[i] + (1 - F.col("coverage")) * deferred[i]
    return c.select("tau", "coverage", F.coalesce("risk", F.lit(1.0)).alias("risk"), (1 - F.col("acc")).alias("hybrid_risk"), mix(0).alias("cost"), mix(1).alias("latency"))


def coverage_at_risk(curve: DataFrame, targets: list[float]) -> DataFrame:
    """The largest coverage whose risk is within each target; null if none is."""
    t = curve.sparkSession.createDataFrame([(float(x),) for x in targets], "target double")
    return t.crossJoin(curve).groupBy("target").agg(F.max(F.when(F.col("risk") <= F.col("target"), F.col("coverage"))).alias("coverage"))


def curve_area(curve: DataFrame) -> DataFrame:
    """Trapezoids over the curve's points by coverage; a curve has one point per threshold."""
    w = Window.orderBy("coverage", "tau")
    c = curve.withColumn("dx", F.col("coverage") - F.lag("coverage").over(w)).withColumn("y", (F.col("risk") + F.lag("risk").over(w)) / 2)
    return c.agg(F.coalesce(F.sum(F.col("dx") * F.col("y")), F.lit(0.0)).alias("aurc"))


#: Cumulative probabilities of a Poisson variable of mean 1 (fixed values).
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253)


#: Blocks of tasks that are resampled as one.
BLOCKS = 1000


def _hash(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def bootstrap(values: DataFrame, value: str, task: str = "task_id", by: list[str] = (), n_boot: int = 2000, seed: str = "42", level: float = 0.95, blocks: int = BLOCKS) -> DataFrame:
    """Mean and percentile interval by Poisson resampling of blocks of tasks.

    Tasks fall into ``blocks`` by their hash; in every replicate a block counts as often as a Poisson variable of mean 1
    says, by the hash of seed, replicate and block. Blocks are random groups, so the spread of the means is that of resampled
    tasks, while the work is one sum over the tasks and ``blocks`` * ``n_boot`` draws, however many tasks there are.
    """
    v = values.filter(F.col(value).isNotNull())
    block = F.pmod(_hash(F.concat(F.lit("block:"), F.col(task).cast("string"))), F.lit(blocks)).cast("int")
    sums = v.groupBy(*by, block.alias("block")).agg(F.sum(value).alias("s"), F.count(F.lit(1)).alias("c"))
    spark = values.sparkSession
    draws = spark.range(blocks).select(F.col("id").cast("int").alias("block")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))))
    u = _hash(F.concat(F.lit(seed + ":"), F.col("b").cast("string"), F.lit(":"), F.col("block").cast("string"))).cast("double") / 4294967296.0
    draws = Scratch(spark, "draws").cut(draws.select("block", "b", sum(((u >= x).cast("int") for x in POISSON), F.lit(0)).alias("w")).filter("w > 0"), "draws")
    m = draws.join(sums, "block").groupBy(*by, "b").agg((F.sum(F.col("w") * F.col("s")) / F.sum(F.col("w") * F.col("c"))).alias("m"))
    ends = m.groupBy(*by).agg(F.percentile("m", F.array(F.lit((1 - level) / 2), F.lit((1 + level) / 2))).alias("q"), F.avg((F.col("m") <= 0).cast("double")).alias("le"), F.avg((F.col("m") >= 0).cast("double")).alias("ge"))
    mean = v.groupBy(*by).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))
    out = mean.join(ends, list(by)) if by else mean.crossJoin(ends)
    return out.select(*by, "n", "mean", F.get("q", F.lit(0)).alias("lower"), F.get("q", F.lit(1)).alias("upper"), F.least(F.lit(1.0), 2 * F.least("le", "ge")).alias("p_value"))


def paired_bootstrap(a: DataFrame, b: DataFrame, value: str, task: str = "task_id", by: list[str] = (), **kw) -> DataFrame:
    """The same for the differences of tasks that both have."""
    j = a.select(*by, task, F.col(value).alias("_a")).join(b.select(task, F.col(value).alias("_b")), task)
    return bootstrap(j.withColumn("diff", F.col("_a") - F.col("_b")), "diff", task, by, **kw)


def holm(tests: DataFrame, p: str = "p_value", name: str = "name", alpha: float = 0.05) -> DataFrame:
    """Adds ``reject``: smallest p first, against alpha / (m - j + 1), stopping at the first that fails. One row per test."""
    w = Window.orderBy(p, name)
    m = F.count(F.lit(1)).over(Window.partitionBy())
    ok = F.col(p) <= alpha / (m - F.row_number().over(w) + 1)
    return tests.withColumn("_ok", ok).withColumn("reject", F.min("_ok").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("_ok")


def tfidf(docs: DataFrame, key: str, text: str, sublinear: bool = False) -> tuple[DataFrame, DataFrame]:
    """Unit vectors as (key, term, weight) and the vocabulary's (term, idf), with idf = ln((1 + n) / (1 + df)) + 1."""
    term = F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"\b\w\w+\b"), F.lit(0)))
    counts = docs.select(key, term.alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    idf = counts.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    return _unit(counts, key, idf, sublinear), idf


def tfidf_queries(queries: DataFrame, key: str, text: str, idf: DataFrame, sublinear: bool = False) -> DataFrame:
    term = F.explode(F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"\b\w\w+\b"), F.lit(0)))
    return _unit(queries.select(key, term.alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf")), key, idf, sublinear)


def _unit(counts: DataFrame, key: str, idf: DataFrame, sublinear: bool) -> DataFrame:
    tf = F.log(F.col("tf")) + 1 if sublinear else F.col("tf").cast("double")
    w = counts.join(idf, "term").withColumn("w", tf * F.col("idf"))
    norm = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, key).select(key, "term", (F.col("w") / F.col("norm")).alias("weight"))


def cosine(queries: DataFrame, docs: DataFrame, q: str, d: str) -> DataFrame:
    """Similarities above 0 as (q, d, score), by a join on terms."""
    j = queries.withColumnRenamed("weight", "_a").join(docs.withColumnRenamed("weight", "_b"), "term")
    return j.groupBy(q, d).agg(F.sum(F.col("_a") * F.col("_b")).alias("score"))


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: str | Column) -> Column:
    norm = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / norm)
