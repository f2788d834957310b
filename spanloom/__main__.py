"""``python -m spanloom receive|dataset|train|evaluate``: landed spans to trajectories, to datasets, to models, to reports."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import config as C
from .functions import names as N
from .operators import corpus, learn, ranking, sampling, traces
from .sources import files, sinks
from .storage import Scratch
from .streaming import assembler


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="spanloom")
    p.add_argument("--config", help="settings in YAML or JSON")
    sub = p.add_subparsers(dest="command", required=True)
    r = sub.add_parser("receive", help="project landed OTLP requests or traces onto trajectories")
    r.add_argument("--input", required=True)
    r.add_argument("--format", choices=("otlp", "traces"), default="otlp")
    r.add_argument("--output", required=True)
    r.add_argument("--checkpoint", help="read deliveries in Parquet as a stream, with this folder for its state")
    r.add_argument("--tick", help='time between micro-batches, such as "1 second"; without it the stream ends with what has landed')
    r.add_argument("--flush", action="store_true", help="complete what is still open when the stream ends")
    d = sub.add_parser("dataset", help="pointwise rows of trajectories, split by task")
    d.add_argument("--input", required=True)
    d.add_argument("--catalog")
    d.add_argument("--output", required=True)
    d.add_argument("--no-split", action="store_true")
    d.add_argument("--success-only", action="store_true")
    d.add_argument("--gate", action="store_true", help="leave out what the quality gate drops")
    d.add_argument("--loader", default="", help="a reader of one's own by its name")
    d.add_argument("--format", choices=("parquet", "csv"), default="parquet")
    for name in ("train", "evaluate"):
        t = sub.add_parser(name)
        t.add_argument("--dataset", required=True)
        t.add_argument("--output", required=True)
        t.add_argument("--model", required=True, help="folder of the model, written by train and read by evaluate")
        t.add_argument("--format", choices=("parquet", "csv"), default="parquet")
    return p


def receive(spark: SparkSession, args, cfg: C.Config) -> None:
    """Trajectories of landed spans; with a checkpoint as a stream that takes up where it left off, and flushed at its end."""
    if args.checkpoint:
        landed = spark.readStream.schema(files.DELIVERY).parquet(args.input)
        q = assembler.run(landed, args.output, args.checkpoint, cfg, tick=args.tick)
        q.awaitTermination()
        if args.flush:
            open_ = assembler.flush(spark, args.checkpoint, int(time.time() * 1000), cfg.runtime)
            assembler.finish(open_, args.output, "batch=flush", cfg)
        print(json.dumps(assembler.stats(spark, args.checkpoint)))
        return
    read = files.read_otlp if args.format == "otlp" else files.read_traces
    fields, steps = traces.project(read(spark, args.input), cfg.projection)
    sinks.append_private(traces.trajectories(fields, steps), args.output)


def dataset(spark: SparkSession, args, cfg: C.Config) -> None:
    """Gated trajectories to pointwise rows by the sampler of the settings; every record of a file is its own decision."""
    t = files.load(spark, args.input, args.loader, cfg.fields, args.success_only)
    t = Scratch(spark, "dataset").cut(t.withColumn("record_id", F.monotonically_increasing_id()), "records")
    for c, kind in (("score", "double"), ("split_name", "string"), ("recorded_at", "timestamp")):
        t = t if c in t.columns else t.withColumn(c, F.lit(None).cast(kind))
    recs = corpus.records(t)
    if args.gate:
        kept = corpus.gate(recs, cfg.gate.max_spans, cfg.gate.require_success).filter("drop_reason is null").select("record_id")
        recs = recs.join(kept, "record_id", "left_semi")
    catalog = files.read_catalog(spark, args.catalog).select(N.tool_name("tool_name").alias("tool"), "description") if args.catalog else corpus.tool_frequency(recs).select("tool", F.lit("").alias("description"))
    parts = sampling.group_split(recs, "task", cfg.dataset.test_share)
    train = recs if args.no_split else recs.join(parts.filter("part = 'train'"), "task", "left_semi")  # statistics are of training alone
    c = corpus.contexts(recs).withColumn("task_id", F.concat(F.col("record_id").cast("string"), F.lit(":"), "k")).withColumn("tools", F.array_append("used", F.col("tool")))
    d = sampling.negatives(c, catalog, corpus.app_tools(train), corpus.co_occurrence(train), cfg.dataset.negative_ratio, cfg.dataset, "task_id").withColumn("pos", F.array("tool")).withColumnRenamed("app", "app_name")
    rows = sampling.pointwise(d, "pos", ["task_id", "task", "app_name", "intent", "previous_tools", "last_thought", "last_observation", "history_summary", "n_spans", "unique_tools_so_far", "tool_diversity"])
    rows = corpus.guarded_frequency(rows, corpus.tool_frequency(train), "tool_name")
    sinks.write_dataset(rows if args.no_split else rows.join(parts, "task"), args.output, None if args.no_split else "part", args.format)


def _rows(spark: SparkSession, path: str, fmt: str):
    return files.read_dataset_csv(spark, path) if fmt == "csv" else spark.read.parquet(path)


def train(spark: SparkSession, args, cfg: C.Config) -> None:
    """Cross-validated figures, and the model of all training rows, saved."""
    rows = _rows(spark, args.dataset, args.format)
    rows = rows.filter("part = 'train'") if "part" in rows.columns else rows
    rows = Scratch(spark, "train").cut(rows, "rows")
    folds = sampling.group_kfold(rows, "task", cfg.dataset.n_splits)
    m = Scratch(spark, "train").cut(learn.cross_validate(rows, folds, "task", cfg.model), "folds")
    sinks.write_report({"folds": [r.asDict() for r in m.collect()], "mean": learn.fold_average(m).first().asDict()}, args.output)
    learn.save(learn.fit(rows, cfg.model), cfg.model, args.model)


def evaluate(spark: SparkSession, args, cfg: C.Config) -> None:
    """A report on the test rows by the saved model, as JSON and on the console."""
    rows = _rows(spark, args.dataset, args.format)
    rows = rows.filter("part = 'test'") if "part" in rows.columns else rows
    model, _ = learn.load(args.model)
    s = Scratch(spark, "evaluate").cut(learn.predict(model, rows, ["task_id", "tool_name", "label"]), "scores")
    means = ranking.macro(ranking.task_metrics(s), ["r_precision", "mrr", "recall_3", "recall_5"]).first().asDict()
    report = means | ranking.confusion(s).first().asDict() | ranking.roc_auc(s).first().asDict()
    sinks.write_report(report, args.output)
    print(sinks.metrics_table([{"metric": k, "value": v} for k, v in report.items()]))


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("spanloom").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    {"receive": receive, "dataset": dataset, "train": train, "evaluate": evaluate}[args.command](spark, args, C.load(args.config))


if __name__ == "__main__":
    main()
