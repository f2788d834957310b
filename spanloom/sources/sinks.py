"""Writers: trajectories, split datasets, reports and metrics."""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_trajectories(df: DataFrame, path: str, mode: str = "append") -> None:
    """JSON lines without ``tools_used``; ``success`` and the metadata's ``success_source`` are always there."""
    m = F.coalesce(F.from_json("metadata", "map<string,string>"), F.create_map().cast("map<string,string>"))
    source = F.coalesce(F.element_at(m, F.lit("success_source")), F.lit("unknown"))
    meta = F.map_concat(F.map_filter(m, lambda k, v: k != "success_source"), F.create_map(F.lit("success_source"), source))
    df.drop("tools_used").withColumn("success", F.coalesce("success", F.lit(False))).withColumn("metadata", meta).write.mode(mode).json(path)


def write_dataset(df: DataFrame, path: str, split: str | None = "part", fmt: str = "parquet") -> None:
    """The dataset as a whole or in one folder per split."""
    w = df.write.mode("overwrite").format(fmt)
    if fmt == "csv":
        w = w.option("header", True)
    (w.partitionBy(split) if split else w).save(path)


def private(spark: SparkSession, path: str) -> None:
    """Give files below ``path`` mode 0600 and folders 0700, as far as the file system knows modes: they hold what users said."""
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    mode = lambda m: getattr(hadoop.permission, "FsPermission")(m)
    todo = [fs.getFileStatus(at)]
    while todo:
        s = todo.pop()
        fs.setPermission(s.getPath(), mode("700" if s.isDirectory() else "600"))
        todo += fs.listStatus(s.getPath()) if s.isDirectory() else []


def append_private(df: DataFrame, path: str) -> None:
    """Trajectories appended as JSON lines that only their owner may read."""
    write_trajectories(df, path)
    private(df.sparkSession, path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Rows of any schema as JSON lines, nulls included."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_spans(deliveries: DataFrame, path: str, mode: str = "append") -> None:
    """Spans as JSON lines, one object each, as ``files.read_traces`` reads them; attributes and resource as objects."""
    parsed = lambda c: F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>")).alias(c)
    plain = ("trace_id", "span_id", "parent_span_id", "name", "start_time_unix_nano", "end_time_unix_nano", "status_code")
    deliveries.select(*plain, parsed("attributes"), parsed("resource"), "events").write.mode(mode).json(path)


def metrics_table(rows: list[dict], columns: list[str] | None = None) -> str:
    """A table for the console: four digits, numbers to the right."""
    columns = columns or list(dict.fromkeys(c for r in rows for c in r))
    show = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    cells = [columns, *[[show(r.get(c)) for c in columns] for r in rows]]
    width = [max(len(r[i]) for r in cells) for i in range(len(columns))]
    number = [any(isinstance(r.get(c), (int, float)) for r in rows) for c in columns]
    return "\n".join("  ".join(x.rjust(w) if n else x.ljust(w) for x, w, n in zip(r, width, number)).rstrip() for r in cells)


def write_results(results: DataFrame, path: str) -> None:
    """A checkpoint of model results (``task_id``, ``ranked``, ``cost_usd``, ``latency_ms``) as Parquet, renamed into place.

    What was there before stays until the new table is complete.
    """
    spark = results.sparkSession
    results.write.mode("overwrite").parquet(f"{path}.part")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at, part = hadoop.Path(path), hadoop.Path(f"{path}.part")
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.delete(at, True)
    if not fs.rename(part, at):
        raise OSError(f"{path}.part can't be renamed")


def write_report(report: dict, path: str) -> None:
    """A small report as JSON, renamed into place."""
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    part = f"{path}.part"
    with open(part, "w", encoding="utf-8") as f:
        json.dump(report, f, indent=2, default=str, ensure_ascii=False)
    os.replace(part, path)


def metrics_text(counters: dict[tuple[str, str | None], float], prefix: str = "spanloom") -> str:
    """Counters in text exposition format; keys are (name, label or None)."""
    return "".join(f"{prefix}_{name}" + (f'{{reason="{label}"}}' if label else "") + f" {value:g}\n" for (name, label), value in sorted(counters.items(), key=str))
