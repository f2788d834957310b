"""Written intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_WRITTEN: dict[str, list[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a plain ``local[...]`` session, whose tasks all see this machine's disk, may leave it unset; it then
    gets a temporary folder that is removed when Python ends.
    """
    conf = spark.sparkContext.getConf()
    named = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="spanloom-")
        atexit.register(shutil.rmtree, _OWN[app], True)
    return "file://" + _OWN[app]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/spanloom/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Remove a written table; a missing one is no error."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def clear(spark: SparkSession) -> None:
    """Remove all tables that this application wrote; frames that read them can't be used any more."""
    for path in _WRITTEN.pop(spark.sparkContext.applicationId, []):
        drop(spark, path)


class Scratch:
    """Tables written by one operator call; ``drop`` frees those that nothing reads any more."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.paths = spark, name, {}

    def cut(self, df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
        """Write ``df`` and read it back: the lineage ends here and survives the loss of executors."""
        path = new_path(self.spark, f"{self.name}-{label}")
        writer = df.write.mode("errorifexists")
        if partition_by:
            writer = writer.partitionBy(*partition_by)
        writer.parquet(path)
        self.drop(label)
        self.paths[label] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def keep(self, label: str, new_label: str) -> None:
        self.paths[new_label] = self.paths.pop(label)

    def drop(self, *labels: str) -> None:
        for label in labels:
            path = self.paths.pop(label, None)
            if path:
                drop(self.spark, path)
