"""File-system helpers that work on any path Spark itself can read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


_local_folders: dict[str, str] = {}


def _path(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path, hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop_path, fs = _path(spark, path)
    return bool(fs.exists(hadoop_path))


def child_names(spark: SparkSession, path: str) -> list[str]:
    hadoop_path, fs = _path(spark, path)
    if not fs.exists(hadoop_path):
        return []
    return [status.getPath().getName() for status in fs.listStatus(hadoop_path)]


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder from ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster a
    machine-local path would be lost with its executor.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="jobweave-")
    return _local_folders[context.applicationId]


class StagedFolder:
    """A fresh folder of parquet parts, used to cut lineage between steps.

    A written part survives the loss of any executor and keeps real sizes, so
    the next join is planned from them.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame, part: str) -> tuple[DataFrame, int]:
        """Write one part and return it re-read, with its row count.

        The count is observed during the write: no second job, nothing collected.
        """
        seen = Observation()
        target = f"{self.root}/{part}"
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(target)
        return self.spark.read.schema(df.schema).parquet(target), int(seen.get["rows"])

    def remove(self, part: str) -> None:
        """Delete a part that no later step reads; its disk is free at once."""
        hadoop_path, fs = _path(self.spark, f"{self.root}/{part}")
        fs.delete(hadoop_path, True)

    def read(self, schema, path: str = "") -> DataFrame:
        """All parts below ``path`` as one scan; ``name=value`` parts become a column."""
        return self.spark.read.schema(schema).parquet(f"{self.root}/{path}".rstrip("/"))


def stage(df: DataFrame, label: str) -> DataFrame:
    """Materialise a frame that several later plans read."""
    return StagedFolder(df.sparkSession, label).write(df, "rows")[0]
