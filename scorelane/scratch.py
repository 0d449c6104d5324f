"""Shared scratch tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    A local session without that setting gets a temporary folder; a cluster session without it is refused.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="scorelane-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


class Scratch:
    """Written tables under one shared folder. They cut lineage, survive executors, and go with ``drop``."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.kept = spark, f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}", set()

    def put(self, df: DataFrame, name: str, tasks: int | None = None) -> DataFrame:
        """tasks: in how many files to put a table that is known to be small."""
        path = f"{self.root}/{name}"
        self.kept.add(name)
        (df.repartition(tasks) if tasks else df).write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def names(self) -> set[str]:
        return set(self.kept)

    def drop(self, name: str = "") -> None:
        self.kept.discard(name)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}".rstrip("/"))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
