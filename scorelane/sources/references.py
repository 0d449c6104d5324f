"""The labelled reference set: one JSON array of {vector, label}, plain or gzipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorelane.config import DIMS
from scorelane.schema import REFERENCE


def read_references(spark: SparkSession, path: str, dims: int = DIMS) -> DataFrame:
    """ref_id (the record's place), v0.., is_fraud. A vector of another length fails the read.

    A gzipped array can't be split, so it is read once by one task; write it as an index and use that. Places come from the
    row order of the single file that the path names.
    """
    raw = spark.read.schema(REFERENCE).option("multiLine", True).option("mode", "FAILFAST").json(path)
    checked = raw.withColumn("vector", F.when(F.size("vector") == dims, F.col("vector")).otherwise(F.raise_error(F.concat(F.lit(f"a vector has not {dims} components but "), F.size("vector").cast("string")))))
    numbered = checked.withColumn("_o", F.monotonically_increasing_id())
    counts = Window.partitionBy(F.spark_partition_id()).orderBy("_o")
    parts = numbered.withColumn("_p", F.spark_partition_id()).withColumn("_w", F.row_number().over(counts))
    before = parts.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).withColumn("_start", F.coalesce(F.sum("n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ids = parts.join(F.broadcast(before.select("_p", "_start")), "_p").withColumn("ref_id", F.col("_start") + F.col("_w") - 1)
    return ids.select("ref_id", *[F.get("vector", F.lit(i)).alias(f"v{i}") for i in range(dims)], F.col("label").eqNullSafe("fraud").alias("is_fraud"))
