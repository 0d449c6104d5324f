"""Requests and test entries, as batches and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelane.schema import TEST_FILE


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """body: a request per line."""
    return spark.read.text(path).withColumnRenamed("value", "body")


def stream_requests(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path).withColumnRenamed("value", "body")


def read_test_entries(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Entries (id, request, expected_approved) and the one row of statistics of a test file."""
    whole = spark.read.schema(TEST_FILE).option("multiLine", True).json(path)
    entries = whole.select(F.posexplode("entries").alias("entry", "e")).select("entry", F.col("e.request.id").alias("id"), F.col("e.request").alias("request"), F.col("e.expected_approved").alias("expected_approved"))
    return entries, whole.select("stats.*")
