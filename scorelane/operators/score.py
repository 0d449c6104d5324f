"""From neighbours to decisions and response bodies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BAD_REQUEST = '{"error":"bad_request"}'


def vote(queries: DataFrame, neighbours: DataFrame, k: int = 5, deny_from: int = 3, qid: str = "qid") -> DataFrame:
    """qid, frauds, fraud_score, approved; missing neighbours count as no fraud, and the score is over k."""
    n = neighbours.groupBy("qid").agg(F.count_if("is_fraud").alias("frauds"))
    out = queries.select(F.col(qid).alias("qid")).join(n, "qid", "left").withColumn("frauds", F.coalesce("frauds", F.lit(0)).cast("int"))
    return out.withColumns({"fraud_score": F.col("frauds") / F.lit(float(k)), "approved": F.col("frauds") < deny_from})


def body(approved: Column, fraud_score: Column) -> Column:
    return F.to_json(F.struct(approved.alias("approved"), fraud_score.alias("fraud_score")))


def respond(validated: DataFrame, votes: DataFrame, qid: str = "qid") -> DataFrame:
    """qid, status, body of each request: rejected ones have status 400."""
    out = validated.select(F.col(qid).alias("qid"), "status").join(votes, "qid", "left")
    return out.select("qid", "status", F.when(F.col("status") == 200, body(F.col("approved"), F.col("fraud_score"))).otherwise(F.lit(BAD_REQUEST)).alias("body"))
