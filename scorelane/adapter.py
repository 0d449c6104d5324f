"""The driver's tables as inputs of the engine: embeddings as references and queries, events as card transactions.

Transactions are made up from events; their history fields need each user's events in order, so one user's events meet in
one task. This serves tests and benchmarks only: real payloads bring these fields along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scorelane.config import MCC_RISK
from scorelane.operators.kmeans import assign, clustered
from scorelane.operators.knn import spread

EMBEDDING_DIMS = 64
EMBEDDING_NAMES = [f"v{i}" for i in range(EMBEDDING_DIMS)]
MCCS = [*MCC_RISK, "9999"]
DAY = 86_400_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ref_id, pos, is_fraud, v0 to v63: every row of embeddings; labels 0, 1 and 2 are frauds."""
    e = table(spark, sf_dir, "embeddings")
    rows = e.select(F.col("vec_id").alias("ref_id"), F.col("vec_id").alias("pos"), F.col("label").isin(0, 1, 2).alias("is_fraud"), "embedding")
    return spread(rows, "embedding", EMBEDDING_DIMS)


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """qid, v0 to v63: the rows whose vec_id is divisible by 100."""
    e = table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0")
    return spread(e.select(F.col("vec_id").alias("qid"), "embedding"), "embedding", EMBEDDING_DIMS)


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cluster, v0 to v63: of each label the vector of the least vec_id."""
    e = table(spark, sf_dir, "embeddings").groupBy(F.col("label").alias("cluster")).agg(F.min_by("embedding", "vec_id").alias("embedding"))
    return spread(e, "embedding", EMBEDDING_DIMS)


def clustered_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """references with cluster and the place in the order of clusters."""
    refs = references(spark, sf_dir)
    return clustered(assign(refs, centroids(spark, sf_dir), EMBEDDING_NAMES, keep=[*EMBEDDING_NAMES, "is_fraud"]).drop("dist"))


def _text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, payload: every event as a transaction."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("k", F.regexp_extract("props", r'"k": *([0-9]+)', 1).cast("int"))
    by_user = e.groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("user_avg"))
    by_merchant = e.groupBy("k").agg(F.round(F.avg("value"), 6).alias("merchant_avg"))
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    day = Window.partitionBy("user_id").orderBy(F.unix_micros("ts")).rangeBetween(-DAY, 0)
    e = e.withColumns(
        {
            "merchant": F.concat(F.lit("MERC-"), "k"),
            "before": F.lag("ts").over(order),
            "recent": F.count(F.lit(1)).over(day) - 1,
        }
    )
    e = e.withColumn("known", F.collect_list("merchant").over(order.rowsBetween(-5, -1)))
    e = e.join(by_user, "user_id").join(by_merchant, "k")
    f = lambda x: x.cast("float")
    last = F.when(F.col("before").isNotNull(), F.struct(_text(F.col("before")).alias("timestamp"), f((F.col("event_id") * 53) % 1100).alias("km_from_current")))
    return e.select(
        "event_id",
        F.struct(
            F.concat(F.lit("tx-"), "event_id").alias("id"),
            F.struct(f(F.col("value")).alias("amount"), f(1 + F.col("event_id") % 12).alias("installments"), _text(F.col("ts")).alias("requested_at")).alias("transaction"),
            F.struct(f(F.col("user_avg")).alias("avg_amount"), f(F.col("recent")).alias("tx_count_24h"), F.col("known").alias("known_merchants")).alias("customer"),
            F.struct(F.col("merchant").alias("id"), F.element_at(F.array(*[F.lit(m) for m in MCCS]), (F.col("k") % len(MCCS) + 1).cast("int")).alias("mcc"), f(F.col("merchant_avg")).alias("avg_amount")).alias("merchant"),
            F.struct((F.col("event_id") % 2 == 0).alias("is_online"), (F.col("event_id") % 3 != 0).alias("card_present"), f((F.col("event_id") * 37) % 1200).alias("km_from_home")).alias("terminal"),
            last.alias("last_transaction"),
        ).alias("payload"),
    )


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, body: every event as a request, seven of ten with a defect that its event_id names."""
    p = payloads(spark, sf_dir).withColumn("good", F.to_json("payload")).withColumn("kind", F.col("event_id") % 10)
    at = F.col("payload.transaction.requested_at")
    swap = lambda old, new: F.replace("good", old, new)
    body = (
        F.when(F.col("kind") == 1, F.regexp_replace("good", r'"amount":[^,]*,', ""))
        .when(F.col("kind") == 2, F.left("good", F.length("good") - 3))
        .when(F.col("kind") == 3, swap(at, F.left(at, F.lit(19))))
        .when(F.col("kind") == 4, F.regexp_replace("good", r'"known_merchants":\[[^\]]*\]', '"known_merchants":["M",null]'))
        .when(F.col("kind") == 5, swap(at, F.concat(F.left(at, F.lit(5)), F.lit("13"), F.substr(at, F.lit(8)))))
        .when(F.col("kind") == 6, F.regexp_replace(F.regexp_replace("good", r',"last_transaction":\{[^}]*\}', ""), r"\}$", ',"last_transaction":{"timestamp":"2024-01-01T00:00:00Z"}}'))
        .when(F.col("kind") == 7, F.regexp_replace("good", r'"installments":[^,]*,', '"installments":"3",'))
        .when(F.col("kind") == 8, F.regexp_replace(F.regexp_replace("good", r',"last_transaction":\{[^}]*\}', ""), r"\}$", ',"last_transaction":null}'))
        .when(F.col("kind") == 9, swap(at, F.concat(F.left(at, F.lit(11)), F.lit("99"), F.substr(at, F.lit(14)))))
        .otherwise(F.col("good"))
    )
    return p.select("event_id", body.alias("body"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, expected_approved, approved, status, latency_ms of every event."""
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        (F.col("event_id") % 23 != 0).alias("expected_approved"),
        ((F.col("event_id") % 23 != 0) & (F.col("event_id") % 41 != 0) | (F.col("event_id") % 299 == 0)).alias("approved"),
        F.when(F.col("event_id") % 97 == 0, 500).otherwise(200).alias("status"),
        F.col("value").cast("double").alias("latency_ms"),
    )
