"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from scorelane.queries import QUERIES

HEADLINE = [
    "knn_brute_top5",
    "knn_fraud_vote",
    "centroid_assign",
    "kmeans_one_step",
    "ivf_top_nprobe",
    "ivf_knn_f16_order",
    "cluster_sort",
    "f16_quantise",
    "recall_at_5",
    "feature_vector_full",
    "known_merchant_semi",
    "payload_validate",
    "detection_score",
    "transaction_scores",
    "index_build",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["label_histogram"](spark, sf_dir).collect()  # starts executors and compiles
    took: dict[str, float] = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    asked = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where("vec_id % 100 = 0").count()
    rates = {f"{n}_queries_per_s": round(asked / took[n], 1) for n in ("knn_brute_top5", "ivf_knn_f16_order")}
    recall = QUERIES["recall_at_5"](spark, sf_dir).first()["recall"]
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")), "rates": rates, "recall_at_5": recall}))
    spark.stop()


if __name__ == "__main__":
    main()
