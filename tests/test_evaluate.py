import json
import math

import pytest

from pyspark.sql import functions as F

from scorelane.operators import evaluate

SCHEMA = "expected_approved boolean, approved boolean, status int, latency_ms double"


def run(spark, rows):
    return evaluate.scores(evaluate.confusion(spark.createDataFrame(rows, SCHEMA))).first()


def test_counts_and_scores(spark):
    rows = [(True, True, 200, 10.0)] * 95 + [(False, False, 200, 10.0)] * 3 + [(True, False, 200, 10.0), (False, True, 200, 10.0)]
    r = run(spark, rows)
    assert (r["tp"], r["tn"], r["fp"], r["fn"], r["err"], r["total"]) == (3, 95, 1, 1, 0, 100)
    assert r["p99_score"] == pytest.approx(2000)
    assert r["detection_score"] == pytest.approx(1000 * math.log10(1 / 0.04) - 300 * math.log10(5))


def test_cuts_and_floors(spark):
    slow = run(spark, [(True, True, 200, 2500.0)])
    assert slow["p99_score"] == -3000
    bad = run(spark, [(True, None, 500, 0.5)] * 2 + [(True, True, 200, 0.5)])
    assert (bad["err"], bad["detection_score"], bad["rate_part"], bad["p99_score"]) == (2, -3000, None, 3000)
    assert run(spark, [(True, True, 200, 0.0)])["p99_score"] == 0


def test_no_rows(spark):
    r = run(spark, [])
    assert (r["total"], r["failure_rate"], r["error_rate"], r["p99_score"]) == (0, 0, 0, 0)
    assert r["final_score"] == pytest.approx(3000)


def test_results_json(spark):
    scored = evaluate.scores(evaluate.confusion(spark.createDataFrame([(True, True, 200, 1.234567)], SCHEMA)))
    out = json.loads(evaluate.results_json(scored).first()[0])
    assert out["latency"]["p99"] == 1.23 and out["counts"]["tn"] == 1 and out["final_score"] == out["latency"]["score"] + out["detection"]["score"]


def test_pairs_responses_with_expectations(spark):
    responses = spark.createDataFrame([(1, 200, '{"approved":true,"fraud_score":0.0}', 1.0), (2, 400, '{"error":"bad_request"}', 2.0)], "qid long, status int, body string, latency_ms double")
    expected = spark.createDataFrame([(1, True), (2, False), (3, True)], "qid long, expected_approved boolean")
    got = {r["qid"]: (r["expected_approved"], r["approved"], r["status"]) for r in evaluate.pair(responses, expected).collect()}
    assert got == {1: (True, True, 200), 2: (False, None, 400), 3: (True, None, 0)}


def test_approximate_p99_is_within_its_rank(spark):
    rows = spark.range(20_000).select(F.lit(True).alias("expected_approved"), F.lit(True).alias("approved"), F.lit(200).alias("status"), F.col("id").cast("double").alias("latency_ms"))
    assert abs(evaluate.confusion(rows, accuracy=1000).first()["p99_ms"] - 19_800) <= 20
