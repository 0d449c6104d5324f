"""Evaluation: confusion counts, tail latency, and composite scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Weights, cut-offs and floors of the scores.
MOST_P99_MS, MOST_FAILURES, CUT, LEAST_P99_MS, LEAST_ERROR, SCALE, PENALTY = 2000.0, 0.15, -3000.0, 1.0, 0.001, 1000.0, 300.0


def pair(responses: DataFrame, expected: DataFrame, qid: str = "qid") -> DataFrame:
    """Rows for confusion: responses (qid, status, body, latency_ms) beside expected (qid, expected_approved). A request
    without a response counts as an error."""
    said = responses.select(F.col(qid).alias("_q"), "status", F.from_json("body", "approved boolean")["approved"].alias("approved"), F.col("latency_ms").cast("double").alias("latency_ms"))
    met = expected.join(said, expected[qid] == said["_q"], "left")
    return met.select(qid, "expected_approved", "approved", F.coalesce("status", F.lit(0)).alias("status"), "latency_ms")


def confusion(scored: DataFrame, accuracy: int | None = None) -> DataFrame:
    """One row: tp, tn, fp, fn, err, total, p99_ms of rows (expected_approved, approved, status, latency_ms). A positive is a
    fraud, that is a denial. The exact p99 holds all distinct latencies in one task; with accuracy it is an observed latency whose
    rank is off by a share of 1 / accuracy at most, in bounded memory."""
    p99 = F.percentile("latency_ms", F.lit(0.99)) if accuracy is None else F.percentile_approx("latency_ms", 0.99, accuracy)
    ok, right = F.col("status") == 200, F.col("expected_approved") == F.col("approved")
    return scored.agg(
        F.count_if(ok & right & ~F.col("approved")).alias("tp"),
        F.count_if(ok & right & F.col("approved")).alias("tn"),
        F.count_if(ok & ~right & ~F.col("approved")).alias("fp"),
        F.count_if(ok & ~right & F.col("approved")).alias("fn"),
        F.count_if(~F.coalesce(ok, F.lit(False))).alias("err"),
        F.count(F.lit(1)).alias("total"),
        p99.alias("p99_ms"),
    )


def scores(counts: DataFrame) -> DataFrame:
    """counts with weighted_errors, failure_rate, error_rate, p99_score, detection_score and final_score."""
    weighted = F.col("fp") + 3 * F.col("fn") + 5 * F.col("err")
    share = lambda x: F.when(F.col("total") > 0, x / F.col("total")).otherwise(F.lit(0.0))
    out = counts.withColumns({"weighted_errors": weighted, "failure_rate": share(F.col("fp") + F.col("fn") + F.col("err")), "error_rate": share(weighted)})
    p99, eps = F.coalesce("p99_ms", F.lit(0.0)), F.col("error_rate")
    speed = F.when(p99 <= 0, F.lit(0.0)).when(p99 > MOST_P99_MS, F.lit(CUT)).otherwise(SCALE * F.log10(SCALE / F.greatest(p99, F.lit(LEAST_P99_MS))))
    cut = F.col("failure_rate") > MOST_FAILURES
    rate_part = F.when(~cut, SCALE * F.log10(1 / F.greatest(eps, F.lit(LEAST_ERROR))))
    absolute_part = F.when(~cut, -PENALTY * F.log10(1 + F.col("weighted_errors")))
    out = out.withColumns({"p99_score": speed, "rate_part": rate_part, "absolute_part": absolute_part})
    out = out.withColumn("detection_score", F.when(cut, F.lit(CUT)).otherwise(F.col("rate_part") + F.col("absolute_part")))
    return out.withColumn("final_score", F.col("p99_score") + F.col("detection_score"))


def rounded(scored: DataFrame) -> DataFrame:
    two = ["p99_ms", "p99_score", "rate_part", "absolute_part", "detection_score", "final_score"]
    return scored.withColumns({**{c: F.round(c, 2) for c in two}, "error_rate": F.round("error_rate", 6), "failure_rate": F.round("failure_rate", 6)})


def results_json(scored: DataFrame) -> DataFrame:
    """One row with the results as a JSON object."""
    df = rounded(scored)
    breakdown = F.struct("tp", "tn", "fp", "fn", F.col("err").alias("http_errors"))
    detection = F.struct("weighted_errors", "error_rate", "failure_rate", "rate_part", "absolute_part", F.col("detection_score").alias("score"))
    return df.select(F.to_json(F.struct(F.struct(F.col("p99_ms").alias("p99"), F.col("p99_score").alias("score")).alias("latency"), breakdown.alias("counts"), detection.alias("detection"), "final_score")).alias("results"))
