import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelane.functions import time_expr
from scorelane.functions.math_expr import clamp01, half, squared_distance, squared_distance_f32
from scorelane.operators import features, payloads


def body(amount=41.12, installments=2, at="2026-03-11T18:45:53Z", avg=82.24, n=3, known=("MERC-003", "MERC-016"), merchant="MERC-016", mcc="5411", m_avg=60.25, online=False, card=True, km=29.23, last=None, **more):
    out = {
        "id": "tx-1",
        "transaction": {"amount": amount, "installments": installments, "requested_at": at},
        "customer": {"avg_amount": avg, "tx_count_24h": n, "known_merchants": list(known)},
        "merchant": {"id": merchant, "mcc": mcc, "avg_amount": m_avg},
        "terminal": {"is_online": online, "card_present": card, "km_from_home": km},
        "last_transaction": last,
    }
    return out | more


def vectors(spark, *requests):
    rows = [(i, r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(requests)]
    df = features.vectorize(payloads.validate(spark.createDataFrame(rows, "qid int, body string")))
    return [(r["status"], [r[n] for n in features.NAMES]) for r in df.orderBy("qid").collect()]


LEGIT = [0.004112, 0.16667, 0.05, 0.7826, 0.3333, -1, -1, 0.02923, 0.15, 0, 1, 0, 0.15, 0.006025]
FRAUD = [0.9506, 0.8333, 1.0, 0.2174, 0.8333, -1, -1, 0.9523, 1, 0, 1, 1, 0.75, 0.005486]


def test_golden_vectors(spark):
    fraud = body(9505.97, 10, "2026-03-14T05:15:12Z", 81.28, 20, ("MERC-008", "MERC-007", "MERC-005"), "MERC-068", "7802", 54.86, km=952.27)
    (s1, legit), (s2, denied) = vectors(spark, body(), fraud)
    assert (s1, s2) == (200, 200)
    assert legit == pytest.approx(LEGIT, abs=1e-3)
    assert denied == pytest.approx(FRAUD, abs=1e-3)


def test_edges_of_features(spark):
    before = {"timestamp": "2026-03-11T17:15:53Z", "km_from_current": 500}
    after = {"timestamp": "2026-03-12T00:00:00Z", "km_from_current": 5000}
    missing = body()
    del missing["last_transaction"]
    out = vectors(spark, body(mcc="9999", known=()), body(last=before), body(last=after), body(avg=0), body(avg=-1), body(amount=-5), body(amount=1e39), body(at="2026-03-11T99:00:00+05:00"), missing, body(installments=2.5))
    assert all(s == 200 for s, _ in out)
    v = [x for _, x in out]
    assert (v[0][12], v[0][11]) == (0.5, 1.0)
    assert v[1][5:7] == pytest.approx([0.0625, 0.5])
    assert v[2][5:7] == [0.0, 1.0]
    assert v[3][2] == v[4][2] == 1.0
    assert (v[5][0], v[6][0]) == (0.0, 1.0)
    assert v[7][3] == pytest.approx(99 / 23)
    assert v[8][5:7] == [-1.0, -1.0]
    assert v[9][1] == pytest.approx(2.5 / 12)


@pytest.mark.parametrize(
    "bad",
    [
        "",
        "{",
        "null",
        "[]",
        json.dumps(body(at="2026-03-11T18:45:53")),
        json.dumps(body(at="2026-13-11T18:45:53Z")),
        json.dumps(body(at="2026-00-11T18:45:53Z")),
        json.dumps(body(at="2026/03/11T18:45:53Z")),
        json.dumps(body(amount="12")),
        json.dumps(body(amount=None)),
        json.dumps(body(known=("M", None))),
        json.dumps(body(last={"timestamp": "2026-03-11T17:15:53Z"})),
        json.dumps(body(last={"timestamp": "yesterday", "km_from_current": 1})),
        json.dumps(body(terminal=None)),
    ],
)
def test_rejects(spark, bad):
    ((status, vector),) = vectors(spark, bad)
    assert status == 400
    assert vector == [None] * 14


def test_strict_mode_rejects_what_the_lenient_parser_coerces(spark):
    whole = json.dumps(body())
    rows = [whole, whole + " x", json.dumps(body(merchant=7)), whole[:-1] + ', "id": "again"}']
    df = spark.createDataFrame([(r,) for r in rows], "body string")
    assert [r["status"] for r in payloads.validate(df, is_strict=False).collect()] == [200] * 4
    assert [r["status"] for r in payloads.validate(df).collect()] == [200, 400, 400, 400]


def test_unknown_fields_are_ignored_and_ids_are_optional(spark):
    one = body(extra={"a": 1})
    del one["id"]
    assert vectors(spark, one)[0][0] == 200


def test_time(spark):
    days = {"2026-03-11T00:00:00Z": 2, "2026-03-14T00:00:00Z": 5, "2024-01-01T00:00:00Z": 0, "2023-12-31T00:00:00Z": 6, "2026-02-31T00:00:00Z": 1}
    df = spark.createDataFrame([(k,) for k in days], "t string")
    assert {r[0]: r[1] for r in df.select("t", time_expr.weekday(F.col("t"))).collect()} == days
    seconds = spark.createDataFrame([("2026-02-31T01:02:03.9+05:00",), ("2026-03-03T01:02:03Z",), ("1969-12-31T23:59:59Z",)], "t string").select(time_expr.epoch_seconds(F.col("t")))
    a, b, c = [r[0] for r in seconds.collect()]
    assert (a, c) == (b, -1)


def test_clamp_and_half(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(0, 1, 2000), rng.normal(0, 1e-6, 2000), 2.0 ** rng.integers(-24, 15, 500), [0, -0.0, 65504, 6e-8, 2049, 2051]]).astype(np.float32)
    df = spark.createDataFrame([(float(v),) for v in x], "x double").select(F.col("x").cast("float").alias("x"))
    got = np.array([r[0] for r in df.select(half(F.col("x"))).collect()], np.float32)
    assert (got == x.astype(np.float16).astype(np.float32)).all()
    c = spark.createDataFrame([(v,) for v in (math.nan, math.inf, -math.inf, 0.5, -1.0, 2.0)], "x double").select(clamp01(F.col("x").cast("float")))
    assert [r[0] for r in c.collect()] == [0, 1, 0, 0.5, 0, 1]


def test_distances(spark):
    rng = np.random.default_rng(2)
    a, b = rng.random((200, 14), np.float32), rng.random((200, 14), np.float32)
    rows = [(i, *map(float, x), *map(float, y)) for i, (x, y) in enumerate(zip(a, b, strict=True))]
    names = [f"{s}{i}" for s in "ab" for i in range(14)]
    df = spark.createDataFrame(rows, "i int, " + ", ".join(f"{n} float" for n in names))
    left, right = [F.col(f"a{i}") for i in range(14)], [F.col(f"b{i}") for i in range(14)]
    got = df.orderBy("i").select(squared_distance(left, right), squared_distance_f32(left, right)).collect()
    exact = ((a.astype(float) - b.astype(float)) ** 2)
    assert [r[0] for r in got] == pytest.approx(exact.sum(1).tolist(), abs=1e-12)
    d = np.zeros((200, 16), np.float32)
    d[:, :14] = a - b
    lane = (d[:, 8:].astype(float) ** 2 + (d[:, :8] * d[:, :8]).astype(float)).astype(np.float32)
    four = lane[:, :4] + lane[:, 4:]
    assert [r[1] for r in got] == ((four[:, 0] + four[:, 1]) + (four[:, 2] + four[:, 3])).tolist()


def test_a_filter_on_the_status_parses_bodies_once(spark):
    rows = spark.createDataFrame([(0, json.dumps(body())), (1, "{}")], "qid long, body string")
    vectors = features.vectorize(payloads.validate(rows).where("status = 200"))
    assert vectors._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
    assert [r["qid"] for r in vectors.collect()] == [0]
