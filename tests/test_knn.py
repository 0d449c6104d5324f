import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scorelane.operators import knn, score
from scorelane.operators.blocks import best, candidates, exact, exact_single
from scorelane.scratch import Scratch

NAMES = ["v0", "v1"]


def refs(spark, rows):
    return spark.createDataFrame(rows, "ref_id long, cluster int, pos long, v0 float, v1 float, is_fraud boolean")


def ask(spark, *points):
    return spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "qid long, v0 float, v1 float")


def ids(df):
    out = {}
    for r in df.orderBy("qid", "rank").collect():
        out.setdefault(r["qid"], []).append(r["ref_id"])
    return out


def admit(k, scan):
    """Plain model of a bounded list that takes strictly nearer items and puts equal ones behind."""
    best = []
    for d, i in scan:
        if len(best) == k and d >= best[-1][0]:
            continue
        at = next((j for j, (x, _) in enumerate(best) if d < x), len(best))
        best.insert(at, (d, i))
        del best[k:]
    return best


def test_tie_orders_follow_a_plain_model(spark):
    random.seed(3)
    rows = [(i, 0, 0, float(random.randint(0, 2)), float(random.randint(0, 2)), False) for i in range(60)]
    cents = [(c, float(random.randint(0, 2)), float(random.randint(0, 2))) for c in range(4)]
    near = lambda r: min((((r[3] - x) ** 2 + (r[4] - y) ** 2), c) for c, x, y in cents)[1]
    rows = sorted(((i, near(r)) + r[2:] for i, r in enumerate(rows)), key=lambda r: (r[1], r[0]))
    rows = [(r[0], r[1], pos, *r[3:]) for pos, r in enumerate(rows)]
    points = [(float(x), float(y)) for x in range(3) for y in range(3)]
    dist = lambda q, r: (q[0] - r[3]) ** 2 + (q[1] - r[4]) ** 2
    table, asked = refs(spark, rows), ask(spark, *points)
    centroids = spark.createDataFrame(cents, "cluster int, v0 float, v1 float")
    brute = ids(knn.brute(asked, table, NAMES))
    f32, f16 = (ids(knn.ivf(asked, table, centroids, NAMES, nprobe=3, dtype=t)) for t in ("f32", "f16"))
    for q, point in enumerate(points):
        assert brute[q] == [i for _, i in admit(5, [(dist(point, r), r[0]) for r in rows])]
        probes = sorted(cents, key=lambda c: ((c[1] - point[0]) ** 2 + (c[2] - point[1]) ** 2, c[0]))[:3]
        lists = [[(dist(point, r), r[0]) for r in rows if r[1] == c[0]] for c in probes]
        assert f32[q] == [i for _, i in admit(5, [x for each in lists for x in each])]
        assert f16[q] == [i for _, i in admit(5, [x for each in lists for x in reversed(admit(5, each))])]


def test_all_probes_equal_brute_force_and_bounds_of_nprobe(spark):
    random.seed(4)
    rows = [(i, i % 5, i, random.random(), random.random(), i % 3 == 0) for i in range(100)]
    centroids = spark.createDataFrame([(c, random.random(), random.random()) for c in range(5)], "cluster int, v0 float, v1 float")
    asked = ask(spark, (0.5, 0.5), (0.1, 0.9))
    table = refs(spark, rows)
    assert ids(knn.ivf(asked, table, centroids, NAMES, nprobe=5)) == ids(knn.brute(asked, table, NAMES))
    count = lambda n: knn.probes(asked, centroids, NAMES, nprobe=n).count() // 2
    assert (count(0), count(3), count(1000)) == (1, 3, 5)


def test_few_references_and_queries_without_any(spark):
    asked = ask(spark, (0.0, 0.0), (1.0, 1.0))
    table = refs(spark, [(0, 0, 0, 0.0, 0.0, True), (1, 0, 1, 1.0, 1.0, True), (2, 0, 2, 1.0, 0.0, True)])
    votes = {r["qid"]: (r["frauds"], r["fraud_score"], r["approved"]) for r in score.vote(asked, knn.brute(asked, table, NAMES)).collect()}
    assert votes == {0: (3, 0.6, False), 1: (3, 0.6, False)}
    none = score.vote(asked, knn.brute(asked, table.where("false"), NAMES))
    assert {r["frauds"] for r in none.collect()} == {0}
    assert knn.brute(asked.where("false"), table, NAMES).count() == 0


def test_many_queries_give_the_same_by_blocks(spark, monkeypatch):
    random.seed(7)
    rows = [(i, i % 4, i, float(random.randint(0, 9)), random.random(), i % 3 == 0) for i in range(300)]
    asked, table = ask(spark, *[(float(i % 10), 0.5) for i in range(40)]), refs(spark, rows)
    centroids = spark.createDataFrame([(c, 3.0 * c, 0.5) for c in range(4)], "cluster int, v0 float, v1 float")
    plans = [lambda: knn.brute(asked, table, NAMES), lambda: knn.brute(asked, table, NAMES, not_self="ref_id"), *(lambda t=t: knn.ivf(asked, table, centroids, NAMES, nprobe=2, dtype=t) for t in ("f16", "f32"))]
    whole = [ids(p()) for p in plans]
    assert all(len(w) == 40 for w in whole)
    monkeypatch.setattr(knn, "MOST_QUERIES", 7)
    monkeypatch.setattr(knn, "BLOCK", 50)
    assert [ids(p()) for p in plans] == whole


def test_single_precision_ranks_by_the_kernel_sum(spark):
    rng = np.random.default_rng(3)
    names = [f"v{i}" for i in range(14)]
    near = rng.random(14).astype(np.float32)
    x = (near + rng.choice([-1, 1], (400, 14)) * np.float32(0.01) + rng.normal(size=(400, 14)) * 1e-9).astype(np.float32)
    table = spark.createDataFrame([(i, 0, i, False, *map(float, r)) for i, r in enumerate(x)], "ref_id long, cluster int, pos long, is_fraud boolean, " + ", ".join(f"{n} float" for n in names))
    asked = spark.createDataFrame([(0, *map(float, near))], "qid long, " + ", ".join(f"{n} float" for n in names))
    dist = exact_single(np.broadcast_to(near, x.shape), x)
    assert ids(knn.brute(asked, table, names, single_precision=True))[0] == np.lexsort((np.arange(400), dist))[:5].tolist()


def test_single_matches_brute(spark):
    asked, table = ask(spark, (3.2, 0.0)), refs(spark, [(i, 0, i, float(i), 0.5, False) for i in range(20)])
    assert [r["ref_id"] for r in knn.single(asked, table, NAMES).collect()] == ids(knn.brute(asked, table, NAMES))[0]


def test_recall(spark):
    true = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (1, 4)], "qid long, ref_id long")
    found = spark.createDataFrame([(0, 1), (0, 9), (1, 3), (1, 4)], "qid long, ref_id long")
    assert knn.recall(found, true).first().asDict() == {"queries": 2, "hits": 3, "recall": pytest.approx(0.75)}


def test_references_stay_and_k_is_cut_before_the_shuffle(spark):
    asked, table = ask(spark, (0.0, 0.0)), refs(spark, [(0, 0, 0, 0.0, 0.0, True)])
    plan = knn.brute(asked, table, NAMES)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "WindowGroupLimit" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_null_vectors_rank_last(spark):
    refs = spark.createDataFrame([(i, i, False, float(i) if i >= 8 else None) for i in range(40)], "ref_id long, pos long, is_fraud boolean, v0 double")
    asked = spark.createDataFrame([(100, 7.5)], "qid long, v0 double")
    assert [r["ref_id"] for r in knn.brute(asked, refs, ["v0"]).orderBy("rank").collect()] == [8, 9, 10, 11, 12]
    few = refs.where("ref_id < 10")
    assert [r["ref_id"] for r in knn.brute(asked, few, ["v0"]).orderBy("rank").collect()] == [8, 9, 0, 1, 2]


def test_probes_make_no_row_per_query_and_centroid(spark):
    rng = np.random.default_rng(4)
    x, c = rng.integers(0, 3, (50, 3)).astype(float), rng.integers(0, 3, (20, 3)).astype(float)
    asked = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(x)] + [(50, None, 1.0, 1.0)], "qid long, v0 float, v1 float, v2 float")
    cents = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(c)], "cluster int, v0 float, v1 float, v2 float")
    got = knn.probes(asked, cents, ["v0", "v1", "v2"], nprobe=4)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()
    want = {i: [j for _, j in sorted((((p - q) ** 2).sum(), j) for j, q in enumerate(c))[:4]] for i, p in enumerate(x)} | {50: [0, 1, 2, 3]}
    rows = sorted(got.collect(), key=lambda r: (r["qid"], r["probe_rank"]))
    assert [(r["qid"], r["cluster"], r["probe_rank"]) for r in rows] == [(q, j, k + 1) for q, js in want.items() for k, j in enumerate(js)]
    assert {r["q_v1"] for r in rows if r["qid"] == 7} == {x[7][1]}


def test_bounds_leave_out_clusters_and_no_rows(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.integers(0, 8, (900, 2)) / 4, rng.random((900, 2)) * 2]).astype(np.float32)
    cents = (rng.random((30, 2)) * 2).astype(np.float32)
    off = cents + rng.normal(size=cents.shape) * 0.03  # rows keep the clusters of centroids that have moved since
    of = ((x[:, None].astype(float) - off[None]) ** 2).sum(2).argmin(1)
    order = np.argsort(of, kind="stable")
    table = refs(spark, [(int(i), int(of[i]), pos, float(x[i, 0]), float(x[i, 1]), bool(i % 3 == 0)) for pos, i in enumerate(order)])
    centroids = spark.createDataFrame([(c, float(p), float(q)) for c, (p, q) in enumerate(cents)], "cluster int, v0 float, v1 float")
    asked = spark.createDataFrame([(i, float(p), float(q)) for i, (p, q) in enumerate(x[::3])], "qid long, v0 float, v1 float")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    for dtype, me in (("f16", None), ("f32", "ref_id")):
        scratch = Scratch(spark, "test-bounds")
        bounded = rows(knn.ivf(asked, table, centroids, NAMES, nprobe=12, dtype=dtype, not_self=me, scratch=scratch))
        assert bounded == rows(knn.ivf(asked, table, centroids, NAMES, nprobe=12, dtype=dtype, not_self=me))
        assert spark.read.parquet(f"{scratch.root}/more").count() < 600 * 11 / 2
        scratch.drop()
    for me in (None, "ref_id"):
        scratch = Scratch(spark, "test-clusters")
        assert rows(knn.brute_by_clusters(asked, table, centroids, NAMES, scratch, not_self=me)) == rows(knn.brute(asked, table, NAMES, not_self=me))
        assert spark.read.parquet(f"{scratch.root}/more").count() < 600 * 29 / 2
        scratch.drop()


def test_products_of_single_precision_leave_no_neighbour_out():
    rng = np.random.default_rng(8)
    for scale, shift in ((1, 0), (1e-20, 0), (1e6, 1e6), (1e20, 0)):
        p, q = scale * rng.integers(0, 4, (700, 6)) + shift, scale * rng.random((90, 6)) * 3 + shift
        every = np.stack([exact(q, np.broadcast_to(r, q.shape)) for r in p], 1)
        want = [np.lexsort((np.arange(700), d))[:5].tolist() for d in every]
        for most in (None, np.sort(every, 1)[:, 4]):
            i, j = (np.concatenate(c) for c in zip(*candidates(q, p, 5, most=most), strict=True))
            some = best(5, i, exact(q[i], p[j]), j)
            assert [j[some][i[some] == n].tolist() for n in range(90)] == want
