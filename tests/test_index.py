import gzip
import json
import random
import struct

import numpy as np
import pytest

from scorelane.config import BuildConfig, Config, Limits
from scorelane.operators import kmeans
from scorelane.plans.build import build_index
from scorelane.plans.scoring import score_requests
from scorelane.scratch import Scratch
from scorelane.sources import index as index_source
from scorelane.sources.references import read_references
from scorelane.sources.requests import read_requests, read_test_entries, stream_requests
from scorelane.streaming.score_stream import score_stream
from tests.test_features import body

NAMES = [f"v{i}" for i in range(14)]
SCHEMA = "ref_id long, " + ", ".join(f"{n} float" for n in NAMES) + ", is_fraud boolean"


def make(spark, n, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.random((n, 14)).astype(np.float32)
    return x, spark.createDataFrame([(i, *map(float, r), i % 3 == 0) for i, r in enumerate(x)], SCHEMA)


def plain_kmeans(x, nlist, max_iter, tol, seed):
    c = x[kmeans.first_rows(len(x), nlist, seed)].copy()
    of, iters = np.zeros(len(x), int), 0
    for _ in range(max_iter):
        of = np.array([min((((p.astype(float) - q.astype(float)) ** 2).sum(), j) for j, q in enumerate(c))[1] for p in x])
        new = np.array([x[of == j].astype(float).mean(0) if (of == j).any() else c[j] for j in range(nlist)]).astype(np.float32)
        change, c, iters = np.abs(new - c).max(), new, iters + 1
        if change < tol:
            break
    return c, of, iters


def test_training_follows_a_plain_version(spark):
    x, refs = make(spark, 300)
    c, of, iters = plain_kmeans(x, 7, 6, 0.0005, 42)
    got = kmeans.train(refs, NAMES, 7, 6, 0.0005, 42)
    assert got.iters == iters
    assert [r["cluster"] for r in got.assigned(refs, NAMES).orderBy("ref_id").collect()] == of.tolist()
    assert np.array([[r[n] for n in NAMES] for r in got.centroids]) == pytest.approx(c, abs=1e-6)


def test_training_edges(spark):
    _, refs = make(spark, 20)
    with pytest.raises(ValueError):
        kmeans.train(refs, NAMES, 21)
    none = kmeans.train(refs, NAMES, 3, max_iter=0)
    assert {r["cluster"] for r in none.assigned(refs, NAMES).collect()} == {0}
    old = spark.createDataFrame([(0, 0.0), (1, 5.0)], "cluster int, v0 float")
    moved = {r["cluster"]: (r["n"], r["v0"], r["change"]) for r in kmeans.update(old, spark.createDataFrame([(0, 2, 1.0)], "cluster int, n long, v0 float"), ["v0"]).collect()}
    assert moved == {0: (2, 1.0, 1.0), 1: (0, 5.0, 0.0)}
    with pytest.raises(ValueError):
        BuildConfig(dtype="f64")


def test_splitmix_is_the_public_sequence():
    draws = kmeans.splitmix64(1234567)
    assert [next(draws) for _ in range(3)] == [6457827717110365317, 3203168211198807973, 9817491932198370423]


def test_index_round_trip_and_summary(spark, tmp_path):
    x, refs = make(spark, 200)
    built = build_index(refs, BuildConfig(nlist=5, max_iter=3))
    path = f"file://{tmp_path}/index"
    assert not index_source.ready(spark, path)
    index_source.write_index(built, path, 3)
    back = index_source.read_index(spark, path)
    assert index_source.ready(spark, path)
    assert index_source.summary(back).first().asDict() == {"count": 200, "fraud": 67, "legit": 133}
    rows = back.refs.orderBy("pos").collect()
    assert [r["pos"] for r in rows] == list(range(200))
    assert [(r["cluster"], r["ref_id"]) for r in rows] == sorted((r["cluster"], r["ref_id"]) for r in rows)
    assert [[r[n] for n in NAMES] for r in rows] == x[[r["ref_id"] for r in rows]].astype(np.float16).astype(np.float32).tolist()
    assert back.meta.first()["nlist"] == 5
    flat = build_index(refs, BuildConfig(nlist=0, dtype="f32"))
    assert flat.centroids is None and flat.refs.where("pos <> ref_id").count() == 0


def test_places_do_not_depend_on_stretches(spark, monkeypatch):
    monkeypatch.setattr(kmeans, "STRETCH", 7)
    rows = [(i, i * i % 5, f"x{i}") for i in random.sample(range(100), 60)]
    got = kmeans.clustered(spark.createDataFrame(rows, "ref_id long, cluster int, more string")).collect()
    want = {r[0]: (pos, r[2]) for pos, r in enumerate(sorted(rows, key=lambda r: (r[1], r[0])))}
    assert {r["ref_id"]: (r["pos"], r["more"]) for r in got} == want


def test_nearest_points_with_ties_equal_all_distances():
    rng = np.random.default_rng(2)
    points = rng.integers(0, 3, (40, 5)).astype(float)
    x = np.concatenate([rng.integers(0, 3, (900, 5)).astype(float), rng.random((900, 5)), 1e6 + rng.random((50, 5))])
    near, least = kmeans.nearest(x, points)
    every = np.stack([kmeans.exact(x, np.broadcast_to(p, x.shape)) for p in points], 1)
    assert (near == every.argmin(1)).all() and (least == every.min(1)).all()


def test_offsets_list_empty_clusters(spark):
    assigned = spark.createDataFrame([(0, 2), (1, 0), (2, 2)], "ref_id long, cluster int")
    clusters = spark.createDataFrame([(i,) for i in range(4)], "cluster int")
    assert [tuple(r) for r in kmeans.offsets(assigned, clusters).orderBy("cluster").collect()] == [(0, 1, 0), (1, 0, 1), (2, 2, 1), (3, 0, 3)]


def binary(x, labels, dtype=1, nlist=2, version=2, flags=1, stride=16, magic=b"R26V"):
    kind = np.float16 if dtype == 1 else np.float32
    wide = np.zeros((len(x), stride), kind)
    wide[:, :14] = x
    cents = np.zeros((nlist, stride), kind)
    cents[:, :14] = x[:nlist]
    head = magic + struct.pack("<7I", version, len(x), 14, stride, dtype, nlist, flags)
    return head + wide.tobytes() + np.packbits(labels, bitorder="little").tobytes() + cents.tobytes() + np.array([0, 4, len(x)], "<u4").tobytes()


@pytest.mark.parametrize("dtype", [1, 2])
def test_binary_index(spark, tmp_path, dtype):
    x = np.random.default_rng(1).random((11, 14)).astype(np.float16)
    labels = np.arange(11) % 2 == 0
    (tmp_path / "i.bin").write_bytes(binary(x, labels, dtype) + b"trailing")
    got = index_source.read_binary(spark, f"file://{tmp_path}/i.bin")
    rows = got.refs.orderBy("pos").collect()
    assert [r["cluster"] for r in rows] == [0] * 4 + [1] * 7
    assert [r["is_fraud"] for r in rows] == labels.tolist()
    assert [[r[n] for n in NAMES] for r in rows] == x.astype(np.float32).tolist()
    assert got.centroids.count() == 2


@pytest.mark.parametrize("change", [{"magic": b"XXXX"}, {"version": 3}, {"dtype": 3}, {"stride": 14, "cut": 40}])
def test_binary_index_rejects(spark, tmp_path, change):
    cut = change.pop("cut", 0)
    content = binary(np.zeros((11, 14)), np.zeros(11, bool), **{k: v for k, v in change.items()})
    (tmp_path / "i.bin").write_bytes(content[: len(content) - cut])
    with pytest.raises(Exception):  # noqa: B017  on the driver, or from a task
        index_source.read_binary(spark, f"file://{tmp_path}/i.bin").refs.count()


def test_reference_reader(spark, tmp_path):
    random.seed(1)
    rows = [{"vector": [random.random() for _ in range(14)], "label": random.choice(["fraud", "legit", "Fraud"])} for _ in range(30)]
    with gzip.open(tmp_path / "r.json.gz", "wt") as f:
        json.dump(rows, f)
    got = read_references(spark, f"file://{tmp_path}/r.json.gz").orderBy("ref_id").collect()
    assert [r["ref_id"] for r in got] == list(range(30))
    assert [r["is_fraud"] for r in got] == [r["label"] == "fraud" for r in rows]
    with gzip.open(tmp_path / "bad.json.gz", "wt") as f:
        json.dump([{"vector": [1.0] * 13, "label": "fraud"}], f)
    with pytest.raises(Exception, match="components"):
        read_references(spark, f"file://{tmp_path}/bad.json.gz").collect()


def test_requests_end_to_end_and_as_a_stream(spark, tmp_path):
    _, refs = make(spark, 60)
    index = build_index(refs, BuildConfig(nlist=3, max_iter=2))
    (tmp_path / "in").mkdir()
    lines = [json.dumps(body()), "not json", json.dumps(body(amount=9000.0))]
    (tmp_path / "in/a.txt").write_text("\n".join(lines))
    asked = read_requests(spark, f"file://{tmp_path}/in").selectExpr("monotonically_increasing_id() as qid", "body")
    out = [tuple(r) for r in score_requests(asked, index, Config(nprobe=3)).orderBy("qid").select("status", "body").collect()]
    assert [s for s, _ in out] == [200, 400, 200]
    assert out[1][1] == '{"error":"bad_request"}'
    assert set(json.loads(out[0][1])) == {"approved", "fraud_score"}
    brute = score_requests(asked, index, Config(use_ivf=False)).orderBy("qid").collect()
    assert [r["body"] for r in brute] == [b for _, b in out]
    q = score_stream(stream_requests(spark, f"file://{tmp_path}/in"), index, f"file://{tmp_path}/out", f"file://{tmp_path}/cp", Config(nprobe=3), once=True)
    q.awaitTermination()
    streamed = {r["request"]: (r["status"], r["body"]) for r in spark.read.parquet(f"file://{tmp_path}/out/batch=0").collect()}
    assert streamed == {line: x for line, x in zip(lines, out, strict=True)}


def test_test_entries(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"stats": {"total": 2, "fraud_count": 1}, "entries": [{"request": body(), "expected_approved": True}, {"request": body(), "expected_approved": False}]}))
    entries, stats = read_test_entries(spark, f"file://{tmp_path}/t.json")
    assert [r["expected_approved"] for r in entries.orderBy("entry").collect()] == [True, False]
    assert stats.first()["total"] == 2


def test_config_from_environment():
    assert Config.from_env({}).use_ivf and Config.from_env({}).nprobe == 16
    assert Config.from_env({"USE_IVF": "ON"}).use_ivf
    assert not Config.from_env({"USE_IVF": "0"}).use_ivf
    assert Config.from_env({"NPROBE": "x"}).nprobe == 16


def test_config_from_files(tmp_path):
    (tmp_path / "m.json").write_text(json.dumps({"5411": 0.2}))
    limits = {f: i + 1 for i, f in enumerate(Limits.__dataclass_fields__)}
    (tmp_path / "n.json").write_text(json.dumps(limits))
    got = Config.from_files(tmp_path / "m.json", tmp_path / "n.json", nprobe=3)
    assert got.mcc_risk == {"5411": 0.2} and got.limits.max_installments == 2 and got.nprobe == 3
    (tmp_path / "n.json").write_text("{}")
    with pytest.raises(KeyError):
        Config.from_files(tmp_path / "m.json", tmp_path / "n.json")


def test_command_line(spark, tmp_path, capsys):
    from scorelane.__main__ import main

    rng = np.random.default_rng(5)
    rows = [{"vector": [float(x) for x in rng.random(14)], "label": "fraud" if i % 4 == 0 else "legit"} for i in range(50)]
    (tmp_path / "r.json").write_text(json.dumps(rows))
    (tmp_path / "t.json").write_text(json.dumps({"stats": {"total": 1}, "entries": [{"request": body(), "expected_approved": True}]}))
    (tmp_path / "q.txt").write_text(json.dumps(body()) + "\nbad")
    at = f"file://{tmp_path}"
    assert main(["build", "--input", f"{at}/r.json", "--output", f"{at}/i", "--ivf", "4", "--max-iter", "3"]) == 0
    assert main(["score", "--input", f"{at}/q.txt", "--index", f"{at}/i", "--output", f"{at}/o"]) == 0
    assert sorted(r["status"] for r in spark.read.parquet(f"{at}/o").collect()) == [200, 400]
    capsys.readouterr()
    assert main(["evaluate", "--input", f"{at}/t.json", "--index", f"{at}/i"]) == 0
    assert json.loads(capsys.readouterr().out)["counts"]["http_errors"] == 0
    with pytest.raises(SystemExit) as e:
        main(["build", "--input", "x", "--output", "y", "--dtype", "f64"])
    assert e.value.code == 2


def test_rows_of_one_partition_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(kmeans, "PAIRS_PER_TASK", 100)
    _, refs = make(spark, 200)
    built = build_index(refs.coalesce(1), BuildConfig(nlist=4, max_iter=2))
    assert built.cached[0].rdd.getNumPartitions() == 8
    assert [r["pos"] for r in built.refs.orderBy("pos").collect()] == list(range(200))
    built.release()


def test_written_requests_are_read_again(spark):
    _, refs = make(spark, 60)
    index = build_index(refs, BuildConfig(nlist=3, max_iter=2))
    asked = spark.createDataFrame([(i, json.dumps(body(amount=100.0 * i)) if i % 3 else "bad") for i in range(9)], "qid long, body string")
    scratch = Scratch(spark, "test-requests")
    once = score_requests(asked, index, Config(nprobe=3), scratch=scratch)
    assert "from_json" not in once._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(once.collect()) == sorted(score_requests(asked, index, Config(nprobe=3)).collect())
    scratch.drop()


def test_nearest_compares_exactly_where_the_product_cannot_tell():
    points = np.array([[1.0, 2.0], [1.0, 2.0], [1.0, 2.0 + 1e-13], [5.0, np.nan]])
    x = np.array([[1.0, 2.0 + 1e-13], [np.nan, 0.0], [1.0, 1.0]])
    assert kmeans.nearest(x[[0, 2]], points[:3])[0].tolist() == [2, 0]
    assert kmeans.nearest(x, points)[0].tolist() == [2, 0, 0]
