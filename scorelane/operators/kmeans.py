"""k-means for the inverted file: the rows stay distributed, only the centroids come to the driver."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from scorelane.functions.math_expr import half
from scorelane.operators.blocks import CHUNK, IN_CACHE, best, candidates, cluster_points, columns, exact, halves, lifted, rounding, single_able

STRETCH = 65_536
PAIRS_PER_TASK = 10_000_000  # rows and centroids that are worth a task in a round
MOST_PAIRS = 250_000_000  # that one task compares, where there are more tasks than cores
ROWS_PER_SPLIT = 500_000
ROWS_PER_BLOB = 16_384
MASK = (1 << 64) - 1


def splitmix64(seed: int) -> Iterator[int]:
    """The public SplitMix64 sequence."""
    state = seed & MASK
    while True:
        state = (state + 0x9E3779B97F4A7C15) & MASK
        z = ((state ^ (state >> 30)) * 0xBF58476D1CE4E5B9) & MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & MASK
        yield z ^ (z >> 31)


def first_rows(count: int, nlist: int, seed: int) -> list[int]:
    """nlist distinct row numbers below count, in the order drawn."""
    if nlist > count:
        raise ValueError(f"{nlist} clusters need as many rows; there are {count}")
    drawn: dict[int, None] = {}
    draws = splitmix64(seed)
    while len(drawn) < nlist:
        drawn.setdefault(next(draws) % count)
    return list(drawn)


def assign(refs: DataFrame, centroids: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """ref_id, the kept columns, cluster, dist: the nearest centroid of each row, ties to the smaller cluster.

    Centroids are few (MOST_CENTROIDS at most) and go to every task. Rows are compared with all of them in blocks of arrays: a
    matrix product leaves those that can be nearest, which are summed exactly, in double precision from left to right. There is
    neither a shuffle nor a row per pair.
    """
    number, points = cluster_points(centroids, names)
    kept = refs.select("ref_id", *keep)
    rows = refs.select("ref_id", *keep, *[F.col(n).cast("double").alias(f"_{n}") for n in names])
    kind = centroids.schema["cluster"].dataType
    schema = T.StructType([*kept.schema.fields, T.StructField("cluster", kind), T.StructField("dist", T.DoubleType())])
    lead = len(kept.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            near, least = nearest(columns(b, [f"_{n}" for n in names]), points)
            cluster = number[near] if len(points) else np.zeros(len(b), np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns[:lead], pa.array(cluster).cast(to_arrow_type(kind)), pa.array(least)], names=schema.names)

    return rows.mapInArrow(run, schema)


def nearest(x: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the number of the nearest point, ties to the lesser, and its squared distance. Most rows have one point alone that
    can be nearest by a matrix product in single precision; the others compare exactly."""
    near, least = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
    if not len(points):
        return near, least
    open_ = np.ones(len(x), bool)
    if len(x) and single_able(x, points):
        own = (x * x).sum(1)
        slack = rounding(own, float((points * points).sum(1).max()), x.shape[1])
        flat, wide, chunk = lifted(x), np.ascontiguousarray(halves(points).T), max(1, min(CHUNK, IN_CACHE // len(points)))
        for at in range(0, len(x), chunk):
            far = flat[at : at + chunk] @ wide
            each, here = np.arange(len(far)), far.argmin(1)
            edge = far[each, here] + slack[at : at + chunk]
            far[each, here] = np.inf
            near[at : at + chunk], open_[at : at + chunk] = here, far.min(1) <= edge
        least[:] = exact(x, points[near])
    rows = np.flatnonzero(open_)
    near[rows], least[rows] = 0, np.inf
    for i, j in candidates(x[rows], points, 1):
        dist = exact(x[rows[i]], points[j])
        some = best(1, i, dist, j)
        near[rows[i[some]]], least[rows[i[some]]] = j[some], dist[some]
    return near, least


def means(assigned: DataFrame, names: Sequence[str]) -> DataFrame:
    """cluster, n and the mean of each column, summed in double precision and rounded to single."""
    return assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), *[F.avg(F.col(n).cast("double")).cast("float").alias(n) for n in names])


def update(centroids: DataFrame, means_: DataFrame, names: Sequence[str]) -> DataFrame:
    """Clusters without rows keep their centroid; with the largest change of any coordinate of each."""
    old, new = centroids.alias("o"), means_.alias("m")
    joined = old.join(new, F.col("o.cluster") == F.col("m.cluster"), "left")
    value = {n: F.coalesce(F.col(f"m.{n}"), F.col(f"o.{n}")) for n in names}
    changes = [F.abs(value[n].cast("double") - F.col(f"o.{n}").cast("double")) for n in names]
    change = F.greatest(*changes) if len(changes) > 1 else changes[0]
    return joined.select(F.col("o.cluster").alias("cluster"), F.coalesce(F.col("m.n"), F.lit(0)).cast("long").alias("n"), *[v.alias(n) for n, v in value.items()], change.alias("change"))


@dataclass
class Trained:
    centroids: list[Row]  # cluster and coordinates after the last update
    before: list[Row]  # those of the last assignment, made before that update; none without any step
    iters: int
    max_change: float

    def assigned(self, refs: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
        """ref_id, the kept columns, cluster by the last assignment step; without any step all rows are in cluster 0."""
        if not self.before:
            return refs.select("ref_id", *keep, F.lit(0).alias("cluster"))
        schema = "cluster int, " + ", ".join(f"{n} float" for n in names)
        return assign(refs, refs.sparkSession.createDataFrame(self.before, schema), names, keep).drop("dist")


def blobs(refs: DataFrame, names: Sequence[str]) -> DataFrame:
    """The columns in their precision, ROWS_PER_BLOB rows to a row of bytes, for rounds that read them again and again."""
    kind, name = _kind(refs, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for b in batches:
            held.append(columns(b, names).astype(kind))
            if sum(map(len, held)) >= ROWS_PER_BLOB:
                yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(held).tobytes()])], names=["x"])
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(held).tobytes()])], names=["x"])

    return refs.select(*[F.col(c).cast(name).alias(c) for c in names]).mapInArrow(run, "x binary")


def _kind(refs: DataFrame, names: Sequence[str]) -> tuple[type, str]:
    return (np.float32, "float") if all(isinstance(refs.schema[n].dataType, T.FloatType) for n in names) else (np.float64, "double")


def step(packed: DataFrame, names: Sequence[str], points: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Rows and column sums of each point's cluster, of the rows in blobs. Tasks add up their own rows, so at most a row per cluster and
    task is shuffled."""
    sums = ", ".join(f"{n} double" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(len(points), np.int64), np.zeros(points.shape)
        for b in batches:
            for blob in b.column(0):
                x = np.frombuffer(blob.as_buffer(), kind).reshape(-1, len(names)).astype(float)
                near, _ = nearest(x, points)
                n += np.bincount(near, minlength=len(points))
                for i in range(len(names)):
                    total[:, i] += np.bincount(near, x[:, i], len(points))
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), *(pa.array(total[some, i]) for i in range(len(names)))], names=["cluster", "n", *names])

    parts = packed.mapInArrow(run, f"cluster int, n long, {sums}")
    n, total = np.zeros(len(points), np.int64), np.zeros(points.shape)
    for r in parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names]).collect():
        n[r["cluster"]], total[r["cluster"]] = r["n"], [r[c] for c in names]
    return n, total


def train(refs: DataFrame, names: Sequence[str], nlist: int, max_iter: int = 30, tol: float = 0.0005, seed: int = 42) -> Trained:
    """refs: ref_id from 0 without gaps, and the columns in names: persist or write it first. Clusters without rows keep their
    centroid. Training ends once no coordinate moves by tol."""
    drawn = first_rows(refs.count(), nlist, seed)
    at = {r["ref_id"]: r for r in refs.where(F.col("ref_id").isin(drawn)).collect()} if nlist else {}
    now = np.array([[at[d][n] for n in names] for d in drawn], np.float32).reshape(nlist, len(names))
    before, iters, change = None, 0, float("inf") if nlist else 0.0
    packed, kind = blobs(refs, names).persist(), _kind(refs, names)[0]
    while iters < max_iter and nlist:
        n, total = step(packed, names, now.astype(float), kind)
        new = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], now).astype(np.float32)
        change, before, now, iters = float(np.abs(new.astype(float) - now).max()), now, new, iters + 1
        if change < tol:
            break
    packed.unpersist()
    rows = lambda x: [] if x is None else [Row("cluster", *names)(i, *map(float, r)) for i, r in enumerate(x)]
    return Trained(rows(now), rows(before), iters, change)


def clustered(assigned: DataFrame) -> DataFrame:
    """assigned (ref_id, cluster and others) with pos, its place in the order of (cluster, ref_id). Rows are numbered within
    stretches of STRETCH ids of a cluster, so no task sorts a whole cluster."""
    from pyspark.sql import Window

    part = assigned.withColumn("_part", F.floor(F.col("ref_id") / STRETCH))
    within = F.row_number().over(Window.partitionBy("cluster", "_part").orderBy("ref_id"))
    n = part.groupBy("cluster", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("cluster").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    every = n.groupBy("cluster").agg(F.sum("_n").alias("_all"))
    start = F.coalesce(F.sum("_all").over(Window.orderBy("cluster").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = n.select("cluster", "_part", before.alias("_before")).join(every.select("cluster", start.alias("_start")), "cluster")
    placed = part.withColumn("_w", within).join(starts, ["cluster", "_part"])
    return placed.select(*assigned.columns, (F.col("_start") + F.col("_before") + F.col("_w") - 1).alias("pos"))


def sizes(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


def offsets(assigned: DataFrame, clusters: DataFrame | None = None) -> DataFrame:
    """cluster, n, start: running sums of the sizes; clusters lists those to have, empty ones among them. There are at most as
    many rows as clusters."""
    from pyspark.sql import Window

    n = sizes(assigned)
    if clusters is not None:
        n = clusters.select("cluster").distinct().join(n, "cluster", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    before = F.sum("n").over(Window.orderBy("cluster").rowsBetween(Window.unboundedPreceding, -1))
    return n.select("cluster", "n", F.coalesce(before, F.lit(0)).alias("start"))


def quantised(df: DataFrame, names: Sequence[str], dtype: str) -> DataFrame:
    return df.withColumns({n: half(F.col(n)) if dtype == "f16" else F.col(n).cast("float") for n in names})
