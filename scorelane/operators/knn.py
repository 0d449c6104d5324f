"""k nearest labelled vectors: by comparing all, or through an inverted file.

Rows are compared in blocks of arrays: a matrix product leaves those that can be among the k nearest, whose distances are then
summed exactly, in double precision from left to right. Each task keeps its k best of each query, so one shuffle of k rows a
query and task follows. Up to MOST_QUERIES queries go to every task, and the references stay where they are. More queries
are dealt into blocks, and each pair of a block of queries and a block of references is one task's work, in the same plan.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from scorelane.functions.math_expr import squared_distance
from scorelane.operators import kmeans
from scorelane.operators.blocks import best, by_group, candidates, cluster_points, columns, exact, exact_single
from scorelane.scratch import Scratch

MOST_QUERIES = 20_000  # that go to every task
MOST_BROADCAST = 20_000  # rows of a broadcast side
PAIRS_PER_TASK = 20_000_000
ROWS_PER_SPLIT = 500_000
BLOCK = 65_536  # references that meet a block of queries in one task
PIECE = 8_192  # references compared with queries at once
FOUND = [("probe_rank", T.IntegerType()), ("ref_id", T.LongType()), ("pos", T.LongType()), ("is_fraud", T.BooleanType()), ("dist", T.DoubleType())]


def spread(df: DataFrame, array: str, dims: int, prefix: str = "v") -> DataFrame:
    """An array column as single columns, which distances are computed on."""
    return df.withColumns({f"{prefix}{i}": F.get(F.col(array), F.lit(i)) for i in range(dims)}).drop(array)


def _distance(q: DataFrame, r: DataFrame, names: Sequence[str]) -> Column:
    return squared_distance([q[f"q_{n}"] for n in names], [r[n] for n in names])


def _as_queries(queries: DataFrame, qid: str, names: Sequence[str], *more: str) -> DataFrame:
    return queries.select(F.col(qid).alias("qid"), *more, *[F.col(n).alias(f"q_{n}") for n in names])


def _nearest(pairs: DataFrame, k: int, *order: Column) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(*order))
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k)


@dataclass
class _Best:
    """The k best of each (query, probe) among the rows met so far: arrays by number of query."""

    k: int
    single: bool = False
    parts: list[tuple] = field(default_factory=list)
    held: int = 0  # rows in parts, and those that the last look at all of them left
    kept: int = 0

    def add(self, asked: np.ndarray, points: np.ndarray, probe: np.ndarray, ref: dict[str, np.ndarray], x: np.ndarray, me: np.ndarray | None, most: np.ndarray | None = None) -> None:
        """asked, points, probe: numbers, vectors and probe ranks of queries; ref: columns of the rows of x; me: what each query's own row
        has as "self" there; most: the squared distance beyond which each query wants no rows."""
        for at in range(0, len(x), PIECE):
            self._add(asked, points, probe, {n: v[at : at + PIECE] for n, v in ref.items()}, x[at : at + PIECE], me, most)

    def _add(self, asked: np.ndarray, points: np.ndarray, probe: np.ndarray, ref: dict[str, np.ndarray], x: np.ndarray, me: np.ndarray | None, most: np.ndarray | None) -> None:
        for i, j in candidates(points, x, self.k + (me is not None), 1e-5 if self.single else 1e-9, most):
            apart = np.ones(len(i), bool) if me is None else ref["self"][j] != me[i]
            i, j = i[apart], j[apart]
            dist = (exact_single if self.single else exact)(points[i], x[j])
            if most is not None:
                near = ~(dist > most[i])
                i, j, dist = i[near], j[near], dist[near]
            some = best(self.k, i, dist, ref["pos"][j])
            i, j = i[some], j[some]
            self.parts.append((asked[i], probe[i], ref["ref_id"][j], ref["pos"][j], ref["is_fraud"][j], dist[some]))
            self.held += len(i)
            if self.held > 2 * self.kept + 200_000:
                self.parts = [self.all()]
                self.held = self.kept = len(self.parts[0][0])

    def all(self) -> tuple:
        if not self.parts:
            return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, bool), np.zeros(0))
        every = tuple(np.concatenate(c) for c in zip(*self.parts, strict=True))
        some = best(self.k, every[0] << 16 | every[1], every[5], every[3])
        return tuple(c[some] for c in every)

    def rows(self, qids: pa.Array | pa.ChunkedArray) -> pa.RecordBatch:
        qids = qids.combine_chunks() if isinstance(qids, pa.ChunkedArray) else qids
        asked, probe, *rest, dist = self.all()
        last = pa.array(dist, pa.float64(), from_pandas=True)  # NaN is null
        made = [qids.take(pa.array(asked, pa.int64())), pa.array(probe.astype(np.int32)), pa.array(rest[0], pa.int64()), pa.array(rest[1], pa.int64()), pa.array(rest[2].astype(bool)), last]
        return pa.RecordBatch.from_arrays(made, names=["qid", *(n for n, _ in FOUND)])


def _bounds(asked: pa.RecordBatch | pa.Table) -> np.ndarray:
    """The squared distance beyond which each query wants nothing; none is endless."""
    return np.nan_to_num(columns(asked, ["bound"])[:, 0], nan=np.inf, posinf=np.inf)


def _compare(refs: DataFrame, names: Sequence[str], asked: DataFrame, k: int, not_self: str | None, single_precision: bool) -> DataFrame:
    """The k nearest of each row of asked (qid, cluster, probe_rank, q_*, and bound if any) among the references of its cluster; -1: among
    all. Ties go by pos."""
    spark, q_names = refs.sparkSession, [f"q_{n}" for n in names]
    # Single precision stays so on its way; the arrays are double.
    single = all(refs.schema[n].dataType == asked.schema[f"q_{n}"].dataType == T.FloatType() for n in names)
    wide = [F.col(n).cast("float" if single else "double").alias(n) for n in names]
    kind = asked.schema["qid"].dataType
    schema = T.StructType([T.StructField("qid", kind), *(T.StructField(n, t) for n, t in FOUND)])
    own = (F.col(not_self) if not_self else F.lit(None)).cast(kind)
    in_clusters = "cluster" in refs.columns
    cluster = F.col("cluster").cast("int") if in_clusters else F.lit(-1)
    rows = refs.select(F.col("ref_id").cast("bigint").alias("ref_id"), F.col("pos").cast("bigint").alias("pos"), F.coalesce("is_fraud", F.lit(False)).alias("is_fraud"), own.alias("self"), cluster.alias("cluster"), *wide)
    bound = F.col("bound") if "bound" in asked.columns else F.lit(None)
    asked = asked.select("qid", F.col("cluster").cast("int").alias("cluster"), F.col("probe_rank").cast("int").alias("probe_rank"), bound.cast("double").alias("bound"), *[F.col(n).cast("float" if single else "double").alias(n) for n in q_names])
    rows, asked = rows.where("cluster is not null"), asked.where("cluster is not null")
    few = asked.limit(MOST_QUERIES + 1).toArrow()

    def ref_of(t: pa.Table | pa.RecordBatch) -> dict[str, np.ndarray]:
        return {c: t.column(c).to_numpy(zero_copy_only=False) for c in ("ref_id", "pos", "is_fraud", "self")}

    if len(few) <= MOST_QUERIES:
        (of, probe), qids = (few.column(c).to_numpy() for c in ("cluster", "probe_rank")), few.column("qid").combine_chunks()
        me = qids.to_numpy(zero_copy_only=False)
        points, most = columns(few, q_names), _bounds(few)
        probed = np.unique(of).tolist()
        by = {c: np.flatnonzero(of == c) for c in probed}
        if probed != [-1]:
            rows = rows.where(F.col("cluster").isin(probed))  # known clusters, so row groups of a sorted index are left out

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = _Best(k, single_precision)
            for b in batches:
                x, ref, at = columns(b, names), ref_of(b), b.column("cluster").to_numpy()
                for c in [-1] if probed == [-1] else np.unique(at).tolist():
                    here, who = np.arange(len(x)) if c == -1 else np.flatnonzero(at == c), by[c]
                    found.add(who, points[who], probe[who], {n: v[here] for n, v in ref.items()}, x[here], me[who] if not_self else None, most[who])
            yield found.rows(qids)

        if not len(few):
            return spark.createDataFrame([], schema)
        if probed == [-1]:
            # A table that is small for a scan, and so in few partitions, can still be much work.
            n = refs.count()
            tasks = min(4096, -(-n * len(few) // PAIRS_PER_TASK))
            rows = rows.repartition(tasks, "ref_id") if tasks > max(1, n // ROWS_PER_SPLIT) else rows
        return rows.mapInArrow(run, schema)

    clusters = rows.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    asks = asked.groupBy("cluster").agg(F.count(F.lit(1)).alias("m"))
    cut = clusters.join(asks, "cluster").select("cluster", F.ceil(F.col("n") / BLOCK).alias("rb"), F.ceil(F.col("m") / MOST_QUERIES).alias("qb"))
    # At most as many rows as clusters.
    cut = F.broadcast(cut)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    nothing = lambda kind: F.lit(None).cast(kind)
    left = rows.join(cut, "cluster").withColumn("b", F.pmod(F.xxhash64("ref_id"), F.col("rb"))).withColumn("c", each("qb"))
    left = left.select("cluster", "b", "c", F.lit(1).alias("role"), "ref_id", "pos", "is_fraud", "self", nothing(kind).alias("qid"), nothing("int").alias("probe_rank"), nothing("double").alias("bound"), *names)
    right = asked.join(cut, "cluster").withColumn("c", F.pmod(F.xxhash64("qid"), F.col("qb"))).withColumn("b", each("rb"))
    right = right.select("cluster", "b", "c", F.lit(0).alias("role"), nothing("bigint").alias("ref_id"), nothing("bigint").alias("pos"), nothing("boolean").alias("is_fraud"), nothing(kind).alias("self"), "qid", "probe_rank", "bound", *[F.col(f"q_{n}").alias(n) for n in names])

    def work(t: pa.Table) -> pa.RecordBatch:
        role = t.column("role").to_numpy()
        q, r = t.filter(pa.array(role == 0)), t.filter(pa.array(role == 1))
        found = _Best(k, single_precision)
        qids = q.column("qid")
        if len(q) and len(r):
            found.add(np.arange(len(q)), columns(q, names), q.column("probe_rank").to_numpy().astype(np.int64), ref_of(r), columns(r, names), qids.to_numpy(zero_copy_only=False) if not_self else None, _bounds(q))
        return found.rows(qids)

    return by_group(left.unionByName(right), ["cluster", "b", "c"], ["role"], work, schema)


def brute(queries: DataFrame, refs: DataFrame, names: Sequence[str], qid: str = "qid", k: int = 5, not_self: str | None = None, single_precision: bool = False) -> DataFrame:
    """qid, rank, ref_id, pos, is_fraud, dist: the k nearest by (dist, pos). not_self: a column of refs never matched to the same
    qid. single_precision: distances as an eight-lane kernel sums them, for parity where they nearly tie."""
    asked = _as_queries(queries, qid, names).withColumns({"cluster": F.lit(-1), "probe_rank": F.lit(0)})
    found = _compare(refs.drop("cluster"), names, asked, k, not_self, single_precision)
    return _nearest(found, k, F.col("dist").asc_nulls_last(), F.col("pos")).select("qid", "rank", "ref_id", "pos", "is_fraud", "dist")


def single(query: DataFrame, refs: DataFrame, names: Sequence[str], qid: str = "qid", k: int = 5, not_self: str | None = None) -> DataFrame:
    """The same for one query: an ordered limit, without a shuffle of more than k rows of each task."""
    q = _as_queries(query.limit(1), qid, names)
    met = refs.crossJoin(F.broadcast(q))
    if not_self:
        met = met.where(F.col(not_self) != F.col("qid"))
    return met.select("qid", "ref_id", "pos", "is_fraud", _distance(q, refs, names).alias("dist")).orderBy("dist", "pos").limit(k)


def probes(queries: DataFrame, centroids: DataFrame, names: Sequence[str], qid: str = "qid", nprobe: int = 16, most: int = 64) -> DataFrame:
    """qid, cluster, probe_rank and the query's columns: the nearest centroids, ties to the smaller cluster. nprobe is held
    between 1 and the lesser of most and the number of centroids. Centroids go to every task, and queries are compared with
    them in blocks of arrays, so there is neither a row per query and centroid nor a shuffle."""
    number, points = cluster_points(centroids, names)
    q = _as_queries(queries, qid, names)
    q_names, kind = [f"q_{n}" for n in names], centroids.schema["cluster"].dataType
    wide = q.select(*q.columns, *[F.col(n).cast("double").alias(f"_{n}") for n in q_names])
    schema = T.StructType([q.schema["qid"], T.StructField("cluster", kind), *(q.schema[n] for n in q_names), T.StructField("probe_dist", T.DoubleType()), T.StructField("probe_rank", T.IntegerType())])
    n = max(1, min(nprobe, most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j in candidates(columns(b, [f"_{x}" for x in q_names]), points, n) if len(points) else ():
                lo, hi = int(i[0]), int(i[-1]) + 1
                part = b.slice(lo, hi - lo)
                dist = exact(columns(part, [f"_{x}" for x in q_names])[i - lo], points[j])
                some = best(n, i, dist, j)
                i, j, dist = i[some] - lo, j[some], dist[some]
                rank = np.arange(len(i)) - np.searchsorted(i, i) + 1
                asked = pa.array(i)
                yield pa.RecordBatch.from_arrays([part.column("qid").take(asked), pa.array(number[j]).cast(to_arrow_type(kind)), *(part.column(x).take(asked) for x in q_names), pa.array(dist, pa.float64(), from_pandas=True), pa.array(rank.astype(np.int32))], names=schema.names)

    return wide.mapInArrow(run, schema)


def ivf(queries: DataFrame, refs: DataFrame, centroids: DataFrame, names: Sequence[str], qid: str = "qid", k: int = 5, nprobe: int = 16, dtype: str = "f16", not_self: str | None = None, single_precision: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """The k nearest among the probed clusters. Equal distances go by the nearer cluster first; within it by position, which
    counts downwards for f16 indexes (their clusters' best are merged from the worst on) and upwards for f32 ones. With scratch,
    for tables of queries, the nearest cluster is searched first, and then those of the others that can hold a nearer row."""

    if scratch:
        found = _by_bounds(queries, refs, centroids, names, qid, k, nprobe, not_self, single_precision, _reach(refs, centroids, names), scratch)
    else:
        found = _compare(refs, names, probes(queries, centroids, names, qid, nprobe), k, not_self, single_precision)
    order = F.col("pos")
    if dtype == "f16":
        within = F.row_number().over(Window.partitionBy("qid", "probe_rank").orderBy(F.col("dist").asc_nulls_last(), "pos"))
        found, order = found.withColumn("within", within).where(F.col("within") <= k).drop("within"), order.desc()
    return _nearest(found, k, F.col("dist").asc_nulls_last(), F.col("probe_rank"), order).select("qid", "rank", "ref_id", "pos", "is_fraud", "dist")


def brute_by_clusters(queries: DataFrame, refs: DataFrame, centroids: DataFrame, names: Sequence[str], scratch: Scratch, qid: str = "qid", k: int = 5, not_self: str | None = None) -> DataFrame:
    """What brute returns, for many queries: references are put to their nearest centroids, and a cluster that can't hold one of a
    query's k nearest isn't compared with it. Any centroids give the same rows; good ones leave little to compare. Vectors are whole."""
    keep = [c for c in dict.fromkeys(["pos", "is_fraud", *([not_self] if not_self else []), *names]) if c != "ref_id"]
    placed = scratch.put(kmeans.assign(refs, centroids, names, keep).drop("dist"), "placed")
    found = _by_bounds(queries, placed, centroids, names, qid, k, None, not_self, False, None, scratch)
    return _nearest(found, k, F.col("dist").asc_nulls_last(), F.col("pos")).select("qid", "rank", "ref_id", "pos", "is_fraud", "dist")


@dataclass
class _Reach:
    """Where the rows of clusters lie, by the clusters' numbers in order. over: how much farther, in squares, a row may lie from its
    centroid than from the nearest one, as index rows keep the cluster of the last assignment, which an update and rounding came after;
    low, high: the box of the rows. Endless where vectors are not whole."""

    over: np.ndarray
    low: np.ndarray
    high: np.ndarray


def _reach(refs: DataFrame, centroids: DataFrame, names: Sequence[str]) -> _Reach:
    number, points = cluster_points(centroids, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        over, low, high = np.full(len(number), -np.inf), np.full(points.shape, np.inf), np.full(points.shape, -np.inf)
        for b in batches:
            of = b.column("cluster").to_numpy()
            known = np.isin(of, number)  # no query probes others
            x, at = columns(b, names)[known], np.searchsorted(number, of[known])
            if not len(x):
                continue
            more = exact(x, points[at]) - kmeans.nearest(x, points)[1]
            order = np.argsort(at, kind="stable")
            first = np.flatnonzero(np.diff(at[order], prepend=-1))
            c, x = at[order][first], x[order]
            whole = np.isfinite(x)
            over[c] = np.maximum(over[c], np.maximum.reduceat(np.where(np.isfinite(more), more, np.inf)[order], first))
            low[c] = np.minimum(low[c], np.minimum.reduceat(np.where(whole, x, -np.inf), first))
            high[c] = np.maximum(high[c], np.maximum.reduceat(np.where(whole, x, np.inf), first))
        some = np.flatnonzero(over > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(over[some]), *(pa.array(list(m[some]), pa.list_(pa.float64())) for m in (low, high))], names=["c", "over", "low", "high"])

    rows = refs.where("cluster is not null").select(F.col("cluster").cast("long").alias("cluster"), *names)
    out = _Reach(np.zeros(len(number)), np.full(points.shape, np.inf), np.full(points.shape, -np.inf))
    # A row for each task and cluster at most.
    for r in rows.mapInArrow(run, "c long, over double, low array<double>, high array<double>").groupBy("c").agg(F.max("over").alias("over"), *(f(F.col(m)[i]).alias(f"{m}{i}") for m, f in (("low", F.min), ("high", F.max)) for i in range(len(names)))).collect():
        out.over[r["c"]] = r["over"]
        out.low[r["c"]], out.high[r["c"]] = ([r[f"{m}{i}"] for i in range(len(names))] for m in ("low", "high"))
    return out


def _by_bounds(queries: DataFrame, refs: DataFrame, centroids: DataFrame, names: Sequence[str], qid: str, k: int, nprobe: int | None, not_self: str | None, single_precision: bool, reach: _Reach | None, scratch: Scratch) -> DataFrame:
    """_compare's rows of the k nearest among the probed clusters (nprobe None: among all) in two searches, both written to scratch: each
    query's nearest cluster, whose k-th distance is a bound, and the clusters that can reach below it."""
    first = scratch.put(_compare(refs, names, probes(queries, centroids, names, qid, 1), k, not_self, single_precision), "first")
    n = F.count("dist")
    bounds = first.groupBy("qid").agg(F.when(n >= k, F.max("dist")).alias("bound"))
    asked = _as_queries(queries, qid, names).join(bounds, "qid", "left")
    more = scratch.put(_reachable(asked, centroids, names, nprobe, reach, 1e-5 if single_precision else 1e-9), "more")
    return first.unionByName(scratch.put(_compare(refs, names, more, k, not_self, single_precision), "second"))


def _reachable(asked: DataFrame, centroids: DataFrame, names: Sequence[str], nprobe: int | None, reach: _Reach | None, loss: float) -> DataFrame:
    """asked (qid, q_*, bound) by cluster and probe_rank, for the probes after the first that can hold a row within the bound. Rows of a
    cluster lie on their centroid's side of the plane between it and the query's nearest centroid, or over it by the cluster's reach,
    and in the cluster's box."""
    number, points = cluster_points(centroids, names)
    over = reach.over if reach else np.zeros(len(number))
    q_names, kind = [f"q_{n}" for n in names], centroids.schema["cluster"].dataType
    schema = T.StructType([asked.schema["qid"], T.StructField("cluster", kind), *(asked.schema[n] for n in q_names), T.StructField("bound", T.DoubleType()), T.StructField("probe_rank", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, bound = columns(b, q_names), _bounds(b)
            for i, j in candidates(x, points, len(points) if nprobe is None else nprobe) if len(points) else ():
                dist = exact(x[i], points[j])
                some = best(len(points) if nprobe is None else nprobe, i, dist, j)
                i, j, dist = i[some], j[some], dist[some]
                start = np.searchsorted(i, i)  # the row of each query's nearest centroid
                rank = np.arange(len(i)) - start + 1
                behind = dist - dist[start] - over[j]
                wide = 2 * np.sqrt(exact(points[j], points[j[start]]) * bound[i]) * (1 + loss) + loss * (1 + dist + dist[start])
                open_ = (rank > 1) & ~((behind > wide) & np.isfinite(bound[i]))
                i, j, rank = i[open_], j[open_], rank[open_]
                if reach:
                    apart = np.maximum(0, np.maximum(reach.low[j] - x[i], x[i] - reach.high[j]))
                    open_ = ~((apart * apart).sum(1) > bound[i] * (1 + loss) + loss)
                    i, j, rank = i[open_], j[open_], rank[open_]
                take = pa.array(i)
                yield pa.RecordBatch.from_arrays([b.column("qid").take(take), pa.array(number[j]).cast(to_arrow_type(kind)), *(b.column(n).take(take) for n in q_names), pa.array(bound[i]), pa.array(rank.astype(np.int32))], names=schema.names)

    return asked.select("qid", *q_names, "bound").mapInArrow(run, schema)


def recall(found: DataFrame, true: DataFrame, k: int = 5) -> DataFrame:
    """One row: queries, hits and recall of found against true neighbours (qid, ref_id)."""
    hits = found.select("qid", "ref_id").join(true.select("qid", "ref_id"), ["qid", "ref_id"], "left_semi").groupBy("qid").agg(F.count(F.lit(1)).alias("hits"))
    every = true.groupBy("qid").agg(F.count(F.lit(1)).alias("wanted"))
    both = every.join(hits, "qid", "left")
    return both.agg(F.count(F.lit(1)).alias("queries"), F.coalesce(F.sum("hits"), F.lit(0)).alias("hits"), F.try_divide(F.coalesce(F.sum("hits"), F.lit(0)), F.sum("wanted")).alias("recall"))
