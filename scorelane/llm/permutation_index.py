"""Approximate nearest neighbours by a permutation index.

``pivots`` vectors, chosen by a hash, are the reference points. A vector is represented by its ``prefix`` nearest pivots in
order. The table is dealt into blocks of about ``block`` rows, and each block posts its vectors once in an inverted file per
pivot, sorted by the place that the pivot has in their orders. A query goes to every block. For each of its own pivots it
reads only the postings whose place is within ``window`` of the query's and adds up how far they differ; a pivot that isn't
read counts window + 1: Spearman's footrule, cut off. The vectors of least footrule, ``reranked`` * sqrt(n) of all n and as
many in each block, are reranked by exact cosine in double precision. So the vectors compared with a query grow with the
root of the table, and what it reads of the files is (prefix * window / pivots) postings a vector at most.

The pivots are a bounded sample; every row is posted and every row can be found. A task holds one block; queries stream through
it. Recall against brute force is in the README.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components take no part, as queries or as
candidates, nor do rows whose key is null; vectors of other lengths than the query's are no candidates; fewer candidates
than k give them all; ties go to the smaller key, equal vectors having equal scores wherever they stand; equal rows ask
once; repeated keys are rows of their own, and none is a candidate for a query of its key; an empty table gives no rows;
further columns of any name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scorelane.llm.common import Scratch, meet
from scorelane.llm.tiles import matrix, packed, unit

PIVOT, ROW, QUERY = 0, 1, 2


def orders(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The numbers of each unit row's nearest pivots, nearest first."""
    near = x @ pivots.T
    some = np.argpartition(-near, prefix - 1, axis=1)[:, :prefix] if prefix < len(pivots) else np.broadcast_to(np.arange(len(pivots)), near.shape)
    return np.take_along_axis(some, np.argsort(-np.take_along_axis(near, some, 1), axis=1, kind="stable"), 1)


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of rows of x with y, each summed in the same order wherever it stands."""
    size = lambda a: np.sqrt((a * a).sum(axis=-1))
    return (x * y).sum(axis=1) / (size(x) * size(y))


class InvertedFiles:
    """A block's postings: of pivot p, from start[p, a] to start[p, b], the vectors that have it at places a to b - 1."""

    def __init__(self, order: np.ndarray, pivots: int):
        self.n, self.prefix = order.shape
        place = np.broadcast_to(np.arange(self.prefix), order.shape)
        by = np.argsort((order.astype(np.int64) * self.prefix + place).ravel(), kind="stable")
        self.vector, self.place = (by // self.prefix).astype(np.int32), place.ravel()[by].astype(np.int32)
        sizes = np.bincount((order.astype(np.int64) * self.prefix + place).ravel(), minlength=pivots * self.prefix)
        self.start = np.append(0, np.cumsum(sizes))

    def nearness(self, order: np.ndarray, window: int) -> np.ndarray:
        """Of each vector: the sum of window + 1 - difference over the postings read, which is greatest where the footrule is least."""
        at = np.arange(len(order))
        first, last = order * self.prefix + np.maximum(0, at - window), order * self.prefix + np.minimum(self.prefix, at + window + 1)
        slices = [slice(a, z) for a, z in zip(self.start[first], self.start[last], strict=True)]
        read = np.concatenate([self.vector[s] for s in slices])
        gain = np.concatenate([window + 1 - np.abs(self.place[s] - i) for i, s in enumerate(slices)])
        return np.bincount(read, gain, self.n)


def search(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 5, pivots: int = 512, prefix: int = 192, window: int = 96, reranked: float = 12.0, block: int = 8192) -> DataFrame:
    """query_id, rank, key, score: the k rows found nearest by cosine to each row for which is_query holds."""
    scratch = Scratch(vectors.sparkSession, "search")
    rows = vectors.select(F.col(key).cast("bigint").alias("key"), packed(F.col(vector)).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = scratch.put(rows.where("key is not null and v is not null").withColumn("d", F.octet_length("v")), "rows")
    sizes = scratch.put(rows.groupBy("d").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", F.ceil(F.col("n") / block).cast("int")), "sizes", 1)
    total = sizes.agg(F.sum("n")).first()[0] or 0
    of = lambda part: meet(part, sizes, "d", "n", total)
    own = of(rows.select("d", "key", "v"))
    # Of a large table about 4 * pivots rows stand for election, whatever the number of tasks.
    chance = F.pmod(F.xxhash64("v", "key"), F.lit(1 << 30)) / float(1 << 30) * F.col("n") < 4.0 * pivots
    place = F.row_number().over(Window.partitionBy("d").orderBy(F.xxhash64("key", "v"), "key", "v"))
    picked = own.where(chance).select("d", "key", "v").withColumn("at", place).where(F.col("at") <= pivots)
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b")
    part = lambda df, b, role: df.select("d", b, F.lit(role).alias("role"), "n", "blocks", "key", "v")
    met = part(own, F.pmod(F.xxhash64("key", "v"), F.col("blocks")).cast("int").alias("b"), ROW)
    met = met.unionByName(part(of(picked), every, PIVOT)).unionByName(part(of(rows.where("asks").select("d", "key", "v").distinct()), every, QUERY))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, index = None, {PIVOT: [], ROW: []}, None

        def build() -> tuple:
            """The block's keys, vectors, pivots and files."""
            keys = np.concatenate([t.column("key").to_numpy() for t in held[ROW]])
            x, points = (np.concatenate([matrix(t.column("v")) for t in held[r]]) for r in (ROW, PIVOT))
            points = unit(points)
            return keys, x, points, InvertedFiles(orders(unit(x), points, min(prefix, len(points))), len(points))

        def answer(t: pa.RecordBatch) -> pa.RecordBatch:
            keys, x, points, files = index
            most = min(len(keys), int(np.ceil(reranked * np.sqrt(t.column("n")[0].as_py()) / t.column("blocks")[0].as_py())) + k + 1)
            asked, q = t.column("key").to_numpy(), matrix(t.column("v"))
            out: list[list] = [[], [], []]
            for who, y, order in zip(asked.tolist(), q, orders(unit(q), points, files.prefix), strict=True):
                # Equal nearness goes by place, which is the order of keys.
                near = files.nearness(order, window) * len(keys) - np.arange(len(keys))
                some = np.argpartition(-near, most - 1)[:most] if most < len(keys) else np.arange(len(keys))
                some = some[keys[some] != who]
                score = cosines(x[some], y)
                best = np.lexsort((keys[some], -score))[:k]
                for column, values in zip(out, ([who] * len(best), keys[some[best]].tolist(), score[best].tolist()), strict=True):
                    column += values
            return pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(out, (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["query_id", "key", "score"])

        for b in batches:
            group = [b.column(c).to_numpy() for c in ("d", "b", "role")]
            edges = np.flatnonzero(np.any([g[1:] != g[:-1] for g in group], axis=0)) + 1 if len(b) > 1 else []
            for a, z in zip([0, *edges], [*edges, len(b)], strict=True):
                if a == z:
                    continue
                d, at, role = (int(g[a]) for g in group)
                if (d, at) != now:
                    now, held, index = (d, at), {PIVOT: [], ROW: []}, None
                if role != QUERY:
                    held[role].append(b.slice(a, z - a))
                elif held[ROW]:
                    index = index or build()
                    yield answer(b.slice(a, z - a))

    sorted_ = met.repartition("d", "b").sortWithinPartitions("d", "b", "role", "key", "v")
    found = scratch.put(sorted_.mapInArrow(run, "query_id long, key long, score double"), "found")
    scratch.drop("rows"), scratch.drop("sizes")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "key"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("key").alias(key), "score")
