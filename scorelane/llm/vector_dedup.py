"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

Equal vectors form a class first, of which one goes on with its number of copies, so a group of copies costs one row. Each
class's unit vector x is quantised once to scale * q, q in int8, and its residual norm e = |x - scale * q| is kept. Classes are
dealt into blocks, and every pair of blocks is a tile, done in one piece by one task, to which only q, scale and e go. For
every pair, |x.y - scale_x * scale_y * q_x.q_y| <= e_x + (1 + e_x) * e_y. Integer products decide what the bound can
decide. Of the pairs that lie within the bound of the threshold a tile names the vectors; these alone are sent again, now in
double precision, and those pairs are recomputed.

A tile returns no pairs: for each vector its number of links there and its component there. Counts add up, and the
components join by alternating large-star and small-star, so large groups of near copies make few rows.

Work grows with the square of the number of distinct vectors, as comparing all of them does; memory of a task is bounded by
the block size, and the shuffle is quantised vectors times blocks. There are as many blocks as ``block`` rows each ask for, and
more where the session has cores for more tiles.

Defined cases: vectors that are null, empty, zero or hold null or non-finite components link with nothing; vectors of
different lengths are never linked; repeated keys are rows of their own that share a component, and links count rows; null
keys link with nothing, their component is null and they are kept; an empty table gives no rows; further columns of any
name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelane.llm.common import Scratch, meet
from scorelane.llm.components import connected
from scorelane.llm.tiles import by_group, matrix, packed, unit

STRIP = 1024
LEAST_BLOCK = 512
SLACK = 1e-6  # beyond any rounding of the bound itself


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 values, scales and residual norms of unit rows."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    return q, scale, np.linalg.norm(x - q * scale[:, None], axis=1)


def tile_pairs(x: tuple, y: tuple | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(into x, into y, whether sure) of the pairs that the bound doesn't rule out; x and y: values, scales and residual norms of
    quantised rows; y None: pairs i < j within x."""
    same = y is None
    (qx, sx, ex), (qy, sy, ey) = x, x if same else y
    kind = np.float32 if 127 * 127 * qx.shape[1] < 1 << 24 else np.float64  # holds the integer sums exactly
    ty, most_s, most_e = qy.T.astype(kind), sy.max(), ey.max()
    found: list[list[np.ndarray]] = [[], [], []]
    for at in range(0, len(qx), STRIP):
        rows = slice(at, at + STRIP)
        from_ = at if same else 0
        dots = qx[rows].astype(kind) @ ty[:, from_:]
        # A pair above the threshold reaches this, whatever its own y is.
        reach = (threshold - ex[rows] - (1 + ex[rows]) * most_e - SLACK) / sx[rows]
        reach = np.where(reach > 0, reach / most_s, -np.inf)
        i, j = np.nonzero(dots >= (reach * (1 - 1e-6))[:, None].astype(kind))
        value = dots[i, j].astype(np.float64)
        i, j = i + at, j + from_
        if same:
            apart = i < j
            i, j, value = i[apart], j[apart], value[apart]
        value *= sx[i] * sy[j]
        bound = ex[i] + (1 + ex[i]) * ey[j] + SLACK
        may = value + bound >= threshold
        for out, part in zip(found, (i[may], j[may], (value - bound >= threshold)[may]), strict=True):
            out.append(part)
    return tuple(np.concatenate(out) for out in found)


def exact(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: float) -> np.ndarray:
    """Whether rows i of x and j of y, unit rows, have a product of threshold or more."""
    parts = np.array_split(np.arange(len(i)), max(1, len(i) // 20_000))
    return np.concatenate([np.einsum("ij,ij->i", x[i[k]], y[j[k]]) >= threshold for k in parts])


def least_labels(n: int, i: np.ndarray, j: np.ndarray, names: np.ndarray) -> np.ndarray:
    """The least name in each node's component."""
    label = names.copy()
    while len(i):
        low = np.minimum(label[i], label[j])
        if (low == label[i]).all() and (low == label[j]).all():
            break
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
    return label


def near_duplicates(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", threshold: float = 0.9, block: int = 8192) -> DataFrame:
    """key, n_links, component_id, kept. key is a whole number."""
    scratch = Scratch(vectors.sparkSession, "vectors")
    rows = vectors.select(F.col(key).cast("bigint").alias("key"), packed(F.col(vector)).alias("v"))
    rows = scratch.put(rows.withColumn("v", F.when(F.col("key").isNotNull(), F.col("v"))), "rows")
    apart = rows.where("v is not null").groupBy("v").agg(F.min("key").alias("class"), F.count(F.lit(1)).alias("copies"))
    apart = apart.select(F.monotonically_increasing_id().alias("id"), "class", "copies", F.octet_length("v").alias("d"), "v")

    def quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values: list = [None] * len(b)
            scales, rests, lengths = np.zeros(len(b)), np.zeros(len(b)), b.column("d").to_numpy()
            for d in np.unique(lengths):
                at = np.flatnonzero(lengths == d)
                q, scales[at], rests[at] = quantise(unit(matrix(b.column("v").take(pa.array(at)))))
                for i, x in zip(at, q, strict=True):
                    values[i] = x.tobytes()
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(values, pa.binary()), pa.array(scales), pa.array(rests)], names=[*b.schema.names, "q8", "scale", "rest"])

    classes = scratch.put(apart.mapInArrow(quantised, "id long, class long, copies long, d int, v binary, q8 binary, scale double, rest double"), "classes")
    tasks = vectors.sparkSession.sparkContext.defaultParallelism
    many = F.greatest(F.ceil(F.col("n") / block), F.least(F.ceil(F.col("n") / LEAST_BLOCK), F.lit(int(np.ceil((8 * tasks) ** 0.5)))))
    sizes = scratch.put(classes.groupBy("d").agg(F.count(F.lit(1)).alias("n")).withColumn("blocks", many.cast("bigint")), "sizes", 1)
    n = sizes.agg(F.sum("n")).first()[0] or 0
    dealt = meet(classes.select("d", "id", "class", "copies", "q8", "scale", "rest"), sizes, "d", "n", n)
    dealt = dealt.withColumn("i", F.pmod(F.xxhash64("id"), F.col("blocks"))).withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    dealt = dealt.select("d", F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q"), "i", "id", "class", "copies", "q8", "scale", "rest")

    def pairs(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(left, right, sure) of a tile's rows."""
        p, q, i = t.column("p")[0].as_py(), t.column("q")[0].as_py(), t.column("i").to_numpy()
        values = t.column("q8").to_pylist()
        parts = (np.frombuffer(b"".join(values), np.int8).reshape(len(values), -1), t.column("scale").to_numpy(), t.column("rest").to_numpy())
        if p == q:
            return tile_pairs(parts, None, threshold)
        a, b = np.flatnonzero(i == p), np.flatnonzero(i == q)
        if not len(a) or not len(b):
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool)
        left, right, sure = tile_pairs(tuple(x[a] for x in parts), tuple(x[b] for x in parts), threshold)
        return a[left], b[right], sure

    def result(t: pa.Table, left: np.ndarray, right: np.ndarray, ask: np.ndarray) -> pa.RecordBatch:
        """Links and components of rows, and the rows in ask, which are to come again."""
        names, copies, ids = (t.column(c).to_numpy() for c in ("class", "copies", "id"))
        n = (np.bincount(left, copies[right], len(names)) + np.bincount(right, copies[left], len(names))).astype(np.int64)
        label, some = least_labels(len(names), left, right, names), np.flatnonzero(n)
        every = pa.array(np.concatenate([some, ask]))
        again = np.repeat([False, True], [len(some), len(ask)])
        same = [t.column(c).combine_chunks().take(every) for c in ("d", "p", "q", "i", "id", "class")]
        return pa.RecordBatch.from_arrays([*same, pa.array(n[every]), pa.array(label[every]), pa.array(again)], names=[x.split()[0] for x in schema.split(", ")])

    schema = "d int, p long, q long, i long, id long, class long, n long, root long, again boolean"

    def first(t: pa.Table) -> pa.RecordBatch:
        left, right, sure = pairs(t)
        return result(t, left[sure], right[sure], np.unique(np.concatenate([left[~sure], right[~sure]])))

    def second(t: pa.Table) -> pa.RecordBatch:
        left, right, sure = pairs(t)
        left, right = left[~sure], right[~sure]
        x = unit(matrix(t.column("v")))
        linked = exact(x, x, left, right, threshold)
        return result(t, left[linked], right[linked], np.zeros(0, np.int64))

    tiles = scratch.put(by_group(dealt, ["d", "p", "q"], first, schema), "tiles")
    asked = tiles.where("again").select("p", "q", "i", "id").join(classes, "id")
    decided = scratch.put(by_group(asked, ["d", "p", "q"], second, schema), "decided")
    tiles = tiles.where("not again").unionByName(decided).select("id", "class", "n", "root")
    found = connected(tiles.select(F.col("class").alias("u"), F.col("root").alias("v")), scratch)
    of = classes.select("id", "class", "copies", "v").join(tiles.groupBy("id").agg(F.sum("n").alias("n")), "id", "left").join(found, F.col("class") == F.col("node"), "left")
    of = of.select("v", "copies", F.coalesce("component", "class").alias("component_id"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    of = scratch.put(of, "of")
    out = meet(rows.where("v is not null"), of, "v", "copies", n).select("key", "n_links", "component_id")
    out = out.unionByName(rows.where("v is null").select("key", F.lit(0).cast("bigint").alias("n_links"), F.col("key").alias("component_id")))
    out = scratch.put(out.select(F.col("key").alias(key), "n_links", "component_id", F.coalesce(F.col("key") == F.col("component_id"), F.lit(True)).alias("kept")), "out")
    for name in ("rows", "classes", "sizes", "tiles", "decided", "of"):
        scratch.drop(name)
    return out
