"""Vectors as rows of bytes, and groups of rows handed whole to a function, one group after the other."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from scorelane.llm.common import by_batch


def packed(vector: Column) -> Column:
    """A vector's components as little-endian doubles; null for vectors that take no part: null, empty or zero ones, and
    ones with null or non-finite components."""

    def run(arrays: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in arrays:
            out = []
            for x in a:
                v = x.values
                if v is None or not len(v) or v.null_count:
                    out.append(None)
                    continue
                v = v.to_numpy().astype("<f8")
                size = v @ v
                out.append(v.tobytes() if np.isfinite(v).all() and size > 0 and np.isfinite(size) else None)
            yield pa.array(out, pa.binary())

    return by_batch(run, "binary", vector)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Packed vectors of equal length as rows."""
    parts = column.to_pylist()
    return np.frombuffer(b"".join(parts), "<f8").reshape(len(parts), -1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def by_group(rows: DataFrame, keys: list[str], work: Callable[[pa.Table], pa.RecordBatch], schema: str) -> DataFrame:
    """work on the rows of each group. Unlike a grouped map, small groups cost little."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not len(b):
                continue
            columns = [b.column(k).to_numpy(zero_copy_only=False) for k in keys]
            cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1 if len(b) > 1 else np.zeros(0, int)
            if held and any(held[-1].column(k)[0] != b.column(k)[0] for k in keys):
                yield work(pa.Table.from_batches(held))
                held = []
            edges = [0, *cuts.tolist(), len(b)]
            for a, z in zip(edges[:-2], edges[1:-1], strict=True):
                yield work(pa.Table.from_batches([*held, b.slice(a, z - a)]))
                held = []
            held.append(b.slice(edges[-2]))
        if held:
            yield work(pa.Table.from_batches(held))

    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)
