"""The index as three Parquet tables: refs sorted by cluster, centroids, and meta. Also reads the binary index format."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelane.config import DIMS
from scorelane.schema import META

# Fixed values of the binary format: little-endian header, then vectors, label bits, centroids, offsets.
MAGIC, HEADER_BYTES, DTYPES, FLAG_IVF = b"R26V", 32, {1: "f16", 2: "f32"}, 1


@dataclass
class Index:
    refs: DataFrame  # ref_id, cluster, pos, v0.., is_fraud
    centroids: DataFrame | None  # cluster, v0..
    meta: DataFrame
    cached: list[DataFrame] = field(default_factory=list)

    def release(self) -> None:
        for df in self.cached:
            df.unpersist()


def write_index(index: Index, path: str, partitions: int | None = None) -> None:
    """Rows of a cluster stand together, so a probe reads few row groups; a large cluster may span files."""
    n = partitions or index.refs.sparkSession.sparkContext.defaultParallelism
    index.refs.repartitionByRange(n, "cluster", "pos").sortWithinPartitions("cluster", "pos").write.mode("overwrite").parquet(f"{path}/refs")
    if index.centroids is not None:
        index.centroids.coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    index.meta.coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    index.release()


def read_index(spark: SparkSession, path: str) -> Index:
    meta = spark.read.parquet(f"{path}/meta")
    has = meta.first()["nlist"] > 0
    return Index(spark.read.parquet(f"{path}/refs"), spark.read.parquet(f"{path}/centroids") if has else None, meta)


def ready(spark: SparkSession, path: str) -> bool:
    """Whether an index stands at path and has the vectors that it names."""
    try:
        index = read_index(spark, path)
        return index.refs.count() == index.meta.first()["count"]
    except Exception as e:  # noqa: BLE001  Spark names a missing table by several classes
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return False
        raise


def summary(index: Index) -> DataFrame:
    """One row: count, fraud, legit."""
    return index.refs.agg(F.count(F.lit(1)).alias("count"), F.count_if("is_fraud").alias("fraud"), F.count_if(~F.col("is_fraud")).alias("legit"))


def _header(head: bytes) -> dict:
    if len(head) < HEADER_BYTES:
        raise ValueError("dataset too small")
    if head[:4] != MAGIC:
        raise ValueError("bad magic")
    version, count, dims, stride, dtype, nlist, flags = np.frombuffer(head[4:HEADER_BYTES], "<u4").tolist()
    for wrong, what in ((version not in (1, 2), "unsupported version"), (dims != DIMS, "unexpected dims"), (stride < DIMS, "stride below dims"), (dtype not in DTYPES, "unsupported dtype")):
        if wrong:
            raise ValueError(what)
    return {"count": count, "stride": stride, "dtype": DTYPES[dtype], "nlist": nlist if version >= 2 and flags & FLAG_IVF else 0}


def read_binary(spark: SparkSession, path: str) -> Index:
    """A binary index file, decoded by one task as it is one record; write it with write_index for use at scale."""
    names = [f"v{i}" for i in range(DIMS)]
    rows = spark.read.format("binaryFile").load(path).select("content")
    refs_schema = "ref_id long, cluster int, pos long, " + ", ".join(f"{n} float" for n in names) + ", is_fraud boolean"
    centroid_schema = "cluster int, " + ", ".join(f"{n} float" for n in names)

    def decode(content: bytes) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        h = _header(content)
        kind = np.dtype("<f2" if h["dtype"] == "f16" else "<f4")
        sizes = [h["count"] * h["stride"] * kind.itemsize, -(-h["count"] // 8), h["nlist"] * h["stride"] * kind.itemsize, 4 * (h["nlist"] + 1) if h["nlist"] else 0]
        if len(content) < HEADER_BYTES + sum(sizes):
            raise ValueError("truncated dataset")
        ends = np.cumsum([HEADER_BYTES, *sizes])
        parts = [content[a:z] for a, z in zip(ends[:-1], ends[1:], strict=True)]
        vectors = np.frombuffer(parts[0], kind).reshape(-1, h["stride"])[:, :DIMS].astype(np.float32)
        labels = np.unpackbits(np.frombuffer(parts[1], np.uint8), bitorder="little")[: h["count"]].astype(bool)
        centroids = np.frombuffer(parts[2], kind).reshape(-1, h["stride"])[:, :DIMS].astype(np.float32)
        return h, vectors, labels, centroids, np.frombuffer(parts[3], "<u4")

    def refs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0).to_pylist():
                h, vectors, labels, _, starts = decode(content)
                cluster = np.searchsorted(starts, np.arange(h["count"]), side="right") - 1 if h["nlist"] else np.zeros(h["count"])
                pos = np.arange(h["count"], dtype=np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pos), pa.array(cluster.astype(np.int32)), pa.array(pos), *[pa.array(vectors[:, i]) for i in range(DIMS)], pa.array(labels)], names=["ref_id", "cluster", "pos", *names, "is_fraud"])

    def centroids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column(0).to_pylist():
                h, _, _, found, _ = decode(content)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(h["nlist"], dtype=np.int32)), *[pa.array(found[:, i]) for i in range(DIMS)]], names=["cluster", *names])

    h = _header(bytes(rows.select(F.substring("content", 1, HEADER_BYTES)).first()[0]))
    meta = spark.createDataFrame([(h["count"], DIMS, h["dtype"], h["nlist"], None, None)], META)
    return Index(rows.mapInArrow(refs, refs_schema), rows.mapInArrow(centroids, centroid_schema) if h["nlist"] else None, meta)
