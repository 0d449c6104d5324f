"""Reference rows to an index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelane.config import BuildConfig
from scorelane.operators import kmeans
from scorelane.schema import META
from scorelane.sources.index import Index


def build_index(refs: DataFrame, config: BuildConfig | None = None) -> Index:
    """refs: ref_id from 0 without gaps, v0.., is_fraud. Without clusters (nlist 0) all rows are in cluster 0, in their order.
    Vectors and centroids are rounded to half precision after training if the dtype asks for it. What the index is made from
    stays cached until it is written or released."""
    config = config or BuildConfig()
    names = [c for c in refs.columns if c not in ("ref_id", "is_fraud")]
    spark = refs.sparkSession
    refs = refs.select("ref_id", *[F.col(n).cast("float").alias(n) for n in names], "is_fraud").persist()
    count = refs.count()
    # Rows that came in few partitions, as small tables do, are still much work in each round.
    # Large ones are cut in few tasks, as each costs more than it compares if it is small.
    pairs = count * config.nlist
    tasks = min(4096, max(min(-(-pairs // kmeans.PAIRS_PER_TASK), 2 * spark.sparkContext.defaultParallelism), pairs // kmeans.MOST_PAIRS))
    if tasks > max(1, count // kmeans.ROWS_PER_SPLIT):
        whole, refs = refs, refs.repartition(tasks, "ref_id").persist()
        refs.count()
        whole.unpersist()
    trained = kmeans.train(refs, names, config.nlist, config.max_iter, config.tol, config.seed)
    assigned = trained.assigned(refs, names, [*names, "is_fraud"]).persist()
    placed = kmeans.clustered(assigned) if config.nlist else assigned.withColumn("pos", F.col("ref_id"))
    rows = kmeans.quantised(placed.select("ref_id", "cluster", "pos", *names, "is_fraud"), names, config.dtype)
    schema = "cluster int, " + ", ".join(f"{n} float" for n in names)
    centroids = kmeans.quantised(spark.createDataFrame([tuple(r) for r in trained.centroids], schema), names, config.dtype) if config.nlist else None
    meta = spark.createDataFrame([(count, len(names), config.dtype, config.nlist, config.seed, trained.iters)], META)
    return Index(rows, centroids, meta, [refs, assigned])
