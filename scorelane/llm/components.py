"""Connected components by alternating large-star and small-star, over edges kept in written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from scorelane.llm.common import Scratch


def _star(pairs: DataFrame, least: DataFrame) -> DataFrame:
    """(v, m) for each pair (u, v) and the least neighbour m of u."""
    return pairs.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _large(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours go to its least neighbour (or to itself)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return _star(both.where("v > u"), least)


def _small(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours go to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    return _star(down, least).unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected(edges: DataFrame, scratch: Scratch, name: str = "stars", tasks: int | None = None) -> DataFrame:
    """(node, component) of every node in edges (columns u, v), component being its least node; written.

    Each round is a few shuffles of the edges, and there are about log2(diameter) rounds. It ends when a round changes
    nothing, which a count and a sum of hashes tell; both are taken while the round is written. tasks: in how many files a
    round's result is put, for edges that are known to be few.
    """

    def put(df: DataFrame, i: int) -> tuple[DataFrame, tuple]:
        seen = Observation()
        df = df.repartition(tasks) if tasks else df
        df = df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"))
        out = scratch.put(df, f"{name}{i}")
        return out, (seen.get["n"], seen.get["s"])

    i = 0
    now, was = put(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), i)
    while was[0]:
        i += 1
        now, is_ = put(_small(_large(now)), i)
        scratch.drop(f"{name}{i - 1}")
        if is_ == was:
            break
        was = is_
    own = F.struct(F.col("u").alias("node"), F.col("v").alias("component"))
    root = F.struct(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.explode(F.array(own, root)).alias("x")).select("x.*").distinct()
