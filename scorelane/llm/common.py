"""What the operators share: table access, joins, and stable row keys."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelane.scratch import Scratch, scratch_dir  # noqa: F401  for the operators


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def meet(rows: DataFrame, table: DataFrame, on: str, size: str, total: int, hot: int = 1000) -> DataFrame:
    """rows joined with table, which has one row per value of on; size is how many of about total rows have that value. Values with
    more than total / hot rows, at most hot of them, are taken out by name and come by a broadcast, so no task gets all rows of
    such a value. The column size stays. table is read several times: write it first."""
    often = [r[0] for r in table.where(F.col(size) > max(1, total // hot)).select(on).collect()]
    if not often:
        return rows.join(table, on)
    named = F.col(on).isin(often)
    return rows.where(named).join(F.broadcast(table.where(named)), on).unionByName(rows.where(~named).join(table.where(~named), on))


ROWS_PER_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """While it holds, Arrow batches have at most so many rows, for tables of whole texts: a task holds a batch several times over, in
    and outside the JVM's heap and in its worker. For plans that are run inside; the setting is put back."""
    was = spark.conf.get(ROWS_PER_BATCH, None)
    if was is None or not 0 < int(was) <= rows:
        spark.conf.set(ROWS_PER_BATCH, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(ROWS_PER_BATCH) if was is None else spark.conf.set(ROWS_PER_BATCH, was)


def give_back() -> None:
    """Memory that is no longer used goes back to the system: a worker idles on beside others, and serves later stages."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL(None).malloc_trim(0)


def by_batch(run: Callable[[Iterator], Iterator[pa.Array]], returns: str, *columns: Column) -> Column:
    """run over batches of the columns. Marked as not deterministic, so that a filter on its result runs it once, not twice."""

    def whole(batches):
        yield from run(batches)
        give_back()

    kind = pa.Array if len(columns) == 1 else tuple[(pa.Array,) * len(columns)]
    whole.__annotations__ = {"batches": Iterator[kind], "return": Iterator[pa.Array]}
    return F.arrow_udf(whole, returns).asNondeterministic()(*columns)


def crc_of_id(column: str) -> Column:
    """crc32 of a whole-number id written as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))
