"""Column helpers for long arrays: work in blocks, so that a running value costs no copy of all that came before."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def blocks(items: Column) -> Column:
    """An array's items in order as arrays; none for an empty array. Each has about sqrt(n) / 2 of n items: cutting one out
    walks over all items, and what is appended to inside one costs its square."""

    def cut(size: Column) -> Column:
        last = F.floor((F.size(items) - 1) / size).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(items, b * size + 1, size))

    return F.when(F.size(items) > 0, let(F.greatest(F.lit(32), F.ceil(F.sqrt(F.size(items)) / 2)).cast("int"), cut)).otherwise(F.filter(F.array(items), lambda x: F.lit(False)))


def with_start(parts: Column, of_part: Callable[[Column], Column], add: Callable[[Column, Column], Column]) -> Column:
    """array<struct<part, at>>: of each block what add makes of those before it, from 0; of_part gives a block's own number."""

    def step(acc: Column, x: Column) -> Column:
        return F.struct(add(acc["now"], x).alias("now"), F.concat(acc["out"], F.array(acc["now"])).alias("out"))

    begin = F.struct(F.lit(0).cast("bigint").alias("now"), F.array().cast("array<bigint>").alias("out"))
    starts = F.aggregate(F.transform(parts, lambda p: of_part(p).cast("bigint")), begin, step, lambda acc: acc["out"])
    return F.arrays_zip(parts.alias("part"), starts.alias("at"))
