"""Numeric expressions, all inside whole-stage code."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def f32(x: Column) -> Column:
    """Rounds to single precision, as each single-precision operation does."""
    return x.cast("float")


def clamp01(x: Column) -> Column:
    """Into 0 to 1; NaN is 0."""
    return F.greatest(F.least(F.nanvl(x, F.lit(0.0).cast("float")), F.lit(1.0).cast("float")), F.lit(0.0).cast("float"))


def half(x: Column) -> Column:
    """Rounds to the nearest half-precision number, ties to even, for |x| up to 65504."""
    wide = x.cast("double")
    exponent = F.greatest(F.floor(F.log2(F.abs(wide))), F.lit(-14))
    grid = F.pow(F.lit(2.0), 10 - exponent)
    return F.when(wide == 0, F.lit(0.0)).otherwise(F.rint(wide * grid) / grid).cast("float")


def squared_distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Sum of squared differences in double precision, added from left to right."""
    terms = [(x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")) for x, y in zip(a, b, strict=True)]
    return reduce(lambda s, t: s + t, terms)


def squared_distance_f32(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """The single-precision sum in the order of an eight-lane kernel with fused multiply-add over 16 lanes, for parity checks.

    Lanes beyond the vectors are zero. Each fused step is one rounding of an exact double-precision product and sum.
    """
    zero = F.lit(0.0).cast("float")
    diff = [f32(x - y) for x, y in zip(a, b, strict=True)] + [zero] * (16 - len(a))
    wide = [d.cast("double") for d in diff]
    lane = [f32(wide[i + 8] * wide[i + 8] + f32(wide[i] * wide[i]).cast("double")) for i in range(8)]
    four = [f32(lane[i].cast("double") + lane[i + 4].cast("double")) for i in range(4)]
    return f32(f32(four[0].cast("double") + four[1].cast("double")).cast("double") + f32(four[2].cast("double") + four[3].cast("double")).cast("double"))
