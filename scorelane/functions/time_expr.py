"""Timestamps as text: the first 19 bytes count, an offset or fraction after them does not, and at least one byte follows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHAPE = r"(?s)^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}."


def valid(text: Column) -> Column:
    """Shape and a month from 1 to 12; days, hours, minutes and seconds have no range."""
    return F.coalesce(text.rlike(SHAPE), F.lit(False)) & F.coalesce(F.substring(text, 6, 2).try_cast("int").between(1, 12), F.lit(False))


def _part(text: Column, start: int, length: int, ok: Column | None = None) -> Column:
    return F.when(valid(text) if ok is None else ok, F.substring(text, start, length)).try_cast("int")


def hour(text: Column, ok: Column | None = None) -> Column:
    """ok, here and below: valid(text), where it was worked out before."""
    return _part(text, 12, 2, ok)


def day(text: Column, ok: Column | None = None) -> Column:
    """The date; days past the month's end run on into the next."""
    year, month = _part(text, 1, 4, ok), _part(text, 6, 2, ok)
    return F.date_add(F.make_date(year, month, F.lit(1)), _part(text, 9, 2, ok) - 1)


def weekday(text: Column) -> Column:
    """Monday is 0."""
    return F.weekday(day(text))


def epoch_seconds(text: Column, ok: Column | None = None, on: Column | None = None) -> Column:
    """on: day(text), where it was worked out before."""
    days = F.datediff(day(text, ok) if on is None else on, F.lit("1970-01-01").cast("date")).cast("bigint")
    return days * 86400 + _part(text, 12, 2, ok) * 3600 + _part(text, 15, 2, ok) * 60 + _part(text, 18, 2, ok)
