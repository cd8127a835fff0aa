"""Whole-second and whole-minute arithmetic on timestamps."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

MICROS = 1_000_000


def seconds_between(start: str | Column, end: str | Column) -> Column:
    """Whole seconds from start to end, truncated towards zero (BIGINT)."""
    start, end = (F.col(c) if isinstance(c, str) else c for c in (start, end))
    return F.timestamp_diff("SECOND", start, end)


def shift_seconds(moment: Column, seconds: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(moment) + seconds.cast("bigint") * F.lit(MICROS))


def rounded_minutes(seconds: Column) -> Column:
    """Minutes as INT, halves away from zero."""
    return F.round(seconds / F.lit(60.0)).cast("int")
