"""Event time and event rate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from pulseframe.functions.clock import rounded_minutes, seconds_between


def filter_active_stays(stays: DataFrame, events: DataFrame, min_events: int = 2) -> DataFrame:
    """Stays with at least ``min_events`` events."""
    active = events.groupBy("stay_id").count().filter(F.col("count") >= min_events)
    return stays.join(active, "stay_id", "left_semi")


def relative_minutes(events: DataFrame, stays: DataFrame) -> DataFrame:
    """Replace ``time`` by the rounded minute since the first event of the stay.

    The first time is taken over all events of the stay. The stays are filtered on the small
    per-stay table, so the events are shuffled once.
    """
    first = events.groupBy("stay_id").agg(F.min("time").alias("_first")).join(stays, "stay_id", "left_semi")
    keep = [c for c in events.columns if c != "time"]
    return events.join(first, "stay_id").select(
        *keep, rounded_minutes(seconds_between("_first", "time")).alias("minute")
    )


#: Names that a row's set of sources is kept for as bits of one long.
BITS = 62


def throttle_events(events: DataFrame, named: DataFrame | None = None) -> DataFrame:
    """One row per stay, minute and variable: mean value, set of sources, smallest unit.

    ``named`` is a table that is cheap to read and has every source and unit of the events. If these are few, they
    are numbered, so that the groups hold numbers only; else, and without it, sets and texts are gathered.
    """
    keys = ["stay_id", "minute", "variable"]
    mean = F.avg("value").alias("value")
    sources, units = ((_few(named, c) if named is not None else None) for c in ("source", "unit"))
    if sources is None or units is None:
        return events.groupBy(*keys).agg(
            mean, F.sort_array(F.collect_set("source")).alias("source"), F.min("unit").alias("unit")
        )

    def number(column: str, names: list[str], numbers: list[int]) -> Column:
        pairs = zip(names, numbers)
        return reduce(lambda acc, p: acc.when(F.col(column) == p[0], F.lit(p[1]).cast("bigint")), pairs, F.when(F.col(column).isNull(), None)).cast("bigint")

    bits = [1 << i for i in range(len(sources))]
    grouped = events.groupBy(*keys).agg(
        mean,
        F.coalesce(F.bit_or(number("source", sources, bits)), F.lit(0).cast("bigint")).alias("_sources"),
        F.min(number("unit", units, list(range(len(units))))).alias("_unit"),
    )
    present = [F.when(F.col("_sources").bitwiseAND(F.lit(bit)) != 0, F.lit(name)) for name, bit in zip(sources, bits)]
    source = F.array_compact(F.array(*present)) if present else F.array().cast("array<string>")
    unit = reduce(lambda acc, p: acc.when(F.col("_unit") == p[0], F.lit(p[1])), enumerate(units), F.when(F.lit(False), F.lit("")))
    return grouped.select(*keys, "value", source.alias("source"), unit.alias("unit"))


def _few(named: DataFrame, column: str) -> list[str] | None:
    """The distinct texts of a column in order, if at most ``BITS``; None if they are more."""
    rows = named.select(column).filter(F.col(column).isNotNull()).distinct().limit(BITS + 1).collect()
    return sorted((r[0] for r in rows), key=str.encode) if len(rows) <= BITS else None
