"""Joins with a size check, and point-in-interval joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pulseframe.session import settle, stored_size

BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 64 * 2**20


def attach(
    left: DataFrame,
    dim: DataFrame,
    on: str | list[str],
    how: str = "inner",
    max_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Join ``left`` to a computed dimension, broadcasting it only when its measured size is within bounds.

    Catalyst cannot know the size of a query result before it has shuffled the large side too. So
    the dimension is stored first, then measured. A larger dimension is joined by a shuffle, in
    which adaptive execution splits the hot keys of ``left``. Tables whose size Catalyst does know
    (rules, files) need no help: a plain join broadcasts them below its own limit.
    """
    dim = settle(dim)
    rows, size = stored_size(dim)
    if rows <= max_rows and size <= BROADCAST_BYTES:
        dim = F.broadcast(dim)
    return left.join(dim, on, how)


def interval_join(
    points: DataFrame,
    intervals: DataFrame,
    keys: list[str],
    point: Column,
    low: Column,
    high: Column,
    cell: int,
) -> DataFrame:
    """Inner join where ``low <= point <= high`` within equal ``keys``; bounds are whole numbers.

    The axis is cut into cells of ``cell`` units. Each point lies in one cell and each interval is
    listed once per cell it touches, so a match meets exactly once, the join is an equi-join, and
    one key with a long history is spread over its cells.
    """
    located = points.withColumn("_point", point).withColumn("_cell", F.floor(F.col("_point") / cell))
    covered = (
        intervals.withColumn("_low", low)
        .withColumn("_high", high)
        .filter("_low <= _high")
        .withColumn(
            "_cell", F.explode(F.sequence(F.floor(F.col("_low") / cell), F.floor(F.col("_high") / cell)))
        )
    )
    return (
        located.join(covered, [*keys, "_cell"])
        .filter(F.col("_point").between(F.col("_low"), F.col("_high")))
        .drop("_point", "_low", "_high", "_cell")
    )
