"""Running aggregates, row numbers and exact quantiles without one task per key.

A window over a whole key puts a hot key into one task. Here the rows are range-sorted over all
tasks and stored; each stored range yields one partial per key, the few partials of a key are
accumulated, and the running value inside a range starts from what the earlier ranges left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pulseframe.session import settle

RANGE = "_range"
FOLDS = {
    "sum": (F.sum, lambda a, b: a + F.coalesce(b, F.lit(0))),
    "max": (F.max, lambda a, b: F.greatest(a, b)),
    "min": (F.min, lambda a, b: F.least(a, b)),
}


def sort_and_store(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """Globally sorted rows, stored, with the number of the range each row lies in."""
    return settle(df.orderBy(*keys, *order)).withColumn(RANGE, F.spark_partition_id())


def running(
    df: DataFrame,
    keys: list[str],
    order: list[Column | str],
    folds: dict[str, tuple[str, Column]],
    totals: bool = False,
    backward: dict[str, tuple[str, Column]] | None = None,
) -> DataFrame:
    """Add running aggregates per key, from the first row up to and including each row.

    ``order`` must tell the rows of a key apart. ``folds`` maps a new column to
    (``sum`` | ``max`` | ``min``, expression); ``backward`` does the same from the last row down
    (``order`` is then a list of names).
    With ``totals`` each forward column also gets ``<name>_total``, its value over the whole key.
    """
    backward = backward or {}
    stored = sort_and_store(df, keys, order)
    aggregates = [FOLDS[kind][0](expr).alias(name) for name, (kind, expr) in {**folds, **backward}.items()]
    parts = stored.groupBy(*keys, RANGE).agg(*aggregates)

    # A frame that reaches to the end would be summed anew for every row, so the backward
    # aggregates run forward over the reversed order.
    first_to_here = (Window.unboundedPreceding, Window.currentRow)
    whole, inside = Window.partitionBy(*keys), Window.partitionBy(*keys, RANGE)
    ways = [
        (folds, F.col(RANGE), order),
        (backward, F.desc(RANGE), [F.desc(c) for c in order] if backward else []),
    ]
    carried = []
    for wanted, direction, _ in ways:
        earlier = whole.orderBy(direction).rowsBetween(Window.unboundedPreceding, -1)
        carried += [FOLDS[kind][0](name).over(earlier).alias(f"_{name}") for name, (kind, _) in wanted.items()]
    if totals:
        carried += [FOLDS[kind][0](name).over(whole).alias(f"{name}_total") for name, (kind, _) in folds.items()]
    joined = stored.join(parts.select(*keys, RANGE, *carried), [*keys, RANGE])
    for wanted, _, rows in ways:
        upto = inside.orderBy(*rows).rowsBetween(*first_to_here) if wanted else None
        for name, (kind, expr) in wanted.items():
            fold, merge = FOLDS[kind]
            joined = joined.withColumn(name, merge(fold(expr).over(upto), F.col(f"_{name}")))
    return joined.drop(RANGE, *[f"_{name}" for name in {**folds, **backward}])


def numbered(df: DataFrame, order: list[Column | str], name: str = "row", keys: list[str] | None = None) -> DataFrame:
    """1-based row number over ``order`` (which must be unique within ``keys``)."""
    return running(df, keys or [], order, {name: ("sum", F.lit(1).cast("bigint"))})


def value_counts(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """One row per distinct value of a key: its copies, the copies up to it, and all of the key."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("copies"))
    return running(counts, keys, [value], {"upto": ("sum", F.col("copies"))}, totals=True)


def exact_quantiles(df: DataFrame, keys: list[str], quantiles: dict[str, float], value: str = "value") -> DataFrame:
    """Exact interpolated quantiles per key (``percentile`` semantics), one column per entry."""
    ranked = value_counts(df, keys, value)

    def at(rank: Column) -> Column:
        holds = (F.col("upto") - F.col("copies") <= rank) & (rank < F.col("upto"))
        return F.max(F.when(holds, F.col(value)))

    columns = []
    for name, p in quantiles.items():
        position = (F.col("upto_total") - 1) * F.lit(float(p))
        below = at(F.floor(position))
        above = at(F.ceil(position))
        share = F.max(position - F.floor(position))
        columns.append((below + (above - below) * share).alias(name))
    return ranked.groupBy(*keys).agg(*columns)
