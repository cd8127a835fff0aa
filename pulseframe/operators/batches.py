"""Batches, folds and resampling of samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pulseframe.functions.keyed import uniform
from pulseframe.operators.joins import attach
from pulseframe.operators.ordered import numbered, running
from pulseframe.operators.windows import WINDOW
from pulseframe.session import settle

PAD_STEP = 8
PADDED = ("values", "times", "variables")


def length_batches(samples: DataFrame, batch_size: int, keys: tuple[str, ...] = WINDOW) -> DataFrame:
    """Add ``batch_id``: samples from the longest to the shortest, ``batch_size`` at a time."""
    samples = settle(samples)  # ordering reads only the lengths; the arrays are joined back
    lengths = samples.select(*keys, F.size("values").alias("_length"))
    placed = numbered(lengths, [F.desc("_length"), *keys])
    batch = F.floor((F.col("row") - 1) / batch_size).alias("batch_id")
    return samples.join(placed.select(*keys, batch), list(keys))


def pad_batches(batches: DataFrame, pad: int, step: int = PAD_STEP) -> DataFrame:
    """Pad the arrays of a batch to its longest one, rounded up to ``step``; add ``input_mask``."""
    width = F.ceil(F.max(F.size("values")) / step).cast("int") * step
    widths = batches.groupBy("batch_id").agg(width.alias("_width"))
    types = dict(batches.dtypes)
    length = F.size("values")

    def padded(name):
        filler = F.array_repeat(F.lit(pad), F.col("_width") - length).cast(types[name])
        return F.concat(F.col(name), filler)

    mask = F.concat(
        F.array_repeat(F.lit(True), length), F.array_repeat(F.lit(False), F.col("_width") - length)
    )
    return batches.join(widths, "batch_id").select(
        *[padded(c).alias(c) if c in PADDED else F.col(c) for c in batches.columns], mask.alias("input_mask")
    )


def fold_subset(ids: DataFrame, fraction: float, fold: int, folds: int, key: str = "stay_id", seed: int = 42) -> DataFrame:
    """A contiguous slice of ceil(fraction x n) ids of a fixed random order; ``fold`` is 0-based.

    The slices of the folds start evenly between the beginning and the last possible place.
    """
    if not 0 <= fold < folds:
        raise ValueError("fold must be in [0, folds)")
    if fraction == 1:
        return ids
    order = ids.select(key, uniform([key], seed, "fold").alias("_u"))
    placed = running(order, [], ["_u", key], {"row": ("sum", F.lit(1).cast("bigint"))}, totals=True)
    size = F.ceil(F.lit(float(fraction)) * F.col("row_total"))
    start = F.floor(F.lit(fold) * (F.col("row_total") - size) / F.lit(max(folds - 1, 1)))
    chosen = placed.filter((F.col("row") > start) & (F.col("row") <= start + size))
    return ids.join(chosen.select(key), key, "left_semi")


def repeat_rows(df: DataFrame, times: int) -> DataFrame:
    """Every row ``times`` times, numbered from 1 in ``repeat``."""
    return df.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(times))))


def class_weights(labels: DataFrame, label: str = "label") -> DataFrame:
    """Sampling weight of each class: 1 / its count / number of classes."""
    counts = labels.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    classes = labels.agg(F.count_distinct(label)).scalar()
    return counts.withColumn("weight", F.lit(1.0) / F.col("n") / classes)


def balanced_resample(
    samples: DataFrame, keys: list[str], label: str = "label", batch_size: int = 1, seed: int = 42
) -> DataFrame:
    """Draw max(n, ``batch_size``) samples with replacement, every class equally likely.

    A draw names a class and a place in it, which an equi-join looks up; places are spread evenly,
    so no task receives a whole class.
    """
    placed = numbered(samples, keys, "_place", [label])
    counts = samples.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    classes = numbered(counts, [label], "_class")
    class_count = counts.agg(F.count(F.lit(1))).scalar()
    draws = samples.sparkSession.range(max(samples.count(), batch_size)).withColumnRenamed("id", "draw")
    wanted = attach(
        draws.withColumn("_class", F.floor(uniform(["draw"], seed, "class") * class_count) + 1), classes, "_class"
    ).withColumn("_place", F.floor(uniform(["draw"], seed, "place") * F.col("_n")) + 1)
    return wanted.select("draw", label, "_place").join(placed, [label, "_place"]).select("draw", *samples.columns)


def class_prevalence(labels: DataFrame, label: str = "label") -> DataFrame:
    """One row: share of positives and the weight (1 - p) / p, which is 1 without positives."""
    share = F.avg(F.col(label).cast("double"))
    return labels.agg(share.alias("pos_class_frac")).withColumn(
        "pos_class_weight",
        F.when(F.col("pos_class_frac") == 0, F.lit(1.0)).otherwise(
            F.try_divide(F.lit(1.0) - F.col("pos_class_frac"), F.col("pos_class_frac"))
        ),
    )
