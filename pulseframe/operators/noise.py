"""Controlled noise. Draws are keyed, so a run can be repeated exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pulseframe.functions.keyed import normal, uniform
from pulseframe.operators.joins import attach
from pulseframe.operators.windows import variable_ids

KINDS = ("gaussian", "uniform", "shuffle")


def add_noise(
    events: DataFrame, kind: str, p: float, key_cols: list[str], magnitude: float = 0.1, seed: int = 42
) -> DataFrame:
    """Disturb each event with probability ``p``.

    ``gaussian`` adds N(0, 1) x sample std of the variable x ``magnitude``; ``uniform`` puts a draw
    between the minimum and maximum of the variable; ``shuffle`` replaces the variable by any one
    of all variables. ``key_cols`` tell the events apart.
    """
    if not 0 <= p <= 1:
        raise ValueError("p must be in [0, 1]")
    if kind not in KINDS:
        raise ValueError(f"unknown noise {kind}")
    hit = uniform(key_cols, seed, "hit") < F.lit(float(p))
    value = F.col("value")
    if kind == "gaussian":
        spread = events.groupBy("variable").agg(F.stddev_samp("value").alias("_std"))
        moved = value + normal(key_cols, seed, "shift") * F.col("_std") * F.lit(float(magnitude))
        noisy = attach(events, spread, "variable").withColumn("value", F.when(hit, moved).otherwise(value))
    elif kind == "uniform":
        bounds = events.groupBy("variable").agg(F.min("value").alias("_lo"), F.max("value").alias("_hi"))
        drawn = uniform(key_cols, seed, "draw") * (F.col("_hi") - F.col("_lo")) + F.col("_lo")
        noisy = attach(events, bounds, "variable").withColumn("value", F.when(hit, drawn).otherwise(value))
    else:
        names = variable_ids(events).withColumnRenamed("variable", "_other")
        count = names.agg(F.count(F.lit(1))).scalar()
        drawn = events.withColumn("var_id", F.floor(uniform(key_cols, seed, "pick") * count).cast("int"))
        noisy = attach(drawn, names, "var_id").withColumn(
            "variable", F.when(hit, F.col("_other")).otherwise(F.col("variable"))
        )
    return noisy.select(*events.columns)
