"""Model input: what is fitted on the training split, and samples of any split made with it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulseframe.operators import batches, scalers, windows
from pulseframe.operators.joins import attach
from pulseframe.session import settle

VERSION = 1
SAMPLE = ("stay_id", "draw", "t1")


@dataclass(frozen=True)
class Fitted:
    """Vocabulary with the scale of each variable (variable, var_id, mean, std), the scale of ages (mean, std), and the window's length."""

    variables: DataFrame
    demographics: DataFrame
    max_minute: int


def fit(events: DataFrame, demographics: DataFrame, max_minute: int, top: int = 0) -> Fitted:
    """Fit on the training split: its ``top`` most frequent variables (0: all) and its demographics."""
    events = windows.top_variables(events, top)
    vocabulary = windows.variable_ids(events).join(scalers.zscore_fit(events), "variable")
    return Fitted(settle(vocabulary), settle(scalers.demographic_fit(demographics)), max_minute)


def save(fitted: Fitted, path: str) -> None:
    """Store the tables, and last the settings, whose presence says that the tables are whole."""
    fitted.variables.write.mode("overwrite").parquet(f"{path}/variables.parquet")
    fitted.demographics.write.mode("overwrite").parquet(f"{path}/demographics.parquet")
    settings = fitted.variables.agg(
        F.lit(VERSION).alias("version"), F.lit(fitted.max_minute).alias("max_minute"), F.count(F.lit(1)).alias("variables"),
        F.coalesce(F.sum(F.xxhash64("variable", "var_id", "mean", "std").cast("decimal(38,0)")), F.lit(0)).cast("string").alias("state"),
    )
    settings.write.mode("overwrite").parquet(f"{path}/settings.parquet")


def load(spark: SparkSession, path: str) -> Fitted:
    """The stored tables; refused if they are of another version or not those the settings were written for."""
    settings = spark.read.parquet(f"{path}/settings.parquet").first()
    if settings["version"] != VERSION:
        raise ValueError(f"{path} has version {settings['version']}, not {VERSION}")
    fitted = Fitted(spark.read.parquet(f"{path}/variables.parquet"), spark.read.parquet(f"{path}/demographics.parquet"), settings["max_minute"])
    state = fitted.variables.agg(F.coalesce(F.sum(F.xxhash64("variable", "var_id", "mean", "std").cast("decimal(38,0)")), F.lit(0)).cast("string")).first()[0]
    if state != settings["state"]:
        raise ValueError(f"{path} was not written whole")
    return fitted


def same(one: Fitted, two: Fitted) -> bool:
    """Whether two fitted states scale and number everything alike."""
    pairs = ((one.variables, two.variables), (one.demographics, two.demographics))
    return one.max_minute == two.max_minute and all(scalers.scaler_tables_equal(a, b).first()["equal"] for a, b in pairs)


def encode(events: DataFrame, fitted: Fitted) -> DataFrame:
    """(stay_id, minute, variable, var_id, value) with values scaled; events of variables outside the vocabulary are dropped."""
    scaled = ((F.col("value") - F.col("mean")) / F.col("std")).alias("value")
    return attach(events.select("stay_id", "minute", "variable", "value"), fitted.variables, "variable").select("stay_id", "minute", "variable", "var_id", scaled)


def pretrain_input(
    events: DataFrame, demographics: DataFrame, fitted: Fitted, *, min_input: int, forecast: int, max_events: int,
    dropout: float = 0.0, draws: int = 1, seed: int = 42,
) -> DataFrame:
    """Samples (stay_id, draw, t1, values, times, variables, demographics, forecast_values, forecast_mask) of a split.

    Minutes count from the first event of the stay that is in the vocabulary. A window that dropout empties
    gives way to the next end in its stay's order. Forecasts are means of scaled values.
    """
    rows = settle(windows.rebase_minutes(encode(events, fitted)))
    ends = windows.window_candidates(rows, min_input)
    kept = settle(windows.kept_windows(rows, ends, fitted.max_minute, dropout, draws, seed))
    inside = windows.input_window(rows, kept, fitted.max_minute).join(kept, ["stay_id", "t1", "variable"])
    targets = windows.forecast_targets(rows.drop("var_id"), kept, fitted.variables.select("variable", "var_id"), forecast)
    traits = scalers.demographic_scale(demographics, fitted.demographics)
    samples = windows.assemble_samples(inside, traits, fitted.max_minute, max_events, seed=seed, keys=SAMPLE)
    return samples.join(targets.withColumn("forecast_values", F.col("forecast_values").cast("array<float>")), ["stay_id", "t1"])


def finetune_input(
    events: DataFrame, labels: DataFrame, demographics: DataFrame, fitted: Fitted, *, max_events: int, dropout: float = 0.0, seed: int = 42
) -> DataFrame:
    """Samples (stay_id, t1, values, times, variables, demographics, label) of the labeled stays of a split, with the fitted state of another."""
    rows = windows.supervised_windows(encode(events, fitted), labels, fitted.max_minute)
    listed = windows.first_kept(rows.select("stay_id", "variable").distinct(), ["stay_id", "variable"], dropout, seed)
    least = listed.groupBy("stay_id").agg(F.min("cycle").alias("cycle"))
    kept = listed.join(least, ["stay_id", "cycle"]).select("stay_id", "variable")
    traits = scalers.demographic_scale(demographics, fitted.demographics)
    return windows.assemble_samples(rows.join(kept, ["stay_id", "variable"]), traits, fitted.max_minute, max_events, seed=seed)


def batched(samples: DataFrame, batch_size: int, pad: int, keys: tuple[str, ...] = SAMPLE) -> DataFrame:
    """Samples in padded batches of about equal length."""
    return batches.pad_batches(settle(batches.length_batches(samples, batch_size, keys)), pad)
