"""Cohorts, demographics and entity-disjoint splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pulseframe.functions.clock import seconds_between
from pulseframe.functions.keyed import uniform

FRACTIONS = {"train": 0.64, "test": 0.2, "val": 0.16}


def eligible_cohort(stays: DataFrame, events: DataFrame, admissions: DataFrame, hours: int = 24) -> DataFrame:
    """Stays of at least ``hours``, survived for as long, with an event in that time; adds ``died``."""
    long_enough = stays.filter(seconds_between("time_start", "time_end") >= hours * 3600)
    outcome = admissions.select("admission_id", "death_time", "died")
    survived = (
        long_enough.join(outcome, "admission_id")
        .filter(F.col("death_time").isNull() | (seconds_between("time_start", "death_time") >= hours * 3600))
        .select(*stays.columns, "died")
    )
    observed = events.filter(F.col("minute") < hours * 60).select("stay_id").distinct()
    return survived.join(observed, "stay_id", "left_semi").select(*stays.columns, "died")


def demographics(stays: DataFrame, patients: DataFrame, age_cap: int = 200, age_value: float = 91.4) -> DataFrame:
    """Age (obscured ages replaced) and gender code (0 for M) of every stay.

    Ages cover all stays and genders a subset of them, so their full outer join is one left join.
    """
    known = patients.select("patient_id", "gender", F.lit(True).alias("_known"))
    code = F.when(F.col("gender") == "M", 0).otherwise(1)
    return stays.select("stay_id", "patient_id", "age").join(known, "patient_id", "left").select(
        "stay_id",
        F.when(F.col("age") > age_cap, F.lit(age_value)).otherwise(F.col("age").cast("double")).alias("age"),
        F.when(F.col("_known"), code).alias("gender"),
    )


def split_by_entity(
    stays: DataFrame, entity: str = "patient_id", fractions: dict[str, float] = FRACTIONS, seed: int = 42
) -> DataFrame:
    """Assign stays to splits so that no entity is in two of them.

    The split is a function of the entity key alone: no shuffle, and new data keep old assignments.
    """
    if abs(sum(fractions.values()) - 1) > 1e-9:
        raise ValueError("fractions must sum to 1")
    draw = uniform([entity], seed, "split")
    names, upper, split = list(fractions), 0.0, F
    for name in names[:-1]:
        upper += fractions[name]
        split = split.when(draw < F.lit(upper), F.lit(name))
    last = F.lit(names[-1])
    return stays.select("stay_id", (split.otherwise(last) if len(names) > 1 else last).alias("split"))


def split_from_lists(stays: DataFrame, lists: DataFrame) -> DataFrame:
    """Splits given as a table ``(stay_id, split)``; stays not listed are left out."""
    return stays.select("stay_id").join(lists.select("stay_id", "split"), "stay_id")


def train_complement(events: DataFrame, splits: DataFrame) -> DataFrame:
    """Stays with events that are in neither the test nor the validation split."""
    held_out = splits.filter(F.col("split").isin("test", "val")).select("stay_id")
    return events.select("stay_id").distinct().join(held_out, "stay_id", "left_anti")


def complete_splits(events: DataFrame, splits: DataFrame) -> DataFrame:
    """Split map over all stays: the complement as train, test and validation as given."""
    train = train_complement(events, splits).withColumn("split", F.lit("train"))
    return train.unionByName(splits.filter(F.col("split").isin("test", "val")).select("stay_id", "split"))
