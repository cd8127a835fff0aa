"""Cleaned relations from the raw tables.

Each ``clean_*`` takes raw DataFrames; ``read_*`` scans the parquet files of a directory first.
Only stays of adults count, so event readers are restricted to them.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulseframe.functions.schema import require_not_null, to_canonical
from pulseframe.session import settle

ADULT_AGE = 18
WEIGHT_CODE = 224639  # fixed value: weights noted beside an infusion have no code of their own


def scan(spark: SparkSession, directory: str, table: str) -> DataFrame:
    return spark.read.parquet(os.path.join(directory, f"{table}.parquet"))


def clean_patients(patients: DataFrame) -> DataFrame:
    return to_canonical(require_not_null(patients, ["SUBJECT_ID", "DOB", "GENDER"]))


def clean_adult_stays(stays: DataFrame, patients: DataFrame) -> DataFrame:
    """Stays with all keys and times, of patients aged 18 or more; a missing birth date counts as age 0.

    ``patients`` is the cleaned table.
    """
    known = to_canonical(require_not_null(stays, ["INTIME", "OUTTIME", "ICUSTAY_ID", "HADM_ID", "SUBJECT_ID"]))
    age = F.coalesce(F.year("time_start") - F.year("dob"), F.lit(0))
    return (
        known.join(patients.select("patient_id", "dob"), "patient_id", "left")
        .withColumn("age", age)
        .filter(F.col("age") >= ADULT_AGE)
        .select(*known.columns, "age")
    )


def clean_admissions(admissions: DataFrame, stays: DataFrame) -> DataFrame:
    """Admissions that have an adult stay, with the outcome as boolean."""
    known = to_canonical(require_not_null(admissions, ["HADM_ID", "SUBJECT_ID", "HOSPITAL_EXPIRE_FLAG"]))
    own = stays.select("admission_id").distinct()
    return known.withColumn("died", F.col("died").cast("boolean")).join(own, "admission_id", "left_semi").select(*known.columns)


def clean_items(*dictionaries: DataFrame) -> DataFrame:
    """The code dictionaries as one table."""
    stacked = dictionaries[0]
    for other in dictionaries[1:]:
        stacked = stacked.unionByName(other, allowMissingColumns=True)
    return to_canonical(require_not_null(stacked, ["ITEMID", "LABEL"])).select("code", "name")


def _of_stays(events: DataFrame, stays: DataFrame) -> DataFrame:
    return events.join(stays.select("stay_id"), "stay_id", "left_semi").select(*events.columns)


def clean_point_events(events: DataFrame, stays: DataFrame) -> DataFrame:
    """Output events: a time, code and value in a known stay."""
    known = require_not_null(events, ["CHARTTIME", "ITEMID", "VALUE", "ICUSTAY_ID", "SUBJECT_ID"])
    return _of_stays(to_canonical(known), stays)


def _readings(events: DataFrame) -> DataFrame:
    """Number and text of a reading side by side; rows with neither are dropped."""
    has_value = F.col("VALUENUM").isNotNull() | F.col("VALUE").isNotNull()
    named = events.filter(has_value).withColumnsRenamed({"VALUENUM": "value_num", "VALUE": "value_text"})
    return named.withColumn("value_num", F.col("value_num").cast("double"))


def clean_charted(events: DataFrame, stays: DataFrame) -> DataFrame:
    """Charted readings without an error flag; the value is a number or a text."""
    sound = events.filter((F.col("ERROR") == 0) | F.col("ERROR").isNull())
    known = require_not_null(_readings(sound), ["CHARTTIME", "ITEMID", "SUBJECT_ID", "ICUSTAY_ID"])
    return _of_stays(to_canonical(known), stays)


def clean_lab(events: DataFrame) -> DataFrame:
    """Lab readings; they name an admission only, ``attach_stay`` finds the stay."""
    known = require_not_null(_readings(events), ["HADM_ID", "CHARTTIME", "ITEMID", "SUBJECT_ID"])
    return to_canonical(known)


def clean_interval_events(events: DataFrame, stays: DataFrame) -> DataFrame:
    """Inputs given over a time span."""
    known = require_not_null(
        events, ["STARTTIME", "ENDTIME", "ITEMID", "AMOUNT", "ICUSTAY_ID", "AMOUNTUOM", "SUBJECT_ID"]
    )
    return _of_stays(to_canonical(known), stays)


def clean_point_inputs(events: DataFrame, stays: DataFrame) -> DataFrame:
    """Inputs given at one moment; the unit may be missing."""
    known = require_not_null(events, ["CHARTTIME", "ITEMID", "AMOUNT", "ICUSTAY_ID", "SUBJECT_ID"])
    return _of_stays(to_canonical(known), stays)


def clean_derived_weight(events: DataFrame, stays: DataFrame) -> DataFrame:
    """Weights noted beside interval inputs, as events of their own."""
    known = require_not_null(events, ["STARTTIME", "PATIENTWEIGHT", "ICUSTAY_ID", "SUBJECT_ID"]).select(
        F.col("ICUSTAY_ID").alias("stay_id"),
        F.col("SUBJECT_ID").alias("patient_id"),
        F.lit(WEIGHT_CODE).cast("bigint").alias("code"),
        F.col("STARTTIME").alias("time"),
        F.col("PATIENTWEIGHT").cast("double").alias("value"),
        F.lit("kg").alias("unit"),
    )
    return _of_stays(known, stays)


class RawData:
    """The cleaned relations over one set of raw tables, given as a function from name to DataFrame."""

    def __init__(self, table):
        self.table = table
        self._stays = None

    @classmethod
    def at(cls, spark: SparkSession, directory: str) -> "RawData":
        return cls(lambda name: scan(spark, directory, name))

    def patients(self) -> DataFrame:
        return clean_patients(self.table("PATIENTS"))

    def adult_stays(self) -> DataFrame:
        """Stored on first use: every event reader is restricted to these stays."""
        if self._stays is None:
            self._stays = settle(clean_adult_stays(self.table("ICUSTAYS"), self.patients()))
        return self._stays

    def admissions(self) -> DataFrame:
        return clean_admissions(self.table("ADMISSIONS"), self.adult_stays())

    def items(self) -> DataFrame:
        return clean_items(self.table("D_ITEMS"), self.table("D_LABITEMS"))

    def point_events(self) -> DataFrame:
        return clean_point_events(self.table("OUTPUTEVENTS"), self.adult_stays())

    def charted(self) -> DataFrame:
        return clean_charted(self.table("CHARTEVENTS"), self.adult_stays())

    def lab(self) -> DataFrame:
        return clean_lab(self.table("LABEVENTS"))

    def interval_events(self) -> DataFrame:
        return clean_interval_events(self.table("INPUTEVENTS_MV"), self.adult_stays())

    def point_inputs(self) -> DataFrame:
        return clean_point_inputs(self.table("INPUTEVENTS_CV"), self.adult_stays())

    def derived_weight(self) -> DataFrame:
        return clean_derived_weight(self.table("INPUTEVENTS_MV"), self.adult_stays())
