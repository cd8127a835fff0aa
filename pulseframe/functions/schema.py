"""Canonical column names and types, and the not-null contract of the readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, types as T

# Raw column name -> canonical name.
CANONICAL_NAMES = {
    "ICUSTAY_ID": "stay_id",
    "ITEMID": "code",
    "AMOUNT": "value",
    "AMOUNTUOM": "unit",
    "VALUE": "value",
    "VALUENUM": "value",
    "VALUEUOM": "unit",
    "SUBJECT_ID": "patient_id",
    "CHARTTIME": "time",
    "STARTTIME": "time_start",
    "ENDTIME": "time_end",
    "HADM_ID": "admission_id",
    "HOSPITAL_EXPIRE_FLAG": "died",
    "DEATHTIME": "death_time",
    "AGE": "age",
    "DOB": "dob",
    "GENDER": "gender",
    "LABEL": "name",
    "INTIME": "time_start",
    "OUTTIME": "time_end",
}

# Output columns are always in this order.
COLUMN_ORDER = (
    "stay_id", "patient_id", "admission_id", "code", "name", "variable", "time", "time_start", "time_end",
    "minute", "value", "value_num", "value_text", "unit", "source", "dob", "gender", "age", "death_time", "died",
)

RULE_SCHEMA = T.StructType([
    T.StructField("code", T.LongType(), False),
    T.StructField("variable", T.StringType(), False),
    T.StructField("sel_kind", T.StringType(), False),
    T.StructField("a", T.DoubleType()),
    T.StructField("b", T.DoubleType()),
    T.StructField("sel_unit", T.StringType()),
    T.StructField("text_map", T.MapType(T.StringType(), T.DoubleType())),
    T.StructField("lo", T.DoubleType()),
    T.StructField("hi", T.DoubleType()),
    T.StructField("units", T.ArrayType(T.StringType())),
    T.StructField("unit_waiver", T.BooleanType(), False),
    T.StructField("action", T.StringType()),
    T.StructField("categorical", T.BooleanType(), False),
])


def require_not_null(df: DataFrame, columns: list[str]) -> DataFrame:
    """Keep rows where every listed column is present; Catalyst then knows they are not null."""
    return df.na.drop(how="any", subset=columns)


def to_canonical(df: DataFrame) -> DataFrame:
    """Rename raw columns and keep the known ones, in fixed order."""
    renamed = df.withColumnsRenamed({c: CANONICAL_NAMES[c] for c in df.columns if c in CANONICAL_NAMES})
    return renamed.select(*[F.col(c) for c in COLUMN_ORDER if c in renamed.columns])
