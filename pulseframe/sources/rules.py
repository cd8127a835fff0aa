"""Feature rules as a table: which code is which variable, how its value is read, what is valid."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from pulseframe.functions.schema import RULE_SCHEMA

SELECTORS = ("identity", "linear", "percent", "text_map", "unit_scale", "constant")
ACTIONS = (None, "remove", "replace_with_median")

# Unit -> (factor, unit after conversion).
UNIT_RULES = {"mcg": (0.001, "mg"), "L": (1000.0, "ml")}

DEFAULTS = {
    "sel_kind": "identity", "a": None, "b": None, "sel_unit": None, "text_map": None, "lo": None, "hi": None,
    "units": None, "unit_waiver": False, "action": None, "categorical": False,
}


def rules_table(spark: SparkSession, features) -> DataFrame:
    """One row per code from feature dictionaries with a ``codes`` list (or a single ``code``)."""
    rows = []
    for feature in features:
        spec = {**DEFAULTS, **{k: v for k, v in feature.items() if k not in ("code", "codes")}}
        rows += [{**spec, "code": code} for code in feature.get("codes", [feature.get("code")])]
    # From Arrow the rows become a local relation of known size, which Catalyst broadcasts by itself.
    return spark.createDataFrame(pa.Table.from_pylist(rows, to_arrow_schema(RULE_SCHEMA)), RULE_SCHEMA)


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules kept by the user as parquet or JSON lines with the columns of ``RULE_SCHEMA``."""
    if path.endswith((".json", ".jsonl")):
        return spark.read.schema(RULE_SCHEMA).json(path)
    return spark.read.schema(RULE_SCHEMA).parquet(path)


def check_rules(rules: DataFrame) -> DataFrame:
    """Raise unless codes are unique, kinds are known and rules of one variable agree on validity."""
    kinds = rules.filter(
        ~F.col("sel_kind").isin(*SELECTORS) | ~F.coalesce(F.col("action"), F.lit("remove")).isin(*ACTIONS[1:])
    )
    repeated = rules.groupBy("code").count().filter("count > 1")
    validity = F.to_json(F.struct("lo", "hi", "units", "unit_waiver", "action"))
    torn = rules.groupBy("variable").agg(F.count_distinct(validity).alias("n")).filter("n > 1")
    for bad, message in (
        (kinds, "unknown selector or action"),
        (repeated, "a code has two rules"),
        (torn, "rules of one variable differ in their filtering"),
    ):
        row = bad.first()
        if row is not None:
            raise ValueError(f"{message}: {row.asDict()}")
    return rules
