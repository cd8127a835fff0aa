"""From raw event rows to numeric events of named variables."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from pulseframe.functions.clock import seconds_between, shift_seconds
from pulseframe.operators.joins import attach, interval_join
from pulseframe.operators.ordered import value_counts
from pulseframe.session import settle
from pulseframe.sources.rules import UNIT_RULES

DAY = 86_400
TAIL_SECONDS = 300
EVENT_COLUMNS = ("value_num", "value_text", "code", "unit", "time", "source", "stay_id")


def convert_units(events: DataFrame, unit_rules: dict[str, tuple[float, str]] = UNIT_RULES) -> DataFrame:
    """Scale ``value`` of the listed units and rename them; other rows and null units stay."""
    value, unit = F.col("value"), F.col("unit")
    new_value = reduce(lambda acc, r: acc.when(unit == r[0], value * F.lit(r[1][0])), unit_rules.items(), F)
    new_unit = reduce(lambda acc, r: acc.when(unit == r[0], F.lit(r[1][1])), unit_rules.items(), F)
    return events.withColumns({"value": new_value.otherwise(value), "unit": new_unit.otherwise(unit)})


def with_value_columns(events: DataFrame) -> DataFrame:
    """Two value columns for sources that have one: a number, or a text for categorical readings."""
    if "value_num" in events.columns:
        return events
    return events.withColumnRenamed("value", "value_num").withColumn("value_text", F.lit(None).cast("string"))


def assemble_events(sources: dict[str, DataFrame], codes: DataFrame) -> DataFrame:
    """Stack the sources under their names and keep rows of registered codes."""
    tagged = [with_value_columns(df).withColumn("source", F.lit(name)) for name, df in sources.items()]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    for column, kind in (("unit", "string"), ("stay_id", "bigint")):
        if column not in stacked.columns:
            stacked = stacked.withColumn(column, F.lit(None).cast(kind))
    return stacked.select(*EVENT_COLUMNS).join(codes.select("code"), "code", "left_semi").select(*EVENT_COLUMNS)


def distribute_interval_hourly(events: DataFrame, tail_seconds: int = TAIL_SECONDS) -> DataFrame:
    """Spread the amount of each interval over its hours; the amounts still add up.

    Up to one hour gives one row at the end. A longer interval gives one row per full hour but the
    last, then the last hour and the remainder: as two rows, or as one when the remainder is
    shorter than ``tail_seconds``. A negative length gives nothing.
    """
    length, piece = F.col("_length"), F.col("_piece")
    hours, rest = F.floor(length / 3600), length % 3600
    short, joined_tail = length <= 3600, rest < tail_seconds
    pieces = F.when(short, F.lit(1).cast("bigint")).when(joined_tail, hours).otherwise(hours + 1)
    last = piece == pieces
    back = F.when(last, F.lit(0).cast("bigint")).otherwise(length - piece * 3600)
    hourly = F.col("value") * F.lit(3600.0) / length
    amount = (
        F.when(short, F.col("value"))
        .when(~last, hourly)
        .when(joined_tail, hourly * (rest / 3600 + 1))
        .otherwise(hourly * rest / 3600)
    )
    keep = [c for c in events.columns if c not in ("time", "value")]
    return (
        events.withColumn("value", F.col("value").cast("double"))
        .withColumn("_length", seconds_between("time_start", "time_end"))
        .filter("_length >= 0")
        .withColumn("_piece", F.explode(F.sequence(F.lit(1).cast("bigint"), pieces)))
        .select(*keep, shift_seconds(F.col("time_end"), -back).alias("time"), amount.alias("value"))
    )


def attach_stay(
    events: DataFrame, stays: DataFrame, key: str = "admission_id", margin_seconds: int = 3600, cell: int = DAY
) -> DataFrame:
    """Give each event the stays of its admission whose padded span holds it.

    An event inside two padded spans appears twice, one inside none is dropped.
    """
    if "stay_id" in events.columns:
        raise ValueError("events already have a stay_id")
    micros = 1_000_000
    spans = stays.select(
        key,
        "stay_id",
        (F.unix_micros("time_start") - margin_seconds * micros).alias("_from"),
        (F.unix_micros("time_end") + margin_seconds * micros).alias("_to"),
    )
    matched = interval_join(
        events, spans, [key], F.unix_micros("time"), F.col("_from"), F.col("_to"), cell * micros
    )
    return matched.select(*events.columns, "stay_id")


def apply_value_selectors(events: DataFrame, rules: DataFrame) -> DataFrame:
    """One numeric ``value`` per event by the selector of its code; rows without one are dropped.

    A selector that gives nothing falls back to the raw value. Events whose code has no rule keep
    their raw value.
    """
    selector = rules.select("code", "sel_kind", "a", "b", "sel_unit", "text_map")
    raw = F.coalesce(F.col("value_num"), F.col("value_text").try_cast("double"))
    kind, a, b = F.col("sel_kind"), F.col("a"), F.col("b")
    text = F.coalesce(F.col("value_num").cast("string"), F.col("value_text"))
    chosen = (
        F.when(kind == "linear", raw * a + b)
        .when(kind == "percent", F.when(raw > 1, raw / 100).otherwise(raw))
        .when(kind == "text_map", F.try_element_at(F.col("text_map"), text))
        .when(kind == "unit_scale", F.when(F.col("unit") == F.col("sel_unit"), raw / a).otherwise(raw))
        .when(kind == "constant", a)
    )
    return (
        events.join(selector, "code", "left")
        .withColumn("value", F.coalesce(chosen, raw))
        .filter(F.col("value").isNotNull())
        .drop("sel_kind", "a", "b", "sel_unit", "text_map", "value_num", "value_text")
    )


def map_code_to_variable(events: DataFrame, rules: DataFrame) -> DataFrame:
    """Add the variable name of each code; codes without a rule are dropped."""
    return events.join(rules.select("code", "variable"), "code")


def _validity(rules: DataFrame) -> DataFrame:
    columns = ("lo", "hi", "units", "unit_waiver", "action")
    torn = F.count_distinct(F.to_json(F.struct(*columns))) > 1
    agreed = rules.groupBy("variable").agg(torn.alias("torn"), *[F.first(c).alias(c) for c in columns])
    error = F.raise_error(F.concat(F.lit("rules of one variable differ in their filtering: "), F.col("variable")))
    return agreed.withColumn("action", F.when(F.col("torn"), error.cast("string")).otherwise(F.col("action"))).drop("torn")


def exact_medians(values: DataFrame, accuracy: int = 100_000) -> DataFrame:
    """The lower median of ``value`` per variable, exactly: ``(variable, _median)``.

    A mergeable sketch, whose rank error is about n / ``accuracy``, brackets the median; what lies outside
    keeps its number alone, and the few distinct values inside are counted. A bracket that
    misses its median is left for a count of all values.
    """
    values = values.filter("value is not null")
    margin = 8.0 / accuracy
    sketch = F.percentile_approx("value", [0.5 - margin, 0.5 + margin], accuracy)
    bracket = values.groupBy("variable").agg(sketch.alias("_bracket"))
    below, above = F.col("value") < F.col("_bracket")[0], F.col("value") > F.col("_bracket")[1]
    place = F.when(below, -math.inf).when(above, math.inf).otherwise(F.col("value"))
    medians = settle(_middle(attach(values, bracket, "variable").select("variable", place.alias("value"))))
    missed = medians.filter(F.abs("_median") == math.inf).select("variable")
    if missed.isEmpty():
        return medians
    again = _middle(values.join(missed, "variable", "left_semi"))
    return settle(medians.join(missed, "variable", "left_anti").unionByName(again))


def _middle(values: DataFrame) -> DataFrame:
    rank = F.ceil(F.col("upto_total") / 2)
    here = (F.col("upto") - F.col("copies") < rank) & (rank <= F.col("upto"))
    return value_counts(values, ["variable"]).filter(here).select("variable", F.col("value").alias("_median"))


def process_outliers(events: DataFrame, rules: DataFrame, accuracy: int = 100_000) -> DataFrame:
    """Remove invalid values, or replace them by the median of the valid ones, per variable.

    A test that cannot be decided counts as invalid, a variable without an action passes through
    and one without a rule disappears. All variables share the passes of ``exact_medians``, whose sketch
    has the given ``accuracy``.
    """
    value, unit = F.col("value"), F.col("unit")
    unit_ok = F.col("units").isNull() | F.array_contains(F.col("units"), unit)
    unit_ok = F.when(F.col("unit_waiver"), (value == 0) | unit_ok).otherwise(unit_ok)
    judged = events.join(_validity(rules), "variable").withColumn(
        "_valid", F.coalesce(value.between(F.col("lo"), F.col("hi")) & unit_ok, F.lit(False))
    )
    repaired = F.col("action") == "replace_with_median"
    medians = exact_medians(judged.filter(repaired & F.col("_valid")).select("variable", "value"), accuracy)
    return (
        attach(judged, medians, "variable", "left")
        .filter(F.col("action").isNull() | repaired | F.col("_valid"))
        .withColumn("value", F.when(repaired & ~F.col("_valid"), F.col("_median")).otherwise(value))
        .select(*events.columns)
    )
