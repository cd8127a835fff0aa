"""Views of single journeys."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pulseframe.operators.joins import attach

SERIES = ("stay_id", "source", "variable")


def thin_journey(events: DataFrame, bounds: DataFrame, parts: int = 20) -> DataFrame:
    """Flag the events to draw, at least 1/``parts`` of the stay's last minute apart.

    Per stay, source and variable the first event is kept, then each event whose time exceeds the
    last kept one by more than the gap. The choice walks along the distinct minutes of a series,
    of which there are at most as many as the stay has minutes, however many events there are; at
    most ``parts`` + 1 of them are kept. Values are truncated to whole numbers and rescaled to the
    percentile ``bounds``.
    """
    first_source = F.try_element_at("source", F.lit(1)) if dict(events.dtypes)["source"].startswith("array") else F.col("source")
    flat = events.withColumn("source", first_source).withColumn("value", F.col("value").try_cast("bigint"))
    last = flat.groupBy("stay_id").agg(F.max("minute").alias("_last"))
    minutes = flat.groupBy(*SERIES).agg(F.array_sort(F.collect_set("minute")).alias("_minutes"))
    beyond = lambda kept, m: (m - F.element_at(kept, -1)) * parts > F.col("_last")
    shown = F.aggregate(
        F.col("_minutes"),
        F.slice("_minutes", 1, 1),
        lambda kept, m: F.when(beyond(kept, m), F.concat(kept, F.array(m))).otherwise(kept),
    )
    chosen = minutes.join(last, "stay_id").select(*SERIES, F.explode(shown).alias("minute"), F.lit(True).alias("_shown"))
    placed = flat.join(chosen, [*SERIES, "minute"], "left")
    reach = F.col("p_hi") - F.col("p_lo")
    return attach(placed, bounds, "variable").select(
        *SERIES,
        "minute",
        "value",
        F.coalesce("_shown", F.lit(False)).alias("shown"),
        F.try_divide(F.col("value") - F.col("p_lo"), reach).alias("level"),
    )


def journey_extract(
    events: DataFrame, stays: DataFrame, variables: list[str], minute_range: tuple[int, int], labels: dict[str, str] | None = None
) -> DataFrame:
    """Events of the given stays and variables within a range of minutes, in order."""
    name = F.col("variable")
    for old, new in (labels or {}).items():
        name = F.when(F.col("variable") == old, F.lit(new)).otherwise(name)
    return (
        events.join(stays.select("stay_id").distinct(), "stay_id", "left_semi")
        .filter(F.col("variable").isin(variables) & F.col("minute").between(*minute_range))
        .select("stay_id", "minute", name.alias("variable"), "value")
        .orderBy("stay_id", "minute", "variable")
    )
