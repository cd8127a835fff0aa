"""Cutting histories into input and forecast windows."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from pulseframe.functions.keyed import uniform
from pulseframe.operators.joins import attach, interval_join
from pulseframe.operators.ordered import numbered
from pulseframe.operators.scalers import scaled_time
from pulseframe.session import settle

WINDOW = ("stay_id", "t1")
CELL = 1440


def top_variables(events: DataFrame, k: int) -> DataFrame:
    """Events of the ``k`` most frequent variables (0 keeps all); ties go by name."""
    if k == 0:
        return events
    top = events.groupBy("variable").count().orderBy(F.desc("count"), "variable").limit(k).select("variable")
    return attach(events, top, "variable", "left_semi")


def variable_ids(events: DataFrame) -> DataFrame:
    """Vocabulary ``(variable, var_id)``, 0-based in alphabetical order."""
    names = events.select("variable").distinct()
    return numbered(names, ["variable"]).select("variable", (F.col("row") - 1).cast("int").alias("var_id"))


def with_variable_ids(events: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Add ``var_id``; events of variables outside the vocabulary are dropped."""
    return attach(events, vocabulary, "variable")


def rebase_minutes(events: DataFrame) -> DataFrame:
    """Minutes counted from the first event of each stay in ``events``."""
    first = events.groupBy("stay_id").agg(F.min("minute").alias("_first"))
    return events.join(first, "stay_id").withColumn("minute", F.col("minute") - F.col("_first")).select(*events.columns)


def window_candidates(events: DataFrame, min_input_minutes: int) -> DataFrame:
    """Possible window ends ``(stay_id, t1)``: minutes with events, not too early and not the last."""
    span = events.groupBy("stay_id").agg(F.min("minute").alias("_first"), F.max("minute").alias("_last"))
    moments = events.select("stay_id", "minute").distinct()
    t1 = F.col("minute") - F.col("_first")
    return (
        moments.join(span, "stay_id")
        .filter((t1 >= min_input_minutes) & (F.col("minute") < F.col("_last")))
        .select("stay_id", t1.alias("t1"))
    )


def draw_windows(candidates: DataFrame, draws: int = 1, seed: int = 42) -> DataFrame:
    """The first ``draws`` window ends of each stay in a fixed random order, starting over if it has fewer.

    Ranks beyond ``draws`` are cut before the shuffle (window group limit), so a long stay sends
    only a few rows.
    """
    order = Window.partitionBy("stay_id").orderBy(uniform(["stay_id", "t1"], seed, "t1"), "t1")
    picked = candidates.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= draws)
    size = candidates.groupBy("stay_id").agg(F.count(F.lit(1)).cast("int").alias("_size"))
    return picked.join(size, "stay_id").select(
        "stay_id", F.explode(F.sequence(F.col("_rank") - 1, F.lit(draws - 1), F.col("_size"))).alias("draw"), "t1"
    )


def first_kept(rows: DataFrame, keys: list[str], p: float, seed: int = 42) -> DataFrame:
    """Add ``cycle``: at which of repeated draws a row is kept for the first time, if each drops it with probability ``p``.

    One uniform draw of the row's ``keys`` stands for the whole sequence, whose first success is geometric.
    The rows of a group with its least ``cycle`` are what the first draw that keeps anything keeps.
    """
    if not 0 <= p < 1:
        raise ValueError("p must be in [0, 1)")
    if p == 0:
        return rows.withColumn("cycle", F.lit(0).cast("bigint"))
    u = uniform(keys, seed, "kept")
    return rows.withColumn("cycle", F.floor(F.log(F.lit(1.0) - u) / F.lit(math.log(p))).cast("bigint"))


def kept_windows(
    events: DataFrame, candidates: DataFrame, max_minute: int, p: float, draws: int = 1, seed: int = 42, ahead: int = 4
) -> DataFrame:
    """Windows that keep something when each variable is dropped with probability ``p``: (stay_id, draw, t1, variable).

    Every draw walks through the window ends of its stay in a fixed random order, each draw one place further
    on, and starts over after the last; each visit drops variables anew. The first visit that keeps any counts, and
    its kept variables are returned. A visit's number is its cycle times the stay's window ends plus its place,
    so the first one is a minimum over the stay. Most draws end within ``ahead`` visits of the first cycle, and
    only these windows are read first; the other stays are then read whole.
    """
    size = candidates.groupBy("stay_id").agg(F.count(F.lit(1)).alias("_size"))
    keyed = candidates.withColumn("_u", uniform(["stay_id", "t1"], seed, "t1"))
    order = Window.partitionBy("stay_id").orderBy("_u", "t1")
    every_draw = F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw")

    def visits(placed: DataFrame) -> DataFrame:
        """(stay_id, draw, t1, variable, _visit) from (stay_id, t1, _place, _size, draw)."""
        placed = placed.withColumn("_offset", F.pmod(F.col("_place") - F.col("draw"), F.col("_size")))
        seen = input_window(events.select("stay_id", "minute", "variable"), placed, max_minute).select(*WINDOW, "variable").distinct()
        drawn = first_kept(placed.join(seen, list(WINDOW)), [*WINDOW, "variable", "draw"], p, seed)
        return drawn.withColumn("_visit", F.col("cycle") * F.col("_size") + F.col("_offset"))

    early = keyed.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= ahead + draws - 1)
    early = settle(early.join(size, "stay_id").select("stay_id", "t1", (F.col("_rank") - 1).alias("_place"), "_size", every_draw))
    near = visits(early.filter(F.pmod(F.col("_place") - F.col("draw"), F.col("_size")) < ahead))
    found = settle(near.filter("cycle = 0"))
    open_draws = settle(size.select("stay_id", "_size", every_draw).join(found.select("stay_id", "draw").distinct(), ["stay_id", "draw"], "left_anti"))
    rest = keyed.join(open_draws.select("stay_id").distinct(), "stay_id", "left_semi")
    late = numbered(rest, ["_u", "t1"], "_number", ["stay_id"]).select("stay_id", "t1", (F.col("_number") - 1).alias("_place"))
    visited = found.unionByName(visits(late.join(open_draws, "stay_id")).select(*found.columns))
    least = visited.groupBy("stay_id", "draw").agg(F.min("_visit").alias("_visit"))
    return visited.join(least, ["stay_id", "draw", "_visit"]).select("stay_id", "draw", "t1", "variable")


def input_window(events: DataFrame, windows: DataFrame, max_minute: int) -> DataFrame:
    """Events with ``t1 - max_minute <= minute <= t1`` for every distinct window; adds ``t1``."""
    ends = windows.select(*WINDOW).distinct()
    joined = interval_join(
        events, ends, ["stay_id"], F.col("minute"), F.col("t1") - max_minute, F.col("t1"), CELL
    )
    return joined.select(*events.columns, "t1")


def forecast_targets(events: DataFrame, windows: DataFrame, vocabulary: DataFrame, prediction_window: int) -> DataFrame:
    """Dense forecast arrays per window: mean of each variable over ``(t1, t1 + prediction_window]``.

    ``forecast_mask`` tells which variables have data; the others hold 0.
    """
    vocabulary, ends = settle(vocabulary), windows.select(*WINDOW).distinct()
    ahead = interval_join(
        with_variable_ids(events, vocabulary), ends, ["stay_id"], F.col("minute"),
        F.col("t1") + 1, F.col("t1") + prediction_window, CELL,
    )
    means = ahead.groupBy(*WINDOW, "var_id").agg(F.avg("value").alias("_mean"))
    found = means.groupBy(*WINDOW).agg(
        F.map_from_entries(F.collect_list(F.struct("var_id", "_mean"))).alias("_found")
    )
    every_id = F.sequence(F.lit(0), F.lit(vocabulary.count() - 1))
    mean = F.transform(every_id, lambda i: F.try_element_at(F.col("_found"), i))
    return (
        ends.join(found, list(WINDOW), "left")
        .withColumn("_mean", mean)
        .select(
            *WINDOW,
            F.transform("_mean", lambda m: F.coalesce(m, F.lit(0.0))).alias("forecast_values"),
            F.transform("_mean", lambda m: m.isNotNull()).alias("forecast_mask"),
        )
    )


def variable_dropout(window_events: DataFrame, p: float, seed: int = 42, max_draws: int = 32) -> DataFrame:
    """Drop each variable of a window with probability ``p``; draw again if nothing is left.

    Every draw is a function of window, variable and draw number, so a window uses the first draw
    that keeps something. Where none of ``max_draws`` does, the next one that would is drawn directly: the
    first variable kept, by name, with its probability given that one is, and those after it independently.
    At ``p = 1``, where nothing is ever kept, it is the luckiest variable, the limit of that distribution.
    """
    keys = [*WINDOW, "variable"]

    def draw(number):
        return uniform(keys, seed, F.concat(F.lit("drop-"), number.cast("string")))

    window = Window.partitionBy(*WINDOW)  # at most one row per variable
    listed = (
        window_events.select(*keys)
        .distinct()
        .withColumn("_u", draw(F.lit(0)))
        .withColumn("_again", F.max("_u").over(window) <= p)
        .withColumn(
            "_first",
            F.when(
                F.col("_again"),
                F.array_min(F.filter(F.sequence(F.lit(1), F.lit(max_draws - 1)), lambda d: draw(d) > p)),
            ).otherwise(F.lit(0)),
        )
        .withColumn("_draw", F.min("_first").over(window))
    )
    late = F.row_number().over(window.orderBy(F.desc("_u"), "variable")) == 1
    if 0 < p < 1:
        place, rate = F.row_number().over(window.orderBy("variable")), math.log(p)
        some = -F.expm1(F.count(F.lit(1)).over(window) * rate)  # the probability that a draw keeps something
        first = F.ceil(F.log1p(-uniform(list(WINDOW), seed, "drop-first") * some) / rate)
        first = F.least(F.greatest(first, F.lit(1)), F.count(F.lit(1)).over(window))
        late = (place == first) | (place > first) & (uniform(keys, seed, "drop-late") > p)
    kept = listed.withColumn("_late", late).filter(
        F.when(F.col("_draw").isNull(), F.col("_late"))
        .when(F.col("_draw") == 0, F.col("_u") > p)
        .otherwise(draw(F.col("_draw")) > p)
    )
    return window_events.join(kept.select(*keys), keys, "left_semi").select(*window_events.columns)


def cap_events(window_events: DataFrame, max_events: int, seed: int = 42, keys: tuple[str, ...] = WINDOW) -> DataFrame:
    """A uniform sample of at most ``max_events`` events per window, without replacement.

    ``(variable, minute)`` tells the events of a window apart, as after ``throttle_events``.
    """
    event = [*keys, "variable", "minute"]
    order = Window.partitionBy(*keys).orderBy(uniform(event, seed, "cap"), "variable", "minute")
    ranked = window_events.withColumn("_rank", F.row_number().over(order))
    return ranked.filter(F.col("_rank") <= max_events).drop("_rank")


def supervised_windows(events: DataFrame, labels: DataFrame, max_minute: int) -> DataFrame:
    """The first ``max_minute`` minutes of every labeled stay, with its label."""
    outcome = labels.select("stay_id", F.col("died").cast("float").alias("label"))
    own = events.join(outcome.select("stay_id"), "stay_id", "left_semi")
    early = rebase_minutes(own).filter(F.col("minute") <= max_minute)
    return early.join(outcome, "stay_id").select(*events.columns, F.lit(max_minute).alias("t1"), "label")


def assemble_samples(
    window_events: DataFrame,
    demographics: DataFrame,
    max_minute: int,
    max_events: int,
    targets: DataFrame | None = None,
    seed: int = 42,
    keys: tuple[str, ...] = WINDOW,
) -> DataFrame:
    """One row of aligned arrays per window (a value of ``keys``), sorted by minute and variable.

    ``window_events`` carries ``var_id`` and optionally ``label``. Events are capped first, so an
    array never holds more than ``max_events``.
    """
    label = ["label"] if "label" in window_events.columns else []
    event = F.struct("minute", "var_id", F.col("value").cast("float").alias("value"))
    # Times count from the first event before the cap; one row per window carries it.
    first = window_events.groupBy(*keys).agg(F.min("minute").alias("_first"))
    samples = (
        cap_events(window_events, max_events, seed, keys)
        .groupBy(*keys, *label)
        .agg(F.array_sort(F.collect_list(event)).alias("_events"))
        .join(first, list(keys))
    )
    times = F.transform("_events.minute", lambda m: scaled_time(m, F.col("_first"), max_minute).cast("float"))
    traits = demographics.select("stay_id", F.array(F.col("age"), F.col("gender")).cast("array<float>").alias("demographics"))
    samples = samples.join(traits, "stay_id").select(
        *keys,
        F.col("_events.value").alias("values"),
        times.alias("times"),
        F.col("_events.var_id").alias("variables"),
        "demographics",
        *label,
    )
    if targets is None:
        return samples
    forecast = targets.withColumn("forecast_values", F.col("forecast_values").cast("array<float>"))
    return samples.join(forecast, list(WINDOW))
