"""Descriptive statistics of events, stays, splits and rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from pulseframe.functions.clock import seconds_between
from pulseframe.functions.keyed import uniform
from pulseframe.functions.quantile import normal_quantile
from pulseframe.operators.joins import attach
from pulseframe.operators.ordered import exact_quantiles, value_counts
from pulseframe.operators.scalers import ecdf_fit, ecdf_transform, zscore_fit, zscore_transform
from pulseframe.session import settle

PERCENTILES = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)
MAX_BINS = 30


def long_form(row: DataFrame) -> DataFrame:
    """A one-row table as ``(statistic, value)`` rows."""
    doubles = row.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in row.columns])
    return doubles.unpivot([], row.columns, "statistic", "value")


def four_moments(column: str, subject: str) -> list[Column]:
    folds = {"Mean": F.avg, "Std": F.stddev_samp, "Min": F.min, "Max": F.max}
    return [fold(column).alias(f"{name}{subject}") for name, fold in folds.items()]


def variable_statistics(events: DataFrame, percentiles: tuple[float, ...] = PERCENTILES, exact: bool = True) -> DataFrame:
    """Moments and percentiles per variable, most frequent first.

    Exact percentiles come from ranked distinct values, so no task holds the values of a variable;
    ``exact=False`` uses a sketch in the same pass as the moments.
    """
    names = {f"p{p}": p for p in percentiles}
    moments = [
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.count("value").alias("count"),
        F.skewness("value").alias("skewness"),
        F.kurtosis("value").alias("kurtosis"),
    ]
    if not exact:
        sketch = F.percentile_approx("value", list(percentiles), 10_000)
        table = events.groupBy("variable").agg(*moments, sketch.alias("_p"))
        table = table.withColumns({n: F.col("_p")[i] for i, n in enumerate(names)}).drop("_p")
    else:
        table = events.groupBy("variable").agg(*moments).join(exact_quantiles(events, ["variable"], names), "variable", "left")
    return table.withColumn("cv", F.try_divide(F.col("std"), F.col("mean"))).orderBy(F.desc("count"), "variable")


#: Places of equal values that are listed at a time.
PLACES = 4096


def stratified_sample(events: DataFrame, n: int, key_cols: list[str], seed: int = 42) -> DataFrame:
    """About ``n`` events per variable (all of them for rarer variables)."""
    fraction = F.least(F.lit(1.0), F.lit(float(n)) / F.count(F.lit(1)))
    fractions = events.groupBy("variable").agg(fraction.alias("_fraction"))
    return (
        attach(events, fractions, "variable")
        .filter(uniform(key_cols, seed, "sample") < F.col("_fraction"))
        .select(*events.columns)
    )


def normality_distance(events: DataFrame) -> DataFrame:
    """Mean distance between the sorted z-scores and the normal quantiles, per variable, over all events given.

    Null when the standard deviation is 0 or undefined. The places of a value's copies are listed
    ``PLACES`` at a time, so that no array grows with them.
    """
    moments = events.groupBy("variable").agg(F.avg("value").alias("_mean"), F.stddev_samp("value").alias("_std"))
    counts = value_counts(events, ["variable"])
    heads = F.sequence(F.col("upto") - F.col("copies") + 1, F.col("upto"), F.lit(PLACES).cast("bigint"))
    last = F.least(F.col("_head") + PLACES - 1, "upto")
    places = counts.withColumn("_head", F.explode(heads)).withColumn("_place", F.explode(F.sequence("_head", last)))
    expected = normal_quantile((F.col("_place") - 0.5) / F.col("upto_total"))
    z = F.try_divide(F.col("value") - F.col("_mean"), F.col("_std"))
    return attach(places, moments, "variable").groupBy("variable").agg(
        F.avg(F.abs(z - expected)).alias("wasserstein_distance")
    )


def journey_statistics(events: DataFrame, stays: DataFrame) -> DataFrame:
    """Events per stay and per patient, length of stay in minutes, stays per patient (long form)."""
    per_stay = events.groupBy("stay_id").agg(F.count(F.lit(1)).alias("n"))
    minutes = F.floor(seconds_between("time_start", "time_end") / 60).cast("int").alias("n")
    durations = stays.select(minutes)
    stays_of = stays.groupBy("patient_id").agg(F.count(F.lit(1)).alias("n"))
    events_of = per_stay.join(stays.select("stay_id", "patient_id"), "stay_id").groupBy("patient_id").agg(F.sum("n").alias("n"))
    parts = [
        per_stay.agg(*four_moments("n", "NumOfEventsPerStay")),
        durations.agg(*four_moments("n", "DurationMin")),
        stays_of.agg(*four_moments("n", "NumOfStaysPerPatient")),
        events_of.agg(F.count("n").alias("NumPatientsWithICUStay"), *four_moments("n", "NumOfEventsPerPatient")),
    ]
    return reduce(DataFrame.unionByName, [long_form(p) for p in parts])


def _per_stay(labels: DataFrame, events: DataFrame, splits: DataFrame) -> DataFrame:
    """``(stay_id, split, n_events, labeled, died)`` for every stay of the split map."""
    counts = events.groupBy("stay_id").agg(F.count(F.lit(1)).alias("n_events"))
    outcome = labels.select("stay_id", F.col("died").cast("double").alias("died"), F.lit(True).alias("labeled"))
    return (
        splits.join(counts, "stay_id", "left")
        .join(outcome, "stay_id", "left")
        .select("stay_id", "split", F.coalesce("n_events", F.lit(0)).alias("n_events"), "died",
                F.coalesce("labeled", F.lit(False)).alias("labeled"))
    )


def split_statistics(labels: DataFrame, events: DataFrame, splits: DataFrame) -> DataFrame:
    """Prevalence, labels, labeled events and all events of each split (long form)."""
    per_split = _per_stay(labels, events, splits).groupBy("split").agg(
        F.avg("died").alias("DeathPrevalence"),
        F.count_if("labeled").cast("double").alias("LengthLabels"),
        F.coalesce(F.sum(F.when(F.col("labeled"), F.col("n_events"))), F.lit(0)).cast("double").alias("LengthEvents"),
        F.sum("n_events").cast("double").alias("AllEvents"),
    )
    rows = per_split.unpivot("split", ["DeathPrevalence", "LengthLabels", "LengthEvents", "AllEvents"], "kind", "value")
    title = F.initcap("split")
    name = F.when(F.col("kind") == "AllEvents", F.concat(F.lit("Unsupervised"), title, F.lit("LengthEvents"))).otherwise(
        F.concat(F.lit("Supervised"), title, F.col("kind"))
    )
    return rows.select(name.alias("statistic"), "value")


def split_table(labels: DataFrame, events: DataFrame, stays: DataFrame, splits: DataFrame) -> DataFrame:
    """Events, patients and stays per labeled split, and of the whole training split."""
    per_stay = _per_stay(labels, events, splits).join(stays.select("stay_id", "patient_id"), "stay_id", "left")
    totals = [
        F.sum("n_events").cast("bigint").alias("num_events"),
        F.count_distinct("patient_id").alias("num_patients"),
        F.count_distinct("stay_id").alias("num_stays"),
    ]
    is_train = F.col("split") == "train"
    counted = per_stay.filter(F.col("labeled") | ~is_train).withColumn(
        "split", F.when(is_train, F.lit("supervised_train")).otherwise(F.col("split"))
    )
    # A test or validation stay without a label adds its events but is no labeled stay.
    labeled = [F.when(F.col("labeled"), F.col(c)).alias(c) for c in ("patient_id", "stay_id")]
    supervised = counted.select("split", "n_events", *labeled).groupBy("split").agg(*totals)
    whole = per_stay.filter(is_train & (F.col("n_events") > 0)).withColumn("split", F.lit("unsupervised_train"))
    return supervised.unionByName(whole.groupBy("split").agg(*totals))


def feature_statistics(rules: DataFrame, items: DataFrame) -> DataFrame:
    """Categorical rules, codes, variables and raw codes (long form).

    Codes of one variable with the same reading belong to one rule.
    """
    if rules.groupBy("code").count().filter("count > 1").first() is not None:
        raise ValueError("a code is listed twice")
    reading = ["variable", "sel_kind", "a", "b", "sel_unit"]
    categorical = rules.filter("categorical").select(*reading).distinct().agg(
        F.count(F.lit(1)).alias("NumberOfCategoricalFeatures")
    )
    codes = rules.agg(
        F.count(F.lit(1)).alias("NumberOfSelectedCodes"), F.count_distinct("variable").alias("NumberOfFeatures")
    )
    raw = items.agg(F.count_distinct("code").alias("NumberOfRawFeatures"))
    return reduce(DataFrame.unionByName, [long_form(t) for t in (categorical, codes, raw)])


def raw_numbers(patients: DataFrame, stays: DataFrame) -> DataFrame:
    one = F.count(F.lit(1))
    return long_form(patients.agg(one.alias("TotalPatients"))).unionByName(long_form(stays.agg(one.alias("TotalICUStays"))))


def variable_by_source(events: DataFrame, variable: str | None = None) -> DataFrame:
    """Count and moments per source, with an overall row (source null); one variable or all."""
    chosen = events if variable is None else events.filter(F.col("variable") == variable)
    return chosen.groupingSets([["variable"], ["variable", "source"]], "variable", "source").agg(*_summary())


def _summary() -> list[Column]:
    return [
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    ]


def stage_counts(**stages: DataFrame) -> DataFrame:
    """Rows per stage and source, and per variable where a stage has one."""
    def count(name, df):
        variable = F.col("variable") if "variable" in df.columns else F.lit(None).cast("string")
        source = F.col("source") if "source" in df.columns else F.lit(None).cast("string")
        return (
            df.select(F.lit(name).alias("stage"), source.alias("source"), variable.alias("variable"))
            .groupBy("stage", "source", "variable")
            .agg(F.count(F.lit(1)).alias("rows"))
        )

    return reduce(DataFrame.unionByName, [count(n, d) for n, d in stages.items()])


def interval_counts(intervals: DataFrame, hourly: DataFrame) -> DataFrame:
    """Intervals, those longer than an hour, and the rows after spreading them (long form)."""
    longer = seconds_between("time_start", "time_end") > 3600
    before = intervals.agg(F.count(F.lit(1)).alias("TotalIntervals"), F.count_if(longer).alias("LongerThanHour"))
    return long_form(before).unionByName(long_form(hourly.agg(F.count(F.lit(1)).alias("HourlyRows"))))


def percentile_bounds(events: DataFrame, lo: float = 0.01, hi: float = 0.99, exact: bool = True) -> DataFrame:
    """Lower and upper percentile of each variable: ``(variable, p_lo, p_hi)``; by a sketch unless ``exact``."""
    if not exact:
        sketch = F.percentile_approx("value", [lo, hi], 10_000)
        return events.groupBy("variable").agg(sketch[0].alias("p_lo"), sketch[1].alias("p_hi"))
    return exact_quantiles(events, ["variable"], {"p_lo": lo, "p_hi": hi})


def trim_to_percentiles(events: DataFrame, bounds: DataFrame) -> DataFrame:
    """Events between the percentile bounds of their variable."""
    inside = F.col("value").between(F.col("p_lo"), F.col("p_hi"))
    return attach(events, bounds, "variable").filter(inside).select(*events.columns)


def daily_means(events: DataFrame) -> DataFrame:
    """Mean per stay, day and variable, as single precision: the last bits of a mean depend on the
    order of addition and must not break ties when values are ranked."""
    day = F.floor(F.col("minute") / 1440).alias("day")
    return events.groupBy("stay_id", day, "variable").agg(F.avg("value").cast("float").alias("value"))


def daily_pivot(events: DataFrame, variables: list[str]) -> DataFrame:
    """Daily means with one column per listed variable."""
    day = F.floor(F.col("minute") / 1440).alias("day")
    return events.groupBy("stay_id", day).pivot("variable", variables).agg(F.avg("value"))


def bin_edges(events: DataFrame, max_bins: int = MAX_BINS) -> DataFrame:
    """Automatic bins per variable: ``(variable, bins, low, high)``.

    The width is the smaller of the Freedman-Diaconis and Sturges widths (Sturges alone when the
    interquartile range is 0), and there are at most ``max_bins`` bins.
    """
    shape = events.groupBy("variable").agg(
        F.min("value").alias("low"), F.max("value").alias("high"), F.count("value").cast("double").alias("_n")
    )
    spread = exact_quantiles(events, ["variable"], {"_q1": 0.25, "_q3": 0.75})
    reach = F.col("high") - F.col("low")
    sturges = reach / (F.log2("_n") + 1.0)
    robust = F.lit(2.0) * (F.col("_q3") - F.col("_q1")) * F.pow("_n", F.lit(-1.0 / 3.0))
    width = F.when(robust > 0, F.least(robust, sturges)).otherwise(sturges)
    flat = F.col("low") == F.col("high")
    return shape.join(spread, "variable").select(
        "variable",
        F.when(flat, F.lit(1)).otherwise(F.least(F.lit(max_bins), F.ceil(F.try_divide(reach, width)))).cast("int").alias("bins"),
        F.when(flat, F.col("low") - 0.5).otherwise(F.col("low")).alias("low"),
        F.when(flat, F.col("high") + 0.5).otherwise(F.col("high")).alias("high"),
    )


def even_edges(events: DataFrame, edges: int = 16) -> DataFrame:
    """``edges`` equally spaced edges between minimum and maximum, as a bin table."""
    return events.groupBy("variable").agg(
        F.lit(edges - 1).alias("bins"), F.min("value").alias("low"), F.max("value").alias("high")
    )


def histogram(events: DataFrame, bins: DataFrame | None = None, max_bins: int = MAX_BINS, slack: float = 0.0) -> DataFrame:
    """Counts per variable and bin, empty bins included; the last bin holds the maximum.

    A value that lies less than ``slack`` bins below an edge counts as on the edge, and so in the bin above it.
    """
    edges = settle(bin_edges(events, max_bins) if bins is None else bins)
    step = (F.col("high") - F.col("low")) / F.col("bins")
    steps = (F.col("value") - F.col("low")) / F.when(step > 0, step)
    place = F.when(step > 0, F.floor(steps + slack if slack else steps)).otherwise(F.lit(0))
    counts = (
        attach(events.select("variable", "value").filter("value is not null"), edges, "variable")
        .withColumn("bin", F.least(place, F.col("bins") - 1).cast("int"))
        .groupBy("variable", "bin")
        .agg(F.count(F.lit(1)).alias("_count"))
    )
    every = edges.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)))
    return every.join(counts, ["variable", "bin"], "left").select(
        "variable",
        "bin",
        (F.col("low") + F.col("bin") * step).alias("left_edge"),
        (F.col("low") + (F.col("bin") + 1) * step).alias("right_edge"),
        F.coalesce("_count", F.lit(0)).alias("count"),
    )


def statistics_bundle(*tables: DataFrame) -> DataFrame:
    """Several ``(statistic, value)`` tables as one."""
    return reduce(DataFrame.unionByName, [t.select("statistic", F.col("value").cast("double").alias("value")) for t in tables])


def transform_comparison(events: DataFrame, variables: list[str] | None = None, edges: int = 16) -> DataFrame:
    """Histograms of the original values, z-scores and quantiles of each variable, over even edges.

    Mean and deviation carry the rounding of their sums, whose order is open; a value on an edge stays
    there as a z-score, whatever side the last bits put it on.
    """
    chosen = events if variables is None else events.filter(F.col("variable").isin(variables))
    chosen = settle(chosen.select("variable", "value"))
    spaces = {
        "original": chosen,
        "zscore": zscore_transform(chosen, zscore_fit(chosen)),
        "ecdf": ecdf_transform(chosen, ecdf_fit(chosen), fitted=True),
    }
    tables = [
        histogram(df, even_edges(df, edges), slack=1e-9 if name == "zscore" else 0.0).withColumn("space", F.lit(name))
        for name, df in spaces.items()
    ]
    return reduce(DataFrame.unionByName, tables)


def ecdf_curve(events: DataFrame, variables: list[str] | None = None) -> DataFrame:
    """Points (value, quantile) of the empirical distribution of each variable."""
    return ecdf_fit(events if variables is None else events.filter(F.col("variable").isin(variables)))
