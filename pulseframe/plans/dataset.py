"""From raw tables to a clean, split dataset."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from pulseframe.operators import clean, cohort, events as ev, noise
from pulseframe.session import settle
from pulseframe.sources.readers import RawData


@dataclass
class Dataset:
    events: DataFrame
    labels: DataFrame
    demographics: DataFrame
    label_splits: DataFrame
    splits: DataFrame


def raw_events(raw: RawData, rules: DataFrame) -> DataFrame:
    """All sources as one table of registered codes; units are converted for inputs only."""
    stays = raw.adult_stays()
    sources = {
        "chartevents": raw.charted(),
        "labevents": clean.attach_stay(raw.lab(), stays.select("admission_id", "stay_id", "time_start", "time_end")),
        "outputevents": raw.point_events(),
        "inputevents_cv": clean.convert_units(raw.point_inputs()),
        "inputevents_mv": clean.convert_units(clean.distribute_interval_hourly(raw.interval_events())),
        "weight": raw.derived_weight(),
    }
    return clean.assemble_events(sources, rules.select("code"))


def named_events(assembled: DataFrame, rules: DataFrame) -> DataFrame:
    """Numeric events of named variables."""
    return clean.map_code_to_variable(clean.apply_value_selectors(assembled, rules), rules)


def build_dataset(
    raw: RawData,
    rules: DataFrame,
    leave_outliers: bool = False,
    noise_options: dict | None = None,
    split_lists: DataFrame | None = None,
    seed: int = 42,
) -> Dataset:
    """Run all steps.

    The named events are stored once: the medians, the repair, the noise and the first times of
    the stays each read them, and all that lies between is narrow.
    """
    named = cleaned = settle(named_events(raw_events(raw, rules), rules))
    if not leave_outliers:
        cleaned = clean.process_outliers(cleaned, rules)
    if noise_options and noise_options["p"] > 0:
        cleaned = noise.add_noise(cleaned, seed=seed, **noise_options)
    stays = settle(ev.filter_active_stays(raw.adult_stays(), cleaned))
    timed = ev.relative_minutes(cleaned, stays)
    events = settle(ev.throttle_events(timed, named))
    # Throttling keeps every (stay, minute), so the cohort can be read from its smaller result.
    eligible = settle(cohort.eligible_cohort(stays, events, raw.admissions()))
    labels = eligible.select("stay_id", "died")
    if split_lists is None:
        label_splits = cohort.split_by_entity(eligible, seed=seed)
    else:
        label_splits = cohort.split_from_lists(eligible, split_lists)
    return Dataset(
        events=events,
        labels=labels,
        demographics=cohort.demographics(stays, raw.patients()),
        label_splits=label_splits,
        splits=cohort.complete_splits(events, label_splits),
    )
