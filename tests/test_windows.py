import pytest
from pyspark.sql import functions as F

from pulseframe.functions.keyed import uniform
from pulseframe.operators import batches, windows


@pytest.fixture
def events(spark):
    rows = [(1, m, v, float(m)) for m in (0, 10, 20, 30, 40) for v in ("a", "b")] + [(2, 5, "a", 1.0), (2, 50, "c", 2.0)]
    return spark.createDataFrame(rows, "stay_id long, minute int, variable string, value double")


def test_candidates(events):
    got = sorted(tuple(r) for r in windows.window_candidates(events, 10).collect())
    assert got == [(1, 10), (1, 20), (1, 30)]  # not before 10, not the last; stay 2 has none


def test_draws_start_over(events):
    got = windows.draw_windows(windows.window_candidates(events, 10), draws=7).collect()
    assert sorted(r.draw for r in got) == list(range(7))
    by_draw = {r.draw: r.t1 for r in got}
    assert [by_draw[d] for d in range(3)] == [by_draw[d] for d in range(3, 6)] and len(set(by_draw.values())) == 3


def test_input_window(spark, events):
    ends = spark.createDataFrame([(1, 30)], "stay_id long, t1 int")
    got = windows.input_window(events, ends, 20).collect()
    assert sorted({r.minute for r in got}) == [10, 20, 30] and len(got) == 6


def test_forecast(spark, events):
    ends = spark.createDataFrame([(1, 20), (2, 5)], "stay_id long, t1 int")
    vocabulary = windows.variable_ids(events)
    got = {r.stay_id: r for r in windows.forecast_targets(events, ends, vocabulary, 20).collect()}
    assert got[1].forecast_values == [35.0, 35.0, 0.0] and got[1].forecast_mask == [True, True, False]
    assert got[2].forecast_values == [0.0, 0.0, 0.0] and got[2].forecast_mask == [False] * 3


def test_dropout_keeps_what_exceeds_p(spark):
    rows = [(s, 9, f"v{i}", 0, 1.0) for s in range(40) for i in range(5)]
    window = spark.createDataFrame(rows, "stay_id long, t1 int, variable string, minute int, value double")
    draw = uniform(["stay_id", "t1", "variable"], 42, "drop-0")
    first = window.withColumn("u", draw).toPandas()
    got = windows.variable_dropout(window, 0.5).toPandas()
    for stay, group in first.groupby("stay_id"):
        kept = set(group[group["u"] > 0.5]["variable"])
        mine = set(got[got["stay_id"] == stay]["variable"])
        assert mine == kept if kept else mine  # an empty draw is repeated


def test_dropout_never_empties_a_window(spark):
    rows = [(s, 9, "v", 0, 1.0) for s in range(50)]
    window = spark.createDataFrame(rows, "stay_id long, t1 int, variable string, minute int, value double")
    assert windows.variable_dropout(window, 0.9).count() == 50
    assert windows.variable_dropout(window, 1.0).count() == 50


def test_cap(events):
    window = events.withColumn("t1", F.lit(40))
    got = windows.cap_events(window, 3).groupBy("stay_id").count().collect()
    assert {r.stay_id: r["count"] for r in got} == {1: 3, 2: 2}


def test_supervised(spark, events):
    labels = spark.createDataFrame([(2, True)], "stay_id long, died boolean")
    got = windows.supervised_windows(events, labels, 44).collect()
    assert [(r.minute, r.variable, r.label) for r in got] == [(0, "a", 1.0)]  # minutes from the first event


@pytest.fixture
def samples(spark):
    return spark.createDataFrame(
        [(1, 0, [1.0, 2.0, 3.0], [0.1, 0.2, 0.3], [1, 2, 3], [7.0, 8.0]), (2, 0, [4.0, 5.0], [0.4, 0.5], [4, 5], [9.0, 10.0])],
        "stay_id long, t1 int, values array<float>, times array<float>, variables array<int>, demographics array<double>")


def test_pad(samples):
    got = {r.stay_id: r for r in batches.pad_batches(batches.length_batches(samples, 2), pad=12345).collect()}
    assert got[1]["values"] == [1.0, 2.0, 3.0] + [12345.0] * 5 and got[2].variables == [4, 5] + [12345] * 6
    assert got[1].input_mask == [True] * 3 + [False] * 5 and got[2].input_mask == [True] * 2 + [False] * 6
    assert got[2].demographics == [9.0, 10.0]


def test_batches_go_from_long_to_short(samples, spark):
    more = samples.unionByName(samples.withColumn("stay_id", F.col("stay_id") + 2))
    got = {r.stay_id: r.batch_id for r in batches.length_batches(more, 2).collect()}
    assert got == {1: 0, 3: 0, 2: 1, 4: 1}


def test_folds_cover_evenly(spark):
    ids = spark.range(100).withColumnRenamed("id", "stay_id")
    folds = [{r.stay_id for r in batches.fold_subset(ids, 0.1, f, 10).collect()} for f in range(10)]
    assert all(len(f) == 10 for f in folds) and set.union(*folds) == set(range(100))
    assert len(batches.fold_subset(ids, 0.25, 0, 1).collect()) == 25
    assert batches.fold_subset(ids, 1, 0, 10).count() == 100


def test_balanced(many_ranges):
    labels = many_ranges.range(2000).select(F.col("id").alias("stay_id"), (F.col("id") % 20 == 0).alias("label"))
    got = batches.balanced_resample(labels, ["stay_id"]).toPandas()
    assert len(got) == 2000 and 0.45 < got["label"].mean() < 0.55
    assert got[got["label"]]["stay_id"].nunique() > 90  # all over the rare class
    weights = {r.label: r.weight for r in batches.class_weights(labels).collect()}
    assert weights[True] == pytest.approx(1 / 100 / 2) and weights[False] == pytest.approx(1 / 1900 / 2)
    assert batches.class_prevalence(labels.filter("not label")).first().pos_class_weight == 1.0
