"""What must hold of the plans, and of results under any partitioning."""

import pytest
from pyspark.sql import functions as F

from pulseframe.operators import batches, clean, cohort, events as ev, noise, scalers, stats, windows
from pulseframe.plans.dataset import named_events
from pulseframe.sources.rules import rules_table
from pulseframe.plans.views import LINE_MEDIAN
from pulseframe import streaming


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scan_reads_only_what_is_needed(spark, tables):
    df = scalers.zscore_fit(tables.lines)
    assert "ReadSchema: struct<l_extendedprice:double,l_returnflag:string,l_linestatus:string>" in plan(df)


def test_filter_reaches_the_scan(spark, tables):
    df = tables.table("lineitem").filter(F.col("l_returnflag").isin("A", "R")).select("l_orderkey")
    assert "PushedFilters: [In(l_returnflag, [A,R])]" in plan(df)


def test_rules_are_broadcast_by_their_known_size(spark, tables):
    events = tables.raw.charted()
    text = plan(named_events(events.withColumn("source", F.lit("x")), tables.rules))
    assert text.count("BroadcastHashJoin") >= 2


def test_one_shuffle_of_the_events_for_relative_time(tables):
    text = plan(ev.relative_minutes(tables.point_events, tables.point_events.select("stay_id").distinct()))
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def test_split_needs_no_shuffle(tables):
    assert "Exchange" not in plan(cohort.split_by_entity(tables.order_stays))


def test_cap_limits_before_the_shuffle(tables):
    window = tables.processed.withColumn("t1", F.lit(1))
    assert "WindowGroupLimit" in plan(windows.cap_events(window, 5))


def test_selectors_run_without_python(tables):
    text = plan(clean.distribute_interval_hourly(tables.line_intervals))
    assert "Python" not in text and "Pandas" not in text


RANDOM = {
    "gaussian": lambda t, n: noise.add_noise(t.point_events.repartition(n), "gaussian", 0.5, ["event_id"]).select("event_id", F.round("value", 9)),
    "uniform": lambda t, n: noise.add_noise(t.point_events.repartition(n), "uniform", 0.5, ["event_id"]).select("event_id", F.round("value", 9)),
    "shuffle": lambda t, n: noise.add_noise(t.point_events.repartition(n), "shuffle", 0.5, ["event_id"]).select("event_id", "variable"),
    "split": lambda t, n: cohort.split_by_entity(t.order_stays.repartition(n)),
    "sample": lambda t, n: stats.stratified_sample(t.point_events.repartition(n), 50, ["event_id"]),
    "fold": lambda t, n: batches.fold_subset(t.order_stays.repartition(n), 0.2, 2, 5),
    "resample": lambda t, n: batches.balanced_resample(t.stay_labels.repartition(n), ["stay_id"], "died"),
    "dropout": lambda t, n: windows.variable_dropout(t.processed.withColumn("t1", F.lit(1)).repartition(n), 0.5),
    "cap": lambda t, n: windows.cap_events(t.processed.withColumn("t1", F.lit(1)).repartition(n), 4),
    "draws": lambda t, n: windows.draw_windows(windows.window_candidates(t.processed.repartition(n), 60), 2),
    "median": lambda t, n: clean.process_outliers(t.lines.repartition(n), rules_table(t.spark, LINE_MEDIAN)),
}


@pytest.mark.parametrize("name", RANDOM)
def test_partitioning_does_not_matter(tables, name):
    one, many = RANDOM[name](tables, 1), RANDOM[name](tables, 64)
    assert one.exceptAll(many).count() == 0 and one.count() == many.count() > 0


def test_uniform_noise_stays_in_range(tables):
    noisy = noise.add_noise(tables.point_events, "uniform", 1.0, ["event_id"])
    bounds = lambda df: {r.variable: (r.a, r.b) for r in df.groupBy("variable").agg(F.min("value").alias("a"), F.max("value").alias("b")).collect()}
    before, after = bounds(tables.point_events), bounds(noisy)
    assert all(before[v][0] <= after[v][0] and after[v][1] <= before[v][1] for v in before)
    with pytest.raises(ValueError):
        noise.add_noise(tables.point_events, "uniform", 1.5, ["event_id"])


def test_stateless_operators_accept_a_stream(spark, tables, tmp_path):
    rules, path = tables.rules, str(tmp_path / "charted")
    charted = tables.raw.charted()
    charted.write.parquet(path)
    stream = spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)
    params = scalers.zscore_fit(named_events(charted, rules))

    def run(df):
        named = streaming.map_code_to_variable(streaming.apply_value_selectors(df, rules), rules)
        return streaming.zscore_transform(streaming.convert_units(named), params)

    query = run(stream).writeStream.format("memory").queryName("cleaned").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("cleaned").exceptAll(run(charted)).count() == 0
    assert spark.table("cleaned").count() == run(charted).count() > 0
