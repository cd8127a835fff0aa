from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseframe.operators import clean, events as ev
from pulseframe.session import settle
from pulseframe.sources.rules import check_rules, rules_table


def at(text):
    return datetime.strptime(text, "%Y-%m-%d %H:%M")


@pytest.mark.parametrize("amount, end, hours, expected", [
    (100, "2020-01-01 10:00", 2, [("2020-01-01 09:00", 50), ("2020-01-01 10:00", 50)]),
    (100, "2020-01-01 10:00", 2.5, [("2020-01-01 08:30", 40), ("2020-01-01 09:30", 40), ("2020-01-01 10:00", 20)]),
    (100, "2021-01-01 10:00", 4, [(f"2021-01-01 {h:02}:00", 25) for h in (7, 8, 9, 10)]),
    (50, "2020-01-01 01:00", 0.5, [("2020-01-01 01:00", 50)]),
    (121.5, "2022-01-01 10:03", 4.05, [("2022-01-01 07:00", 30), ("2022-01-01 08:00", 30), ("2022-01-01 09:00", 30),
                                       ("2022-01-01 10:03", 31.5)]),
    (100, "2020-01-01 10:00", 0, [("2020-01-01 10:00", 100)]),
    (100, "2020-01-01 10:00", -1, []),
])
def test_hourly(spark, amount, end, hours, expected):
    df = spark.createDataFrame([(float(amount), at(end))], "value double, time_end timestamp").withColumn(
        "time_start", F.expr(f"timestamp_micros(unix_micros(time_end) - {int(hours * 3600)}000000L)"))
    rows = clean.distribute_interval_hourly(df).select(F.date_format("time", "yyyy-MM-dd HH:mm").alias("t"), "value").orderBy("time").collect()
    assert [r.t for r in rows] == [t for t, _ in expected]
    assert [r.value for r in rows] == pytest.approx([v for _, v in expected])


def test_hourly_keeps_the_total(tables):
    before = tables.line_intervals.filter("time_end >= time_start").agg(F.sum("value")).first()[0]
    after = clean.distribute_interval_hourly(tables.line_intervals).agg(F.sum("value")).first()[0]
    assert after == pytest.approx(before, rel=1e-9)


def test_outliers(spark):
    rules = rules_table(spark, [
        {"variable": "Temperature", "codes": [677], "lo": 14.0, "hi": 47.0, "action": "remove"},
        {"variable": "HR", "codes": [211], "lo": 40.0, "hi": 200.0, "action": "replace_with_median"},
        {"variable": "Empty", "codes": [1], "lo": 0.0, "hi": 1.0, "action": "replace_with_median"},
        {"variable": "Free", "codes": [2]},
        {"variable": "Dose", "codes": [3], "lo": 0.0, "hi": 1.0, "units": ["dose"], "unit_waiver": True, "action": "remove"},
    ])
    rows = [("Temperature", v, None) for v in (36.6, 37.1, 36.9, 1000.0)] + [("HR", v, None) for v in (1.0, 100.0, 300.0)]
    rows += [("Empty", 5.0, None), ("Free", -7.0, None), ("Unknown", 1.0, None)]
    rows += [("Dose", 0.0, "mg"), ("Dose", 1.0, "dose"), ("Dose", 1.0, "mg"), ("Dose", 1.0, None), ("Dose", 9.0, "dose")]
    events = spark.createDataFrame(rows, "variable string, value double, unit string")
    got = clean.process_outliers(events, rules).collect()
    values = {}
    for r in got:
        values.setdefault(r.variable, []).append(r.value)
    assert sorted(values["Temperature"]) == [36.6, 36.9, 37.1]
    assert values["HR"] == [100.0, 100.0, 100.0]
    assert values["Empty"] == [None] and values["Free"] == [-7.0] and "Unknown" not in values
    assert sorted(values["Dose"]) == [0.0, 1.0]


# One invented rule for every selector.
INVENTED = (
    {"variable": "Warmth", "codes": [11], "lo": 10.0, "hi": 50.0, "action": "remove"},
    {"variable": "Warmth", "codes": [12], "sel_kind": "linear", "a": 5.0 / 9.0, "b": -160.0 / 9.0, "lo": 10.0, "hi": 50.0, "action": "remove"},
    {"variable": "Share", "codes": [13], "sel_kind": "percent", "lo": 0.1, "hi": 1.0, "action": "remove"},
    {"variable": "Mood", "codes": [14], "sel_kind": "text_map", "text_map": {"calm": 0.0, "restless": 1.0}, "categorical": True},
    {"variable": "Salt", "codes": [15], "sel_kind": "unit_scale", "a": 1000.0, "sel_unit": "mg", "units": ["mg", "gm"], "action": "replace_with_median"},
    {"variable": "Given", "codes": [16], "sel_kind": "constant", "a": 1.0},
    {"variable": "Pulse", "codes": [17], "lo": 0.0, "hi": 400.0, "action": "remove"},
)


def test_selectors(spark):
    rules = rules_table(spark, INVENTED)
    rows = [(11, v, None, None) for v in (36.6, 37.1, 36.9)] + [(12, v, None, None) for v in (98.24, 97.88, 98.12)]
    rows += [(13, 40.0, None, None), (13, 0.4, None, None), (14, None, "calm", None), (14, None, "odd", None),
             (14, 3.0, None, None), (15, 2000.0, None, "mg"), (15, 2.0, None, "gm"), (16, 17.0, None, None),
             (17, None, "3.5", None), (17, None, "abc", None)]
    events = spark.createDataFrame(rows, "code long, value_num double, value_text string, unit string")
    got = clean.map_code_to_variable(clean.apply_value_selectors(events, rules), rules).collect()
    by_code = {}
    for r in got:
        by_code.setdefault(r.code, []).append(r.value)
    assert by_code[11] == [36.6, 37.1, 36.9]
    assert by_code[12] == pytest.approx([36.8, 36.6, 36.73], rel=1e-2)
    assert by_code[13] == [0.4, 0.4]
    assert sorted(by_code[14]) == [0.0, 3.0]
    assert by_code[15] == [2.0, 2.0] and by_code[16] == [1.0] and by_code[17] == [3.5]


def test_differing_rules_are_refused(spark):
    torn = rules_table(spark, [{"variable": "a", "codes": [1], "hi": 1.0, "action": "remove"}, {"variable": "a", "codes": [2], "hi": 2.0, "action": "remove"}])
    events = spark.createDataFrame([("a", 1.0, "mg")], "variable string, value double, unit string")
    with pytest.raises(Exception, match="differ in their filtering"):
        clean.process_outliers(events, torn).collect()


def test_convert_units(spark):
    rows = [(5.0, "mcg"), (2.0, "L"), (7.0, "ml"), (8.0, None)]
    got = clean.convert_units(spark.createDataFrame(rows, "value double, unit string")).collect()
    assert [(r.value, r.unit) for r in got] == [(0.005, "mg"), (2000.0, "ml"), (7.0, "ml"), (8.0, None)]


def test_attach_stay(spark):
    stays = spark.createDataFrame(
        [(1, 10, at("2020-01-01 10:00"), at("2020-01-05 10:00")), (1, 11, at("2020-01-05 11:30"), at("2020-01-06 10:00"))],
        "admission_id long, stay_id long, time_start timestamp, time_end timestamp")
    events = spark.createDataFrame(
        [(1, "both", at("2020-01-05 10:45")), (1, "edge", at("2020-01-01 09:00")), (1, "out", at("2020-01-01 08:59")),
         (2, "other", at("2020-01-02 00:00"))], "admission_id long, name string, time timestamp")
    got = sorted((r.name, r.stay_id) for r in clean.attach_stay(events, stays).collect())
    assert got == [("both", 10), ("both", 11), ("edge", 10)]
    with pytest.raises(ValueError):
        clean.attach_stay(events.withColumn("stay_id", F.lit(1)), stays)


def test_rules_are_checked(spark):
    good = {"variable": "a", "codes": [1, 2], "lo": 0.0, "hi": 1.0, "action": "remove"}
    check_rules(rules_table(spark, INVENTED))
    for bad in ({**good, "codes": [2]}, {**good, "codes": [3], "hi": 2.0}, {**good, "variable": "b", "codes": [3], "sel_kind": "x"}):
        with pytest.raises(ValueError):
            check_rules(rules_table(spark, [good, bad]))


def test_median_of_many_values_is_exact(spark):
    rows = 1_000_001
    values = F.pmod(F.xxhash64("id"), F.lit(1 << 40)).cast("double").alias("value")
    df = settle(spark.range(rows).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("variable"), values))
    got = {r.variable: r._median for r in clean.exact_medians(df).collect()}
    for name in ("a", "b"):
        all_values = np.sort(df.filter(F.col("variable") == name).toPandas()["value"].to_numpy())
        assert got[name] == all_values[(len(all_values) + 1) // 2 - 1]
    rules = rules_table(spark, [{"variable": "b", "codes": [1], "lo": 0.0, "hi": 1e15, "action": "replace_with_median"}])
    bad = spark.createDataFrame([("b", -1.0)], "variable string, value double")
    events = df.filter("variable = 'b'").unionByName(bad).withColumn("unit", F.lit(None).cast("string"))
    repaired = clean.process_outliers(events, rules).groupBy("value").count().filter("count > 1").collect()
    assert [r.value for r in repaired] == [got["b"]]


def test_median_outside_its_bracket(spark, monkeypatch):
    df = spark.createDataFrame([("v", float(x)) for x in range(101)] + [("w", 3.0), ("w", 1.0)], "variable string, value double")
    monkeypatch.setattr(clean.F, "percentile_approx", lambda *_: F.array(F.lit(70.0), F.max("value")))
    assert {r.variable: r._median for r in clean.exact_medians(df).collect()} == {"v": 50.0, "w": 1.0}


def test_throttled_groups_hold_numbers(spark):
    rows = [(1, 5, "v", 1.0, "b", "ml"), (1, 5, "v", 2.0, "a", None), (1, 5, "v", 6.0, "b", "L"), (1, 6, "v", 2.0, None, None),
            (2, 5, "w", None, "\u00e9", "z"), (2, 5, "w", 4.0, "z", "\u00e9")]
    df = spark.createDataFrame(rows, "stay_id bigint, minute int, variable string, value double, source string, unit string")
    numbered = ev.throttle_events(df, df)
    assert "collect_set" not in numbered._jdf.queryExecution().toString()
    gathered = ev.throttle_events(df)
    assert numbered.schema.simpleString() == gathered.schema.simpleString()
    assert sorted(map(repr, numbered.collect())) == sorted(map(repr, gathered.collect()))
    many = df.unionByName(spark.range(ev.BITS).select(F.lit(9).cast("bigint").alias("stay_id"), F.lit(1).alias("minute"), F.lit("v").alias("variable"),
                          F.lit(1.0).alias("value"), F.col("id").cast("string").alias("source"), F.lit("L").alias("unit")))
    assert max(len(r.source) for r in ev.throttle_events(many, many).collect()) == ev.BITS
