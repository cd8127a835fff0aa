"""Checked queries: sources, readers, cleaning, noise, cohorts and the whole dataset."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from pulseframe.functions.schema import require_not_null
from pulseframe.operators import clean, cohort, events as ev, noise
from pulseframe.operators.stats import interval_counts
from pulseframe.plans import dataset
from pulseframe.plans.oracle_views import convert_sql, hourly_sql, outliers_sql, u
from pulseframe.plans.registry import micros, query, r
from pulseframe.plans.views import LINE_MEDIAN, LINE_REMOVE, Tables
from pulseframe.session import scratch_path, settle
from pulseframe.sources import io, readers
from pulseframe.sources.rules import rules_table

LINE_KEY = ("stay_id", "l_linenumber", "l_partkey", "l_suppkey")
LINE_KEYS = ", ".join(LINE_KEY)


# --- A. core operators ------------------------------------------------------------------------
@query(f"SELECT {LINE_KEYS}, unit, round(value, 6) AS value FROM ({convert_sql('v_lines')})")
def convert_units(t: Tables) -> DataFrame:
    return clean.convert_units(t.lines).select(*LINE_KEY, "unit", r("value"))


@query("SELECT stay_id, code, time_us, round(value_num, 6) AS value_num, value_text, unit, source FROM v_assembled")
def assemble_events(t: Tables) -> DataFrame:
    events = dataset.raw_events(t.raw, t.rules)
    return events.select("stay_id", "code", micros("time"), r("value_num"), "value_text", "unit", "source")


@query(f"SELECT stay_id, code, unit, time_us, round(value, 6) AS value FROM ({hourly_sql('v_line_intervals', 'stay_id, code, unit')})")
def distribute_hourly(t: Tables) -> DataFrame:
    events = clean.distribute_interval_hourly(t.line_intervals)
    return events.select("stay_id", "code", "unit", micros("time"), r("value"))


@query("SELECT stay_id, admission_id, patient_id, code, epoch_us(time) AS time_us, value_num, value_text, unit FROM v_lab_stay")
def attach_stay(t: Tables) -> DataFrame:
    stays = t.raw.adult_stays().select("admission_id", "stay_id", "time_start", "time_end")
    events = clean.attach_stay(t.raw.lab(), stays)
    return events.select("stay_id", "admission_id", "patient_id", "code", micros("time"), "value_num", "value_text", "unit")


@query("SELECT stay_id, code, time_us, source, round(value, 6) AS value FROM v_selected")
def value_selectors(t: Tables) -> DataFrame:
    events = clean.apply_value_selectors(dataset.raw_events(t.raw, t.rules), t.rules)
    return events.select("stay_id", "code", micros("time"), "source", r("value"))


@query("SELECT stay_id, code, variable, epoch_us(time) AS time_us FROM v_chart JOIN v_rules USING (code)")
def code_to_variable(t: Tables) -> DataFrame:
    events = clean.map_code_to_variable(t.raw.charted(), t.rules)
    return events.select("stay_id", "code", "variable", micros("time"))


def _line_outliers(t: Tables, features) -> DataFrame:
    events = clean.process_outliers(t.lines, rules_table(t.spark, features))
    return events.select(*LINE_KEY, "variable", r("value"))


def _line_outliers_sql(rules: str) -> str:
    joined = f"(SELECT l.*, x.* EXCLUDE (code, variable, sel_kind, a, b, sel_unit) FROM v_lines l JOIN {rules} x USING (variable))"
    return f"SELECT {LINE_KEYS}, variable, round(value, 6) AS value FROM ({outliers_sql(joined)})"


@query(_line_outliers_sql("v_line_remove"))
def outliers_remove(t: Tables) -> DataFrame:
    return _line_outliers(t, LINE_REMOVE)


@query(_line_outliers_sql("v_line_median"))
def outliers_median(t: Tables) -> DataFrame:
    return _line_outliers(t, LINE_MEDIAN)


HIT = u(["event_id"], "'hit'")


@query(f"""
  SELECT event_id, variable, round(CASE WHEN {HIT} < 0.5::DOUBLE THEN value
    + sqrt(-2 * ln(1 - {u(['event_id'], "'shift-r'")})) * cos(2 * pi() * {u(['event_id'], "'shift-a'")})
    * stddev_samp(value) OVER (PARTITION BY variable) * 2.0::DOUBLE ELSE value END, 6) AS value FROM v_point_events""")
def noise_gaussian(t: Tables) -> DataFrame:
    noisy = noise.add_noise(t.point_events, "gaussian", 0.5, ["event_id"], magnitude=2.0)
    return noisy.select("event_id", "variable", r("value"))


@query(f"""
  SELECT event_id, variable, round(CASE WHEN {HIT} < 0.75::DOUBLE THEN {u(['event_id'], "'draw'")}
    * (max(value) OVER w - min(value) OVER w) + min(value) OVER w ELSE value END, 6) AS value
  FROM v_point_events WINDOW w AS (PARTITION BY variable)""")
def noise_uniform(t: Tables) -> DataFrame:
    return noise.add_noise(t.point_events, "uniform", 0.75, ["event_id"]).select("event_id", "variable", r("value"))


@query(f"""
  SELECT event_id, CASE WHEN {HIT} < 0.5::DOUBLE THEN names[1 + CAST(floor({u(['event_id'], "'pick'")} * len(names)) AS INTEGER)]
    ELSE variable END AS variable, value
  FROM v_point_events, (SELECT list_sort(list(DISTINCT variable)) AS names FROM v_point_events)""")
def noise_shuffle(t: Tables) -> DataFrame:
    return noise.add_noise(t.point_events, "shuffle", 0.5, ["event_id"]).select("event_id", "variable", "value")


@query("""
  SELECT stay_id, patient_id FROM v_order_stays WHERE stay_id IN (SELECT stay_id FROM v_lines GROUP BY 1 HAVING count(*) >= 2)""")
def active_stays(t: Tables) -> DataFrame:
    return ev.filter_active_stays(t.order_stays, t.lines).select("stay_id", "patient_id")


@query("SELECT event_id, stay_id, variable, minute FROM v_timed")
def relative_minutes(t: Tables) -> DataFrame:
    stays = t.point_events.select("stay_id").distinct()
    return ev.relative_minutes(t.point_events, stays).select("event_id", "stay_id", "variable", "minute")


@query("SELECT stay_id, patient_id, died FROM v_order_cohort")
def eligible_cohort(t: Tables) -> DataFrame:
    return t.order_cohort.select("stay_id", "patient_id", "died")


DEMOGRAPHICS = """
  SELECT stay_id, CASE WHEN age > 200 THEN 91.4::DOUBLE ELSE CAST(age AS DOUBLE) END AS age,
    CASE WHEN p.patient_id IS NULL THEN NULL WHEN gender = 'M' THEN 0 ELSE 1 END AS gender
  FROM v_order_adults s LEFT JOIN v_patients p ON s.patient_id = p.patient_id"""


@query(DEMOGRAPHICS)
def demographics(t: Tables) -> DataFrame:
    return cohort.demographics(t.order_adults, t.raw.patients())


ORDER_SPLIT = f"""
  SELECT stay_id, died, CASE WHEN x < 0.64::DOUBLE THEN 'train' WHEN x < (0.64::DOUBLE + 0.2::DOUBLE) THEN 'test' ELSE 'val' END AS split
  FROM (SELECT *, {u(['patient_id'], "'split'")} AS x FROM v_order_cohort)"""


@query(f"SELECT stay_id, split FROM ({ORDER_SPLIT})")
def split_by_patient(t: Tables) -> DataFrame:
    return cohort.split_by_entity(t.order_cohort)


LISTS = """
  SELECT o_orderkey AS stay_id, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'train' WHEN '2' THEN 'test' WHEN '3' THEN 'val' END AS split
  FROM orders WHERE substr(o_orderpriority, 1, 1) < '4'"""


@query(f"SELECT stay_id, split FROM v_order_cohort JOIN ({LISTS}) USING (stay_id)")
def split_by_list(t: Tables) -> DataFrame:
    first = F.substring("o_orderpriority", 1, 1)
    names = F.when(first == "1", "train").when(first == "2", "test").when(first == "3", "val")
    lists = t.table("orders").select(F.col("o_orderkey").alias("stay_id"), names.alias("split")).filter("split is not null")
    return cohort.split_from_lists(t.order_cohort, lists)


@query(f"""
  SELECT DISTINCT stay_id FROM v_lines
  WHERE stay_id NOT IN (SELECT stay_id FROM ({ORDER_SPLIT}) WHERE split <> 'train')""")
def train_complement(t: Tables) -> DataFrame:
    return cohort.train_complement(t.lines, cohort.split_by_entity(t.order_cohort))


LINE_EVENTS = """
  SELECT stay_id, minute, variable, avg(value) AS value, array_to_string(list_sort(list(DISTINCT source)), ',') AS source,
    min(unit) AS unit FROM v_lines GROUP BY ALL"""


@query(f"SELECT stay_id, minute, variable, round(value, 6) AS value, source, unit FROM ({LINE_EVENTS})")
def throttle(t: Tables) -> DataFrame:
    events = ev.throttle_events(t.lines)
    return events.select("stay_id", "minute", "variable", r("value"), F.array_join("source", ",").alias("source"), "unit")


@query(f"""
  SELECT 'labels' AS output, split, count(*) AS row_count, CAST(sum(stay_id) AS BIGINT) AS id_sum FROM ({ORDER_SPLIT}) GROUP BY ALL
  UNION ALL SELECT 'demographics', split, count(*), CAST(sum(stay_id) AS BIGINT) FROM ({DEMOGRAPHICS}) JOIN v_order_splits USING (stay_id) GROUP BY ALL
  UNION ALL SELECT 'events', split, count(*), CAST(sum(stay_id) AS BIGINT) FROM ({LINE_EVENTS}) JOIN v_order_splits USING (stay_id) GROUP BY ALL""")
def split_outputs(t: Tables) -> DataFrame:
    eligible, events = settle(t.order_cohort), settle(ev.throttle_events(t.lines))
    label_splits = cohort.split_by_entity(eligible)
    paths = io.write_splits(
        eligible, cohort.demographics(t.order_adults, t.raw.patients()), events, label_splits,
        cohort.complete_splits(events, label_splits), scratch_path(t.spark, "splits"),
    )
    counted = [
        io.read_split(t.spark, path).groupBy("split").agg(
            F.lit(name).alias("output"), F.count(F.lit(1)).alias("row_count"), F.sum("stay_id").alias("id_sum")
        )
        for name, path in paths.items()
    ]
    return reduce(DataFrame.unionByName, counted)


@query("""
  SELECT stay_id, split, minute, variable, round(value, 9) AS value, source, unit FROM v_full_events JOIN v_splits USING (stay_id)""")
def dataset_end_to_end(t: Tables) -> DataFrame:
    built = dataset.build_dataset(t.raw, t.rules)
    joined = built.events.join(built.splits, "stay_id")
    return joined.select(
        "stay_id", "split", "minute", "variable", r("value", 9), F.array_join("source", ",").alias("source"), "unit"
    )


@query("SELECT stay_id, split, died FROM v_label_splits")
def dataset_labels(t: Tables) -> DataFrame:
    built = dataset.build_dataset(t.raw, t.rules)
    return built.labels.join(built.label_splits, "stay_id").select("stay_id", "split", "died")


# --- B. sources and sinks -----------------------------------------------------------------------
@query("""
  SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, epoch_us(o_orderdate) AS o_orderdate_us, o_orderpriority FROM orders""")
def csv_roundtrip(t: Tables) -> DataFrame:
    orders = t.table("orders")
    folder = io.write_csv(orders, scratch_path(t.spark, "orders-csv"), "gzip")
    back = io.csv_to_parquet(t.spark, f"{folder}/*.csv.gz", scratch_path(t.spark, "orders"), orders.schema)
    return back.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", micros("o_orderdate"), "o_orderpriority")


@query(f"""
  SELECT stay_id, minute, variable, round(value, 6) AS value FROM ({LINE_EVENTS})
  WHERE variable IN ('AF', 'NO', 'RO') AND stay_id IN (SELECT stay_id FROM v_order_cohort)""")
def training_scan(t: Tables) -> DataFrame:
    path = scratch_path(t.spark, "events")
    ev.throttle_events(t.lines).write.partitionBy("variable").parquet(path)
    events = io.training_scan(t.spark, path, t.order_cohort, ["AF", "NO", "RO"])
    return events.select("stay_id", "minute", "variable", r("value"))


@query(f"SELECT stay_id, minute, variable, round(value, 6) AS value, source, unit FROM ({LINE_EVENTS})")
def materialize(t: Tables) -> DataFrame:
    key = io.table_key(t.spark, "line_events", {"step": "throttle"}, [t.path("lineitem")])
    path = scratch_path(t.spark, key)
    io.materialize(ev.throttle_events(t.lines), path, ["variable"])
    reused = io.materialize(ev.throttle_events(t.lines), path, ["variable"])
    return reused.select("stay_id", "minute", "variable", r("value"), F.array_join("source", ",").alias("source"), "unit")


@query("""
  SELECT o_orderkey AS order_key, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS day, 'priority ' || o_orderpriority AS note, o_orderstatus AS status,
    CAST(o_custkey AS BIGINT) AS customer, upper(hex(o_orderstatus)) AS raw_hex, 4 AS not_null FROM orders""")
def materialize_types(t: Tables) -> DataFrame:
    """Columns of all kinds that are declared not null: stored, found again and read back as such."""
    path = scratch_path(t.spark, io.table_key(t.spark, "order_kinds", {}, [t.path("orders")]))
    kinds = t.table("orders").select(
        F.coalesce("o_orderkey", F.lit(0)).alias("order_key"),
        F.coalesce(F.col("o_orderdate").cast("date"), F.lit(date(1970, 1, 1))).alias("day"),
        F.struct(F.col("o_orderstatus").alias("status"), F.struct(F.col("o_custkey").cast("bigint").alias("customer")).alias("who")).alias("facts"),
        F.coalesce(F.encode("o_orderstatus", "UTF-8"), F.lit(b"")).alias("raw"),
        F.col("o_orderpriority").alias("priority"),
    )
    io.materialize(kinds, path)
    stored = io.materialize(kinds, path)
    known = sum(not field.nullable for field in stored.schema)
    return stored.select(
        "order_key", F.col("day").cast("string").alias("day"), F.concat(F.lit("priority "), "priority").alias("note"), "facts.status", "facts.who.customer",
        F.hex("raw").alias("raw_hex"), F.lit(known).alias("not_null"),
    )


INVENTORY = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
             "embeddings", "pages", "benchmark", "labels", "conversations")


@query(
    " UNION ALL ".join(f"SELECT '{n}' AS file, count(*) AS row_count FROM {n}" for n in INVENTORY)
    + " UNION ALL SELECT 'Total', CAST(" + " + ".join(f"(SELECT count(*) FROM {n})" for n in INVENTORY) + " AS BIGINT)"
)
def file_inventory(t: Tables) -> DataFrame:
    table = io.file_inventory(t.spark, {n: t.path(n) for n in INVENTORY})
    return table.filter("size_mb > 0").select("file", F.col("rows").alias("row_count"))


@query(f"""
  SELECT s.stay_id, died, coalesce(n, 0) AS n_events, age, gender
  FROM (SELECT *, {u(['stay_id'], "'fixture'")} AS x FROM v_order_cohort) s
  LEFT JOIN (SELECT stay_id, count(*) AS n FROM v_lines GROUP BY 1) USING (stay_id)
  JOIN ({DEMOGRAPHICS}) USING (stay_id) WHERE x < 0.1::DOUBLE""")
def sample_dataset(t: Tables) -> DataFrame:
    demo = cohort.demographics(t.order_adults, t.raw.patients())
    labels, events, traits = io.sample_dataset(t.order_cohort.select("stay_id", "died"), t.lines, demo, 0.1)
    counts = events.groupBy("stay_id").agg(F.count(F.lit(1)).alias("n_events"))
    return labels.join(counts, "stay_id", "left").join(traits, "stay_id").select(
        "stay_id", "died", F.coalesce("n_events", F.lit(0)).alias("n_events"), "age", "gender"
    )


# --- C. readers ---------------------------------------------------------------------------------
@query("SELECT HADM_ID, epoch_us(DEATHTIME) AS DEATHTIME_us FROM v_raw_admissions WHERE DEATHTIME IS NOT NULL AND HADM_ID IS NOT NULL", name="require_not_null")
def not_null_rows(t: Tables) -> DataFrame:
    return require_not_null(t.raw_admissions, ["HADM_ID", "DEATHTIME"]).select("HADM_ID", micros("DEATHTIME"))


@query("SELECT patient_id, gender, year(dob) AS dob_year FROM v_patients")
def read_patients(t: Tables) -> DataFrame:
    return t.raw.patients().select("patient_id", "gender", F.year("dob").cast("bigint").alias("dob_year"))


@query("SELECT stay_id, patient_id, admission_id, epoch_us(time_start) AS time_start_us, epoch_us(time_end) AS time_end_us, age FROM v_stays")
def read_adult_stays(t: Tables) -> DataFrame:
    stays = t.raw.adult_stays()
    return stays.select("stay_id", "patient_id", "admission_id", micros("time_start"), micros("time_end"), F.col("age").cast("bigint").alias("age"))


@query("SELECT admission_id, patient_id, epoch_us(death_time) AS death_time_us, died FROM v_admissions")
def read_admissions(t: Tables) -> DataFrame:
    return t.raw.admissions().select("admission_id", "patient_id", micros("death_time"), "died")


@query("SELECT code, name FROM v_items")
def read_items(t: Tables) -> DataFrame:
    return t.raw.items()


@query("SELECT stay_id, code, epoch_us(time) AS time_us, value, unit FROM v_output")
def read_point_events(t: Tables) -> DataFrame:
    return t.raw.point_events().select("stay_id", "code", micros("time"), "value", "unit")


@query("SELECT stay_id, code, epoch_us(time) AS time_us, value_num, value_text, unit FROM v_chart")
def read_charted(t: Tables) -> DataFrame:
    return t.raw.charted().select("stay_id", "code", micros("time"), "value_num", "value_text", "unit")


@query("SELECT admission_id, patient_id, code, epoch_us(time) AS time_us, value_num, value_text, unit FROM v_lab")
def read_lab(t: Tables) -> DataFrame:
    return t.raw.lab().select("admission_id", "patient_id", "code", micros("time"), "value_num", "value_text", "unit")


@query("SELECT stay_id, code, epoch_us(time_start) AS time_start_us, epoch_us(time_end) AS time_end_us, value, unit FROM v_mv")
def read_interval_events(t: Tables) -> DataFrame:
    return t.raw.interval_events().select("stay_id", "code", micros("time_start"), micros("time_end"), "value", "unit")


@query("SELECT stay_id, code, epoch_us(time) AS time_us, value, unit FROM v_cv")
def read_point_inputs(t: Tables) -> DataFrame:
    return t.raw.point_inputs().select("stay_id", "code", micros("time"), "value", "unit")


@query("SELECT stay_id, CAST(code AS BIGINT) AS code, epoch_us(time) AS time_us, value, unit FROM v_weight")
def read_derived_weight(t: Tables) -> DataFrame:
    return t.raw.derived_weight().select("stay_id", "code", micros("time"), "value", "unit")


# --- D. scalar functions --------------------------------------------------------------------------
@query("""
  SELECT o_orderkey, year(o_orderdate) AS y, o_totalprice BETWEEN 100000 AND 200000 AS mid,
    substr(o_orderpriority, 1, 1) IN ('1', '2') AS urgent, coalesce(nullif(o_orderstatus, 'P'), 'none') AS status,
    CAST(round(o_totalprice) AS BIGINT) AS whole, (epoch_us(o_orderdate) - 946684800000000) // 3600000000 AS hours,
    round(least(o_totalprice, 250000) / 1000.0::DOUBLE, 5) AS capped, o_orderdate - INTERVAL 1 HOUR > TIMESTAMP '2000-01-01' AS late,
    split_part(o_orderpriority, '-', 2) AS word, regexp_replace(o_orderpriority, '[^a-zA-Z0-9]', '_', 'g') AS slug,
    TRY_CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS level,
    round(1 / (1 + exp(-(o_totalprice / 100000 - 2))), 6) AS squashed, abs(o_custkey - 700) AS gap
  FROM orders""")
def scalar_functions(t: Tables) -> DataFrame:
    o, price = t.table("orders"), F.col("o_totalprice")
    first = F.substring("o_orderpriority", 1, 1)
    epoch = F.lit("2000-01-01 00:00:00").cast("timestamp")
    return o.select(
        "o_orderkey",
        F.year("o_orderdate").cast("bigint").alias("y"),
        price.between(100_000, 200_000).alias("mid"),
        first.isin("1", "2").alias("urgent"),
        F.coalesce(F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus")), F.lit("none")).alias("status"),
        F.round(price).cast("bigint").alias("whole"),
        F.floor(F.timestamp_diff("SECOND", epoch, F.col("o_orderdate")) / 3600).alias("hours"),
        F.round(F.least(price, F.lit(250_000.0)) / 1000, 5).alias("capped"),
        (F.col("o_orderdate") - F.expr("INTERVAL 1 HOUR") > epoch).alias("late"),
        F.try_element_at(F.split("o_orderpriority", "-"), F.lit(2)).alias("word"),
        F.regexp_replace("o_orderpriority", "[^a-zA-Z0-9]", "_").alias("slug"),
        first.try_cast("int").alias("level"),
        F.round(1 / (1 + F.exp(-(price / 100_000 - 2))), 6).alias("squashed"),
        F.abs(F.col("o_custkey") - 700).alias("gap"),
    )


# --- counts of the stages -------------------------------------------------------------------------
@query(f"""
  SELECT statistic, CAST(value AS DOUBLE) AS value FROM (
    SELECT 'TotalIntervals' AS statistic, count(*) AS value FROM v_line_intervals
    UNION ALL SELECT 'LongerThanHour', count(*) FROM v_line_intervals WHERE epoch_us(time_end) - epoch_us(time_start) >= 3601000000
    UNION ALL SELECT 'HourlyRows', count(*) FROM ({hourly_sql('v_line_intervals', 'stay_id')}))""")
def hourly_counts(t: Tables) -> DataFrame:
    return interval_counts(t.line_intervals, clean.distribute_interval_hourly(t.line_intervals))
