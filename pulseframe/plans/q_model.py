"""Checked queries: normalisers, windows and batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pulseframe.functions.keyed import uniform
from pulseframe.operators import batches, scalers, windows
from pulseframe.operators.stats import ecdf_curve as curve, transform_comparison as compare_transforms
from pulseframe.plans import inputs
from pulseframe.plans.oracle_views import VIEWS, ecdf_sql, interpolate_sql, u, zscore_sql
from pulseframe.plans.registry import query, r
from pulseframe.plans.views import Tables
from pulseframe.session import scratch_path, settle

INPUT_MINUTES = 720
WINDOW_MINUTES = 1440
FORECAST = 120
DRAWS = 2
MAX_EVENTS = 8
BATCH = 16

VIEWS.update({
    "v_pe": "SELECT stay_id, minute, variable, value FROM v_processed",
    "v_zscores": zscore_sql("v_pe"),
    "v_knots": ecdf_sql("v_pe"),
    "v_vocabulary": """
      SELECT variable, CAST(row_number() OVER (ORDER BY variable) - 1 AS INTEGER) AS var_id FROM (SELECT DISTINCT variable FROM v_pe)""",
    "v_candidates": f"""
      SELECT DISTINCT stay_id, minute AS t1 FROM (SELECT *, max(minute) OVER (PARTITION BY stay_id) AS last FROM v_pe)
      WHERE minute >= {INPUT_MINUTES} AND minute < last""",
    "v_drawn": f"""
      SELECT stay_id, draw, t1 FROM (
        SELECT *, row_number() OVER (PARTITION BY stay_id ORDER BY {u(['stay_id', 't1'], "'t1'")}, t1) AS rank,
          count(*) OVER (PARTITION BY stay_id) AS size FROM v_candidates)
      JOIN (SELECT unnest(range({DRAWS})) AS draw) ON draw % size + 1 = rank""",
    "v_ends": "SELECT DISTINCT stay_id, t1 FROM v_drawn",
    "v_window": f"SELECT stay_id, t1, minute, variable, value FROM v_pe JOIN v_ends USING (stay_id) WHERE minute BETWEEN t1 - {WINDOW_MINUTES} AND t1",
    "v_dropout": f"""
      SELECT w.* FROM v_window w JOIN (
        SELECT *, min(first) OVER (PARTITION BY stay_id, t1) AS draw, max(us[1]) OVER (PARTITION BY stay_id, t1) AS top FROM (
          SELECT *, list_position(list_transform(us, lambda x: x > 0.5::DOUBLE), TRUE) AS first FROM (
            SELECT stay_id, t1, variable, list_transform(range(32), lambda d: {u(['stay_id', 't1', 'variable'], "'drop-' || d")}) AS us
            FROM (SELECT DISTINCT stay_id, t1, variable FROM v_window)))) v
      USING (stay_id, t1, variable) WHERE CASE WHEN draw IS NULL THEN us[1] = top ELSE us[draw] > 0.5::DOUBLE END""",
    "v_timed_window": f"""
      SELECT *, (minute - (min(minute) OVER (PARTITION BY stay_id, t1) + {WINDOW_MINUTES / 2}::DOUBLE)) / {WINDOW_MINUTES / 2}::DOUBLE AS time
      FROM v_window""",
    "v_capped": f"""
      SELECT * EXCLUDE (rank) FROM (
        SELECT *, row_number() OVER (PARTITION BY stay_id, t1 ORDER BY {u(['stay_id', 't1', 'variable', 'minute'], "'cap'")}, variable, minute) AS rank
        FROM v_timed_window) WHERE rank <= {MAX_EVENTS}""",
    "v_forecast": f"""
      SELECT stay_id, t1, list(coalesce(m, 0) ORDER BY var_id) AS vals, list(m IS NOT NULL ORDER BY var_id) AS mask FROM (
        SELECT e.stay_id, e.t1, v.var_id, f.m FROM v_ends e CROSS JOIN v_vocabulary v LEFT JOIN (
          SELECT p.stay_id, t1, variable, avg(value) AS m FROM v_pe p JOIN v_ends w ON p.stay_id = w.stay_id
            AND minute > t1 AND minute <= t1 + {FORECAST} GROUP BY ALL) f
        ON e.stay_id = f.stay_id AND e.t1 = f.t1 AND v.variable = f.variable) GROUP BY ALL""",
    "v_samples": """
      SELECT stay_id, t1, list(value ORDER BY minute, var_id) AS vals, list(time ORDER BY minute, var_id) AS times,
        list(var_id ORDER BY minute, var_id) AS variables
      FROM v_capped JOIN v_vocabulary USING (variable) GROUP BY ALL""",
    "v_batched": f"""
      SELECT *, (row_number() OVER (ORDER BY len(vals) DESC, stay_id, t1) - 1) // {BATCH} AS batch_id FROM v_samples""",
    "v_supervised": f"""
      SELECT stay_id, minute, variable, value, CASE WHEN died THEN 1 ELSE 0 END AS label FROM v_pe JOIN v_stay_labels USING (stay_id)
      WHERE minute <= {WINDOW_MINUTES}""",
})


# Arrays are compared as text; numbers in them as whole ten-thousandths.
def text(column: str | Column, alias: str) -> Column:
    scaled = F.transform(column, lambda x: F.round(x.cast("double") * 10_000).cast("bigint").cast("string"))
    return F.array_join(scaled, ",").alias(alias)


def text_sql(column: str, alias: str) -> str:
    return f"array_to_string(list_transform({column}, lambda x: CAST(round(CAST(CAST(x AS FLOAT) AS DOUBLE) * 10000) AS BIGINT)), ',') AS {alias}"


def ids(column: str, alias: str) -> Column:
    return F.array_join(F.col(column).cast("array<string>"), ",").alias(alias)


# --- F. normalisers -----------------------------------------------------------------------------
@query(f"SELECT variable, round(mean, 6) AS mean, round(std, 6) AS std FROM ({zscore_sql('v_lines')})")
def zscore_fit(t: Tables) -> DataFrame:
    return scalers.zscore_fit(t.lines).select("variable", r("mean"), r("std"))


LINE_ZSCORE = f"""
  SELECT l.* REPLACE ((value - mean) / std AS value) FROM v_lines l JOIN ({zscore_sql('v_lines')}) USING (variable)"""


@query(f"SELECT stay_id, l_linenumber, l_partkey, l_suppkey, variable, round(value, 6) AS value FROM ({LINE_ZSCORE})")
def zscore_transform(t: Tables) -> DataFrame:
    scaled = scalers.zscore_transform(t.lines, scalers.zscore_fit(t.lines))
    return scaled.select("stay_id", "l_linenumber", "l_partkey", "l_suppkey", "variable", r("value"))


@query("SELECT event_id, variable, round(e.value / 50 * std + mean, 6) AS value FROM v_point_events e JOIN v_zscores USING (variable)")
def zscore_inverse(t: Tables) -> DataFrame:
    scores = t.point_events.withColumn("value", F.col("value") / 50)
    return scalers.zscore_inverse(scores, scalers.zscore_fit(t.processed)).select("event_id", "variable", r("value"))


@query(f"SELECT variable, value, round(quantile, 9) AS quantile FROM ({ecdf_sql('v_lines')})")
def ecdf_fit(t: Tables) -> DataFrame:
    return scalers.ecdf_fit(t.lines).select("variable", "value", r("quantile", 9))


@query(f"SELECT stay_id, minute, variable, round(y_out, 6) AS value FROM ({interpolate_sql('v_pe', 'value', 'v_knots')})")
def ecdf_transform_fitted(t: Tables) -> DataFrame:
    scaled = scalers.ecdf_transform(t.processed, scalers.ecdf_fit(t.processed), fitted=True)
    return scaled.select("stay_id", "minute", "variable", r("value"))


SHIFTED = "(SELECT event_id, variable, value * 1.07::DOUBLE - 1 AS value FROM v_point_events)"


@query(f"SELECT event_id, variable, round(y_out, 6) AS value FROM ({interpolate_sql(SHIFTED, 'value', 'v_knots')})")
def ecdf_transform_unseen(t: Tables) -> DataFrame:
    unseen = t.point_events.withColumn("value", F.col("value") * 1.07 - 1)
    scaled = scalers.ecdf_transform(unseen, scalers.ecdf_fit(t.processed))
    return scaled.select("event_id", "variable", r("value"))


DRAWN = f"(SELECT event_id, variable, {u(['event_id'], repr('quantile'))} AS q FROM v_point_events)"


@query(f"SELECT event_id, variable, round(y_out, 6) AS value FROM ({interpolate_sql(DRAWN, 'q', 'v_knots', 'quantile', 'value')})")
def ecdf_inverse(t: Tables) -> DataFrame:
    drawn = t.point_events.withColumn("value", uniform(["event_id"], 42, "quantile"))
    return scalers.ecdf_inverse(drawn, scalers.ecdf_fit(t.processed)).select("event_id", "variable", r("value"))


@query("""
  SELECT stay_id, round((age - avg(age) OVER ()) / stddev_samp(age) OVER (), 6) AS age, gender * 2 - 1 AS gender FROM v_stay_traits""")
def demographic_scale(t: Tables) -> DataFrame:
    scaled = scalers.demographic_scale(t.stay_traits, scalers.demographic_fit(t.stay_traits))
    return scaled.select("stay_id", r("age"), "gender")


@query("SELECT stay_id, t1, minute, variable, round(time, 6) AS time FROM v_timed_window")
def time_scale(t: Tables) -> DataFrame:
    return scalers.time_scale(_window(t), WINDOW_MINUTES).select("stay_id", "t1", "minute", "variable", r("time"))


@query(f"""
  SELECT count(*) AS different_rows, count(*) = 0 AS equal FROM (
    (SELECT variable, quantile FROM v_knots EXCEPT ALL SELECT variable, quantile FROM ({ecdf_sql('v_timed')}))
    UNION ALL
    (SELECT variable, quantile FROM ({ecdf_sql('v_timed')}) EXCEPT ALL SELECT variable, quantile FROM v_knots))""")
def scaler_tables_equal(t: Tables) -> DataFrame:
    a, b = (scalers.ecdf_fit(df).select("variable", "quantile") for df in (t.processed, t.point_events))
    return scalers.scaler_tables_equal(a, b)


# --- G. windows and samples -----------------------------------------------------------------------
@query("""
  SELECT stay_id, minute, variable, round(value, 6) AS value FROM v_pe
  WHERE variable IN (SELECT variable FROM v_pe GROUP BY 1 ORDER BY count(*) DESC, variable LIMIT 3)""")
def top_variables(t: Tables) -> DataFrame:
    return windows.top_variables(t.processed, 3).select("stay_id", "minute", "variable", r("value"))


@query("SELECT stay_id, minute, variable, var_id FROM v_pe JOIN v_vocabulary USING (variable)")
def variable_ids(t: Tables) -> DataFrame:
    named = windows.with_variable_ids(t.processed, windows.variable_ids(t.processed))
    return named.select("stay_id", "minute", "variable", "var_id")


def _ends(t: Tables) -> DataFrame:
    return windows.draw_windows(windows.window_candidates(t.processed, INPUT_MINUTES), DRAWS)


def _window(t: Tables) -> DataFrame:
    return windows.input_window(t.processed, _ends(t), WINDOW_MINUTES)


@query("SELECT stay_id, t1 FROM v_candidates")
def window_candidates(t: Tables) -> DataFrame:
    return windows.window_candidates(t.processed, INPUT_MINUTES)


@query("SELECT stay_id, CAST(draw AS INTEGER) AS draw, t1 FROM v_drawn")
def draw_windows(t: Tables) -> DataFrame:
    return _ends(t)


@query("SELECT stay_id, t1, minute, variable, round(value, 6) AS value FROM v_window")
def input_window(t: Tables) -> DataFrame:
    return _window(t).select("stay_id", "t1", "minute", "variable", r("value"))


@query(f"SELECT stay_id, t1, {text_sql('vals', 'forecast_values')}, array_to_string(mask, ',') AS forecast_mask FROM v_forecast")
def forecast_targets(t: Tables) -> DataFrame:
    targets = windows.forecast_targets(t.processed, _ends(t), windows.variable_ids(t.processed), FORECAST)
    values = F.col("forecast_values").cast("array<float>")
    return targets.select("stay_id", "t1", text(values, "forecast_values"), ids("forecast_mask", "forecast_mask"))


@query("SELECT stay_id, t1, minute, variable, round(value, 6) AS value FROM v_dropout")
def variable_dropout(t: Tables) -> DataFrame:
    return windows.variable_dropout(_window(t), 0.5).select("stay_id", "t1", "minute", "variable", r("value"))


@query("SELECT stay_id, t1, minute, variable, round(value, 6) AS value FROM v_capped")
def cap_events(t: Tables) -> DataFrame:
    return windows.cap_events(_window(t), MAX_EVENTS).select("stay_id", "t1", "minute", "variable", r("value"))


@query("SELECT stay_id, minute, variable, round(value, 6) AS value, label FROM v_supervised")
def supervised_windows(t: Tables) -> DataFrame:
    rows = windows.supervised_windows(t.processed, t.stay_labels, WINDOW_MINUTES)
    return rows.select("stay_id", "minute", "variable", r("value"), F.col("label").cast("int").alias("label"))


def _samples(t: Tables, targets: bool = False) -> DataFrame:
    vocabulary, ends = windows.variable_ids(t.processed), settle(_ends(t))
    rows = windows.with_variable_ids(windows.input_window(t.processed, ends, WINDOW_MINUTES), vocabulary)
    forecast = windows.forecast_targets(t.processed, ends, vocabulary, FORECAST) if targets else None
    return windows.assemble_samples(rows, t.stay_traits, WINDOW_MINUTES, MAX_EVENTS, forecast)


SAMPLE_TEXT = ", ".join([text_sql("s.vals", "vals"), text_sql("times", "times"), "array_to_string(variables, ',') AS variables"])


@query(f"""
  SELECT s.stay_id, s.t1, {SAMPLE_TEXT}, age, gender,
    {text_sql('f.vals', 'forecast_values')}, array_to_string(mask, ',') AS forecast_mask
  FROM v_samples s JOIN v_forecast f ON s.stay_id = f.stay_id AND s.t1 = f.t1 JOIN v_stay_traits d ON s.stay_id = d.stay_id""")
def assemble_samples(t: Tables) -> DataFrame:
    samples = _samples(t, targets=True)
    return samples.select(
        "stay_id", "t1", text("values", "vals"), text("times", "times"), ids("variables", "variables"),
        F.col("demographics")[0].cast("double").alias("age"), F.col("demographics")[1].cast("int").alias("gender"),
        text("forecast_values", "forecast_values"), ids("forecast_mask", "forecast_mask"),
    )


@query("SELECT stay_id, t1, batch_id, len(vals) AS length FROM v_batched")
def length_batches(t: Tables) -> DataFrame:
    batched = batches.length_batches(_samples(t), BATCH)
    return batched.select("stay_id", "t1", "batch_id", F.size("values").cast("bigint").alias("length"))


PADDED_WIDTH = "CAST(ceil(max(len(vals)) OVER (PARTITION BY batch_id) / 8.0) AS INTEGER) * 8"


@query(f"""
  SELECT stay_id, t1, batch_id, {text_sql('list_concat(vals, list_resize(CAST([] AS DOUBLE[]), width - len(vals), 99.0))', 'vals')},
    array_to_string(list_concat(variables, list_resize(CAST([] AS INTEGER[]), width - len(vals), 99)), ',') AS variables,
    array_to_string(list_transform(range(width), lambda i: i < len(vals)), ',') AS input_mask
  FROM (SELECT *, {PADDED_WIDTH} AS width FROM v_batched)""")
def pad_batches(t: Tables) -> DataFrame:
    padded = batches.pad_batches(batches.length_batches(_samples(t), BATCH), pad=99)
    return padded.select(
        "stay_id", "t1", "batch_id", text("values", "vals"), ids("variables", "variables"), ids("input_mask", "input_mask")
    )


@query(f"""
  SELECT stay_id FROM (
    SELECT stay_id, row_number() OVER (ORDER BY {u(['stay_id'], "'fold'")}, stay_id) AS row, count(*) OVER () AS n FROM v_order_stays)
  WHERE row > floor(3 * (n - ceil(0.3::DOUBLE * n)) / 9) AND row <= floor(3 * (n - ceil(0.3::DOUBLE * n)) / 9) + ceil(0.3::DOUBLE * n)""")
def fold_subset(t: Tables) -> DataFrame:
    return batches.fold_subset(t.order_stays.select("stay_id"), 0.3, fold=3, folds=10)


@query("SELECT stay_id, died, repeat FROM v_stay_labels, (SELECT CAST(unnest(range(1, 4)) AS INTEGER) AS repeat)")
def repeat_rows(t: Tables) -> DataFrame:
    return batches.repeat_rows(t.stay_labels, 3)


@query("SELECT died, count(*) AS n, round(1.0::DOUBLE / count(*) / (SELECT count(DISTINCT died) FROM v_order_cohort), 12) AS weight FROM v_order_cohort GROUP BY died")
def class_weights(t: Tables) -> DataFrame:
    return batches.class_weights(t.order_cohort, "died").select("died", "n", r("weight", 12))


@query(f"""
  WITH placed AS (SELECT stay_id, died, row_number() OVER (PARTITION BY died ORDER BY stay_id) AS place,
                    count(*) OVER (PARTITION BY died) AS n FROM v_order_cohort),
  classes AS (SELECT died, n, row_number() OVER (ORDER BY died) AS class FROM (SELECT DISTINCT died, n FROM placed)),
  draws AS (SELECT unnest(range((SELECT count(*) FROM v_order_cohort))) AS draw)
  SELECT draw, stay_id, p.died FROM draws
  JOIN classes c ON class = CAST(floor({u(['draw'], "'class'")} * (SELECT count(*) FROM classes)) AS BIGINT) + 1
  JOIN placed p ON p.died = c.died AND place = CAST(floor({u(['draw'], "'place'")} * c.n) AS BIGINT) + 1""")
def balanced_resample(t: Tables) -> DataFrame:
    labels = settle(t.order_cohort.select("stay_id", "died"))
    return batches.balanced_resample(labels, ["stay_id"], "died")


@query("""
  SELECT round(p, 9) AS pos_class_frac, round(CASE WHEN p = 0 THEN 1 ELSE (1 - p) / p END, 9) AS pos_class_weight
  FROM (SELECT avg(CAST(died AS INTEGER)) AS p FROM v_order_cohort)""")
def class_prevalence(t: Tables) -> DataFrame:
    return batches.class_prevalence(t.order_cohort, "died").select(r("pos_class_frac", 9), r("pos_class_weight", 9))


@query("SELECT variable, value, round(quantile, 9) AS quantile FROM v_knots WHERE variable IN ('click', 'purchase')")
def ecdf_curve(t: Tables) -> DataFrame:
    return curve(t.processed, ["click", "purchase"]).select("variable", "value", r("quantile", 9))


def _even_histogram(source: str, space: str) -> str:
    return f"""
      SELECT variable, bin, round(left_edge, 6) AS left_edge, round(right_edge, 6) AS right_edge, n AS count, '{space}' AS space FROM (
        SELECT variable, bin, lo + bin * ((hi - lo) / 15) AS left_edge, lo + (bin + 1) * ((hi - lo) / 15) AS right_edge, n FROM (
          SELECT variable, lo, hi, unnest(range(15)) AS bin FROM (SELECT variable, min(value) AS lo, max(value) AS hi FROM {source} GROUP BY 1))
        LEFT JOIN (
          SELECT variable, least(floor((value - lo) / ((hi - lo) / 15)), 14) AS bin, count(*) AS n FROM {source}
          JOIN (SELECT variable, min(value) AS lo, max(value) AS hi FROM {source} GROUP BY 1) USING (variable) GROUP BY 1, 2) c
        USING (variable, bin))"""


VIEWS["v_pe_z"] = "SELECT variable, (value - mean) / std AS value FROM v_pe JOIN v_zscores USING (variable)"
VIEWS["v_pe_q"] = "SELECT variable, quantile AS value FROM v_pe JOIN v_knots USING (variable, value)"


@query("SELECT * REPLACE (coalesce(count, 0) AS count, CAST(bin AS INTEGER) AS bin) FROM ("
       + " UNION ALL ".join(_even_histogram(s, n) for s, n in (("v_pe", "original"), ("v_pe_z", "zscore"), ("v_pe_q", "ecdf"))) + ")")
def transform_comparison(t: Tables) -> DataFrame:
    return compare_transforms(t.processed).select("variable", "bin", r("left_edge"), r("right_edge"), "count", "space")


# --- composed model input: fitted on four stays of five, stored, read back, applied to the others ----------------
DROPOUT = 0.95
TRAIN, OTHER = "stay_id % 5 <> 0", "stay_id % 5 = 0"
VIEWS.update({
    "v_in_variables": f"""
      SELECT variable, CAST(row_number() OVER (ORDER BY variable) - 1 AS INTEGER) AS var_id, mean, std
      FROM ({zscore_sql(f'(SELECT * FROM v_pe WHERE {TRAIN})')})""",
    "v_in_traits": f"""
      SELECT stay_id, (age - (SELECT avg(age) FROM v_stay_traits WHERE {TRAIN})) / (SELECT stddev_samp(age) FROM v_stay_traits WHERE {TRAIN}) AS age,
        gender * 2 - 1 AS gender FROM v_stay_traits""",
    "v_in_events": f"""
      SELECT stay_id, minute - min(minute) OVER (PARTITION BY stay_id) AS minute, variable, var_id, (value - mean) / std AS value
      FROM v_pe JOIN v_in_variables USING (variable) WHERE {OTHER}""",
    "v_in_placed": f"""
      SELECT stay_id, t1, draw, size, CAST((row_number() OVER (PARTITION BY stay_id, draw ORDER BY {u(['stay_id', 't1'], "'t1'")}, t1) - 1 - draw) % size + size AS BIGINT) % size AS place
      FROM (SELECT *, count(*) OVER (PARTITION BY stay_id) AS size FROM (
        SELECT DISTINCT stay_id, minute AS t1 FROM (SELECT *, max(minute) OVER (PARTITION BY stay_id) AS last FROM v_in_events)
        WHERE minute >= {INPUT_MINUTES} AND minute < last)), (SELECT CAST(unnest(range({DRAWS})) AS INTEGER) AS draw)""",
    "v_in_kept": f"""
      SELECT stay_id, draw, t1, variable FROM (
        SELECT *, CAST(floor(ln(1 - {u(['stay_id', 't1', 'variable', 'draw'], "'kept'")}) / ln({DROPOUT}::DOUBLE)) AS BIGINT) * size + place AS visit
        FROM (SELECT DISTINCT p.*, variable FROM v_in_placed p JOIN v_in_events e ON p.stay_id = e.stay_id AND minute BETWEEN t1 - {WINDOW_MINUTES} AND t1))
      QUALIFY visit = min(visit) OVER (PARTITION BY stay_id, draw)""",
    "v_in_window": f"""
      SELECT k.stay_id, draw, t1, minute, k.variable, var_id, value,
        (minute - (min(minute) OVER (PARTITION BY k.stay_id, draw, t1) + {WINDOW_MINUTES / 2}::DOUBLE)) / {WINDOW_MINUTES / 2}::DOUBLE AS time
      FROM v_in_kept k JOIN v_in_events e ON k.stay_id = e.stay_id AND k.variable = e.variable AND minute BETWEEN t1 - {WINDOW_MINUTES} AND t1""",
    "v_in_samples": f"""
      SELECT stay_id, draw, t1, list(value ORDER BY minute, var_id) AS vals, list(time ORDER BY minute, var_id) AS times, list(var_id ORDER BY minute, var_id) AS variables
      FROM (SELECT * FROM v_in_window QUALIFY row_number() OVER (
        PARTITION BY stay_id, draw, t1 ORDER BY {u(['stay_id', 'draw', 't1', 'variable', 'minute'], "'cap'")}, variable, minute) <= {MAX_EVENTS}) GROUP BY ALL""",
    "v_in_forecast": f"""
      SELECT stay_id, t1, list(coalesce(m, 0) ORDER BY var_id) AS vals, list(m IS NOT NULL ORDER BY var_id) AS mask FROM (
        SELECT e.stay_id, e.t1, v.var_id, f.m FROM (SELECT DISTINCT stay_id, t1 FROM v_in_kept) e CROSS JOIN v_in_variables v LEFT JOIN (
          SELECT p.stay_id, t1, p.var_id, avg(value) AS m FROM v_in_events p JOIN (SELECT DISTINCT stay_id, t1 FROM v_in_kept) w ON p.stay_id = w.stay_id
            AND minute > t1 AND minute <= t1 + {FORECAST} GROUP BY ALL) f
        ON e.stay_id = f.stay_id AND e.t1 = f.t1 AND v.var_id = f.var_id) GROUP BY ALL""",
    "v_in_early": f"""
      SELECT stay_id, minute, variable, var_id, value, label FROM (
        SELECT *, min(cycle) OVER (PARTITION BY stay_id) AS least FROM (
          SELECT e.*, CASE WHEN died THEN 1 ELSE 0 END AS label, CAST(floor(ln(1 - {u(['stay_id', 'variable'], "'kept'")}) / ln({DROPOUT}::DOUBLE)) AS BIGINT) AS cycle
          FROM v_in_events e JOIN v_stay_labels USING (stay_id) WHERE minute <= {WINDOW_MINUTES})) WHERE cycle = least""",
    "v_in_labeled": f"""
      SELECT stay_id, label, list(value ORDER BY minute, var_id) AS vals, list(time ORDER BY minute, var_id) AS times, list(var_id ORDER BY minute, var_id) AS variables
      FROM (SELECT *, (minute - (min(minute) OVER (PARTITION BY stay_id) + {WINDOW_MINUTES / 2}::DOUBLE)) / {WINDOW_MINUTES / 2}::DOUBLE AS time FROM v_in_early
        QUALIFY row_number() OVER (PARTITION BY stay_id ORDER BY {u(['stay_id', 't', 'variable', 'minute'], "'cap'").replace("CAST(t AS VARCHAR)", f"'{WINDOW_MINUTES}'")}, variable, minute) <= {MAX_EVENTS})
      GROUP BY ALL""",
})


def _fitted(t: Tables) -> inputs.Fitted:
    path = scratch_path(t.spark, "fitted")
    inputs.save(inputs.fit(t.processed.filter(TRAIN), t.stay_traits.filter(TRAIN), WINDOW_MINUTES), path)
    return inputs.load(t.spark, path)


IN_WIDTH = "CAST(ceil(max(len(vals)) OVER (PARTITION BY batch_id) / 8.0) AS INTEGER) * 8"
IN_PADDED = f"""
    {text_sql('list_concat(w.vals, list_resize(CAST([] AS DOUBLE[]), width - len(w.vals), 99.0))', 'vals')},
    {text_sql('list_concat(times, list_resize(CAST([] AS DOUBLE[]), width - len(w.vals), 99.0))', 'times')},
    array_to_string(list_concat(variables, list_resize(CAST([] AS INTEGER[]), width - len(w.vals), 99)), ',') AS variables"""


def _shown(rows: DataFrame) -> list[Column]:
    return [
        "batch_id", text("values", "vals"), text("times", "times"), ids("variables", "variables"),
        F.round(F.col("demographics")[0].cast("double"), 4).alias("age"), F.col("demographics")[1].cast("int").alias("gender"),
    ]


@query(f"""
  WITH placed AS (
    SELECT *, (row_number() OVER (ORDER BY len(vals) DESC, stay_id, draw, t1) - 1) // {BATCH} AS batch_id FROM v_in_samples),
  wide AS (SELECT *, {IN_WIDTH} AS width FROM placed)
  SELECT w.stay_id, draw, w.t1, batch_id, {IN_PADDED}, round(CAST(CAST(age AS FLOAT) AS DOUBLE), 4) AS age, CAST(gender AS INTEGER) AS gender,
    {text_sql('f.vals', 'forecast_values')}, array_to_string(f.mask, ',') AS forecast_mask
  FROM wide w JOIN v_in_forecast f ON w.stay_id = f.stay_id AND w.t1 = f.t1 JOIN v_in_traits d ON w.stay_id = d.stay_id""")
def pretrain_input_end_to_end(t: Tables) -> DataFrame:
    samples = inputs.pretrain_input(
        t.processed.filter(OTHER), t.stay_traits, _fitted(t), min_input=INPUT_MINUTES, forecast=FORECAST, max_events=MAX_EVENTS, dropout=DROPOUT, draws=DRAWS
    )
    rows = inputs.batched(samples, BATCH, 99)
    return rows.select("stay_id", "draw", "t1", *_shown(rows), text("forecast_values", "forecast_values"), ids("forecast_mask", "forecast_mask"))


@query(f"""
  WITH placed AS (SELECT *, (row_number() OVER (ORDER BY len(vals) DESC, stay_id) - 1) // {BATCH} AS batch_id FROM v_in_labeled),
  wide AS (SELECT *, {IN_WIDTH} AS width FROM placed)
  SELECT w.stay_id, label, batch_id, {IN_PADDED}, round(CAST(CAST(age AS FLOAT) AS DOUBLE), 4) AS age, CAST(gender AS INTEGER) AS gender
  FROM wide w JOIN v_in_traits d ON w.stay_id = d.stay_id""")
def finetune_input_end_to_end(t: Tables) -> DataFrame:
    samples = inputs.finetune_input(t.processed.filter(OTHER), t.stay_labels, t.stay_traits, _fitted(t), max_events=MAX_EVENTS, dropout=DROPOUT)
    rows = inputs.batched(samples, BATCH, 99, ("stay_id", "t1"))
    return rows.select("stay_id", F.col("label").cast("int").alias("label"), *_shown(rows))
