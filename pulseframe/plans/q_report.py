"""Checked queries: statistics, correlation, journeys, prediction scores and experiment runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from pulseframe.functions import quantile as AS
from pulseframe.functions.keyed import uniform
from pulseframe.operators import clean, cohort, correlation, evaluate, events as ev, experiments, journeys, scalers, stats
from pulseframe.operators.batches import class_prevalence
from pulseframe.plans import dataset
from pulseframe.plans.oracle_views import VIEWS, interpolate_sql, u
from pulseframe.plans.registry import query, r, r_ties
from pulseframe.plans.views import Tables
from pulseframe.session import settle

P = stats.PERCENTILES
PNAMES = [f"p{int(p * 100)}" for p in P]

VIEWS.update({
    "v_le": "SELECT stay_id, minute, variable, avg(value) AS value, min(source) AS source FROM v_lines GROUP BY ALL",
    "v_daily": "SELECT stay_id, minute // 1440 AS day, variable, CAST(avg(value) AS FLOAT) AS value FROM v_processed GROUP BY ALL",
    "v_order_labels": f"""
      SELECT stay_id, patient_id, died, CASE WHEN x < 0.64::DOUBLE THEN 'train' WHEN x < (0.64::DOUBLE + 0.2::DOUBLE) THEN 'test' ELSE 'val' END AS split
      FROM (SELECT *, {u(['patient_id'], "'split'")} AS x FROM v_order_cohort)""",
    "v_pairs": """
      SELECT a.variable AS a, b.variable AS b, count(*) OVER w AS n,
        rank() OVER (PARTITION BY a.variable, b.variable ORDER BY a.value)
          + (count(*) OVER (PARTITION BY a.variable, b.variable, a.value) - 1) / 2::DOUBLE AS ra,
        rank() OVER (PARTITION BY a.variable, b.variable ORDER BY b.value)
          + (count(*) OVER (PARTITION BY a.variable, b.variable, b.value) - 1) / 2::DOUBLE AS rb
      FROM v_daily a JOIN v_daily b ON a.stay_id = b.stay_id AND a.day = b.day
      WINDOW w AS (PARTITION BY a.variable, b.variable)""",
    "v_rho": "SELECT a, b, n, CASE WHEN n >= 30 THEN corr(ra, rb) END AS rho FROM v_pairs GROUP BY a, b, n",
})


def moments_sql(source: str, subject: str, column: str = "n") -> str:
    folds = {"Mean": "avg", "Std": "stddev_samp", "Min": "min", "Max": "max"}
    return " UNION ALL ".join(
        f"SELECT '{k}{subject}' AS statistic, CAST({f}({column}) AS DOUBLE) AS value FROM {source}" for k, f in folds.items()
    )


# --- H. statistics --------------------------------------------------------------------------------
@query(f"""
  SELECT variable, round(avg(value), 4) AS mean, round(stddev_samp(value), 4) AS std, min(value) AS min, max(value) AS max,
    count(value) AS count, round(avg(pow(value - m, 3)) / pow(stddev_pop(value), 3), 4) AS skewness,
    round(kurtosis_pop(value), 4) AS kurtosis, round(stddev_samp(value) / avg(value), 6) AS cv,
    {', '.join(f'round(quantile_cont(value, {p}), 4) AS {n}' for p, n in zip(P, PNAMES))}
  FROM (SELECT *, avg(value) OVER (PARTITION BY variable) AS m FROM v_lines) GROUP BY variable""")
def variable_statistics(t: Tables) -> DataFrame:
    table = stats.variable_statistics(t.lines)
    percentiles = [F.round(F.col(f"`p{p}`"), 4).alias(n) for p, n in zip(P, PNAMES)]
    return table.select(
        "variable", r("mean", 4), r("std", 4), "min", "max", "count", r("skewness", 4), r("kurtosis", 4), r("cv"), *percentiles
    )


SAMPLE_N = 500
SAMPLED = f"""(SELECT * FROM (SELECT *, {u(['event_id'], "'sample'")} AS x, count(*) OVER (PARTITION BY variable) AS n FROM v_point_events)
  WHERE x < least(1, {SAMPLE_N}::DOUBLE / n))"""


@query(f"SELECT event_id, variable, value FROM {SAMPLED}")
def stratified_sample(t: Tables) -> DataFrame:
    return stats.stratified_sample(t.point_events, SAMPLE_N, ["event_id"]).select("event_id", "variable", "value")


def _horner(x: str, coefficients: tuple[float, ...]) -> str:
    return reduce(lambda total, c: f"({total} * {x} + {c!r}::DOUBLE)", coefficients[1:], f"{coefficients[0]!r}::DOUBLE")


def _quantile_sql(p: str) -> str:
    q = f"({p} - 0.5::DOUBLE)"
    near, far = f"(0.180625::DOUBLE - {q} * {q})", f"sqrt(-ln(least({p}, 1 - {p})))"
    middle, tail = f"({far} - 1.6::DOUBLE)", f"({far} - 5)"
    return f"""CASE WHEN abs({q}) <= 0.425 THEN {q} * {_horner(near, AS.CENTRE_NUM)} / {_horner(near, AS.CENTRE_DEN)}
      WHEN {far} <= 5 THEN sign({q}) * {_horner(middle, AS.MIDDLE_NUM)} / {_horner(middle, AS.MIDDLE_DEN)}
      ELSE sign({q}) * {_horner(tail, AS.TAIL_NUM)} / {_horner(tail, AS.TAIL_DEN)} END"""


@query(f"""
  SELECT variable, round(avg(abs(z - {_quantile_sql('p')})), 6) AS wasserstein_distance FROM (
    SELECT variable, (value - avg(value) OVER w) / stddev_samp(value) OVER w AS z,
      (row_number() OVER (PARTITION BY variable ORDER BY value) - 0.5::DOUBLE) / count(*) OVER w AS p
    FROM v_point_events WINDOW w AS (PARTITION BY variable)) GROUP BY variable""")
def normality_distance(t: Tables) -> DataFrame:
    return stats.normality_distance(t.point_events).select("variable", r("wasserstein_distance"))


JOURNEY = f"""
  {moments_sql('(SELECT count(*) AS n FROM v_le GROUP BY stay_id)', 'NumOfEventsPerStay')}
  UNION ALL {moments_sql('(SELECT (epoch_us(time_end) - epoch_us(time_start)) // 60000000 AS n FROM v_order_stays)', 'DurationMin')}
  UNION ALL {moments_sql('(SELECT count(*) AS n FROM v_order_stays GROUP BY patient_id)', 'NumOfStaysPerPatient')}
  UNION ALL SELECT 'NumPatientsWithICUStay', CAST(count(DISTINCT patient_id) AS DOUBLE) FROM v_order_stays JOIN v_le USING (stay_id)
  UNION ALL {moments_sql('(SELECT count(*) AS n FROM v_order_stays JOIN v_le USING (stay_id) GROUP BY patient_id)', 'NumOfEventsPerPatient')}"""


def _journeys(t: Tables, events: DataFrame | None = None) -> DataFrame:
    return stats.journey_statistics(ev.throttle_events(t.lines, t.lines) if events is None else events, t.order_stays)


@query(f"SELECT statistic, round(value, 6) AS value FROM ({JOURNEY})")
def journey_statistics(t: Tables) -> DataFrame:
    return _journeys(t).select("statistic", r("value"))


SPLIT_STATISTICS = """
  SELECT 'Supervised' || upper(s[1]) || s[2:] || 'DeathPrevalence' AS statistic, value FROM (
    SELECT split AS s, avg(CAST(died AS INTEGER)) AS value FROM v_order_labels GROUP BY 1)
  UNION ALL SELECT 'Supervised' || upper(s[1]) || s[2:] || 'LengthLabels', CAST(value AS DOUBLE) FROM (
    SELECT split AS s, count(*) AS value FROM v_order_labels GROUP BY 1)
  UNION ALL SELECT 'Supervised' || upper(s[1]) || s[2:] || 'LengthEvents', CAST(value AS DOUBLE) FROM (
    SELECT split AS s, count(*) AS value FROM v_order_labels JOIN v_le USING (stay_id) GROUP BY 1)
  UNION ALL SELECT 'Unsupervised' || upper(s[1]) || s[2:] || 'LengthEvents', CAST(value AS DOUBLE) FROM (
    SELECT split AS s, count(*) AS value FROM v_order_splits JOIN v_le USING (stay_id) GROUP BY 1)"""


def _splits(t: Tables):
    events, eligible = settle(ev.throttle_events(t.lines, t.lines)), settle(t.order_cohort)
    splits = cohort.complete_splits(events, cohort.split_by_entity(eligible))
    return eligible.select("stay_id", "died"), events, settle(splits)


def _split_statistics(t: Tables) -> DataFrame:
    return stats.split_statistics(*_splits(t))


@query(f"SELECT statistic, round(value, 6) AS value FROM ({SPLIT_STATISTICS})")
def split_statistics(t: Tables) -> DataFrame:
    return _split_statistics(t).select("statistic", r("value"))


@query("""
  SELECT CASE WHEN split = 'train' THEN 'supervised_train' ELSE split END AS split, CAST(sum(n) AS BIGINT) AS num_events,
    count(DISTINCT patient_id) AS num_patients, count(DISTINCT stay_id) AS num_stays
  FROM v_order_labels LEFT JOIN (SELECT stay_id, count(*) AS n FROM v_le GROUP BY 1) USING (stay_id) GROUP BY 1
  UNION ALL SELECT 'unsupervised_train', count(*), count(DISTINCT patient_id), count(DISTINCT stay_id)
  FROM v_order_splits JOIN v_le USING (stay_id) LEFT JOIN v_order_stays USING (stay_id) WHERE split = 'train'""")
def split_table(t: Tables) -> DataFrame:
    labels, events, splits = _splits(t)
    return stats.split_table(labels, events, t.order_stays, splits)


FEATURES = """
  SELECT 'NumberOfCategoricalFeatures' AS statistic, CAST(count(DISTINCT variable) AS DOUBLE) AS value FROM v_rules WHERE categorical
  UNION ALL SELECT 'NumberOfSelectedCodes', CAST(count(*) AS DOUBLE) FROM v_rules
  UNION ALL SELECT 'NumberOfFeatures', CAST(count(DISTINCT variable) AS DOUBLE) FROM v_rules
  UNION ALL SELECT 'NumberOfRawFeatures', CAST(count(DISTINCT code) AS DOUBLE) FROM v_items"""


@query(FEATURES)
def feature_statistics(t: Tables) -> DataFrame:
    return stats.feature_statistics(t.rules, t.raw.items())


RAW_NUMBERS = """
  SELECT 'TotalPatients' AS statistic, CAST(count(*) AS DOUBLE) AS value FROM v_patients
  UNION ALL SELECT 'TotalICUStays', CAST(count(*) AS DOUBLE) FROM v_stays"""


@query(RAW_NUMBERS)
def raw_numbers(t: Tables) -> DataFrame:
    return stats.raw_numbers(t.raw.patients(), t.raw.adult_stays())


@query("""
  SELECT variable, CASE WHEN grouping(source) = 1 THEN NULL ELSE source END AS source, count(value) AS count, round(avg(value), 4) AS mean,
    round(stddev_samp(value), 4) AS std, min(value) AS min, max(value) AS max
  FROM v_lines GROUP BY GROUPING SETS ((variable), (variable, source))""")
def variable_by_source(t: Tables) -> DataFrame:
    return stats.variable_by_source(t.lines).select("variable", "source", "count", r("mean", 4), r("std", 4), "min", "max")


@query("""
  SELECT 'assembled' AS stage, source, CAST(NULL AS VARCHAR) AS variable, count(*) AS row_count FROM v_assembled GROUP BY source
  UNION ALL SELECT 'selected', source, variable, count(*) FROM v_selected GROUP BY source, variable
  UNION ALL SELECT 'clean', source, variable, count(*) FROM v_clean GROUP BY source, variable""")
def stage_counts(t: Tables) -> DataFrame:
    assembled = settle(dataset.raw_events(t.raw, t.rules))
    selected = dataset.named_events(assembled, t.rules)
    counts = stats.stage_counts(assembled=assembled, selected=selected, clean=clean.process_outliers(selected, t.rules))
    return counts.withColumnRenamed("rows", "row_count")


@query("SELECT variable, round(quantile_cont(value, 0.01), 4) AS p_lo, round(quantile_cont(value, 0.99), 4) AS p_hi FROM v_lines GROUP BY 1")
def percentile_bounds(t: Tables) -> DataFrame:
    return stats.percentile_bounds(t.lines).select("variable", r("p_lo", 4), r("p_hi", 4))


@query("""
  SELECT stay_id, l_linenumber, l_partkey, l_suppkey, variable, value FROM v_lines JOIN (
    SELECT variable, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM v_lines GROUP BY 1) USING (variable)
  WHERE value BETWEEN lo AND hi""")
def trim_to_percentiles(t: Tables) -> DataFrame:
    trimmed = stats.trim_to_percentiles(t.lines, stats.percentile_bounds(t.lines))
    return trimmed.select("stay_id", "l_linenumber", "l_partkey", "l_suppkey", "variable", "value")


LINE_VARIABLES = ("AF", "AO", "NF", "NO", "RF", "RO")


@query("SELECT stay_id, CAST(minute // 1440 AS BIGINT) AS day, "
       + ", ".join(f"round(avg(value) FILTER (variable = '{v}'), 6) AS {v}" for v in LINE_VARIABLES) + " FROM v_lines GROUP BY 1, 2")
def daily_pivot(t: Tables) -> DataFrame:
    return stats.daily_pivot(t.lines, list(LINE_VARIABLES)).select("stay_id", "day", *[r(v) for v in LINE_VARIABLES])


def _pairs(t: Tables) -> DataFrame:
    return correlation.spearman_pairs(stats.daily_means(t.processed))


@query("SELECT a AS variable_a, b AS variable_b, n, round(rho, 6) AS rho FROM v_rho WHERE a IN (SELECT a FROM v_rho WHERE rho IS NOT NULL)")
def spearman_pairs(t: Tables) -> DataFrame:
    return _pairs(t).select("variable_a", "variable_b", "n", r("rho"))


@query("SELECT a AS variable, round(avg(abs(rho)), 6) AS mean_abs_rho FROM v_rho GROUP BY 1 ORDER BY avg(abs(rho)) DESC LIMIT 3")
def top_correlated(t: Tables) -> DataFrame:
    return correlation.top_correlated(_pairs(t), 3).select("variable", r("mean_abs_rho"))


#: A hundred variables: parts by the last two digits of their key, supplied by one supplier in one month of 28 days.
WIDE = """
  SELECT l_suppkey AS stay_id, CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) // 28 AS BIGINT) AS day,
    'part ' || (l_partkey % 100) AS variable, CAST(max(l_extendedprice) AS FLOAT) AS value FROM lineitem GROUP BY ALL"""


@query(f"""
  WITH wide AS ({WIDE}),
  ranked AS (
    SELECT a.variable AS a, b.variable AS b, count(*) OVER (PARTITION BY a.variable, b.variable) AS n,
      rank() OVER (PARTITION BY a.variable, b.variable ORDER BY a.value)
        + (count(*) OVER (PARTITION BY a.variable, b.variable, a.value) - 1) / 2::DOUBLE AS ra,
      rank() OVER (PARTITION BY a.variable, b.variable ORDER BY b.value)
        + (count(*) OVER (PARTITION BY a.variable, b.variable, b.value) - 1) / 2::DOUBLE AS rb
    FROM wide a JOIN wide b ON a.stay_id = b.stay_id AND a.day = b.day),
  rho AS (SELECT a, b, n, CASE WHEN n >= 30 THEN corr(ra, rb) END AS rho FROM ranked GROUP BY a, b, n)
  SELECT a AS variable_a, b AS variable_b, n, round(rho, 6) AS rho FROM rho
  WHERE a IN (SELECT a FROM rho WHERE rho IS NOT NULL) AND b IN (SELECT a FROM rho WHERE rho IS NOT NULL)""")
def spearman_wide(t: Tables) -> DataFrame:
    day = F.floor(F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")) / 28).alias("day")
    # Dealt out by the days, so that neither the greatest price nor the row of a day is shuffled anew.
    lines = t.table("lineitem").select(
        F.col("l_suppkey").alias("stay_id"), day, (F.col("l_partkey") % 100).alias("part"), F.col("l_extendedprice").cast("float").alias("value")
    ).repartition("stay_id", "day")
    variable = F.concat(F.lit("part "), F.col("part").cast("string")).alias("variable")
    wide = lines.groupBy("stay_id", "day", "part").agg(F.max("value").alias("value")).select("stay_id", "day", variable, "value")
    return correlation.spearman_pairs(wide).select("variable_a", "variable_b", "n", r("rho"))


@query("""
  WITH shape AS (
    SELECT variable, lo, hi, CASE WHEN fd > 0 THEN least(fd, st) ELSE st END AS width FROM (
      SELECT variable, min(value) AS lo, max(value) AS hi, (max(value) - min(value)) / (log2(count(*)) + 1) AS st,
        2 * (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) * pow(count(*), -1 / 3.0::DOUBLE) AS fd FROM v_lines GROUP BY 1)),
  bins AS (SELECT variable, lo, hi, CAST(least(30, ceil((hi - lo) / width)) AS INTEGER) AS n FROM shape),
  counts AS (
    SELECT variable, CAST(least(floor((value - lo) / ((hi - lo) / n)), n - 1) AS INTEGER) AS bin, count(*) AS c
    FROM v_lines JOIN bins USING (variable) GROUP BY 1, 2)
  SELECT variable, CAST(bin AS INTEGER) AS bin, round(lo + bin * ((hi - lo) / n), 4) AS left_edge, round(lo + (bin + 1) * ((hi - lo) / n), 4) AS right_edge,
    coalesce(c, 0) AS count
  FROM (SELECT *, unnest(range(n)) AS bin FROM bins) LEFT JOIN counts USING (variable, bin)""")
def histogram(t: Tables) -> DataFrame:
    return stats.histogram(t.lines).select("variable", "bin", r("left_edge", 4), r("right_edge", 4), "count")


@query("""
  WITH RECURSIVE series AS (
    SELECT stay_id, source[1:2] AS source, variable, minute, value, max(minute) OVER (PARTITION BY stay_id) AS last FROM v_processed),
  kept AS (
    SELECT stay_id, source, variable, min(minute) AS minute FROM series GROUP BY ALL
    UNION ALL
    SELECT s.stay_id, s.source, s.variable, min(s.minute) FROM kept k JOIN series s USING (stay_id, source, variable)
    WHERE (s.minute - k.minute) * 20 > s.last GROUP BY ALL)
  SELECT stay_id, source, variable, minute, CAST(trunc(value) AS INTEGER) AS value, k.minute IS NOT NULL AS shown,
    round((trunc(value) - lo) / (hi - lo), 6) AS level
  FROM series s LEFT JOIN kept k USING (stay_id, source, variable, minute)
  JOIN (SELECT variable, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM v_processed GROUP BY 1) USING (variable)""")
def thin_journey(t: Tables) -> DataFrame:
    thinned = journeys.thin_journey(t.processed, stats.percentile_bounds(t.processed))
    return thinned.select("stay_id", "source", "variable", "minute", F.col("value").cast("int").alias("value"), "shown", r("level"))


#: Prices, most of them above 32,767, as one series per supplier, status and flag.
PRICED = """
  SELECT l_suppkey AS stay_id, l_linestatus AS source, l_returnflag AS variable, l_extendedprice AS value,
    CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS minute FROM lineitem"""


@query(f"""
  WITH RECURSIVE series AS (SELECT *, max(minute) OVER (PARTITION BY stay_id) AS last FROM ({PRICED})),
  spots AS (SELECT DISTINCT stay_id, source, variable, minute, last FROM series),
  kept AS (
    SELECT stay_id, source, variable, min(minute) AS minute FROM spots GROUP BY ALL
    UNION ALL
    SELECT s.stay_id, s.source, s.variable, min(s.minute) FROM kept k JOIN spots s USING (stay_id, source, variable)
    WHERE (s.minute - k.minute) * 20 > s.last GROUP BY ALL)
  SELECT stay_id, source, variable, minute, CAST(trunc(value) AS BIGINT) AS value, k.minute IS NOT NULL AS shown,
    round((trunc(value) - lo) / (hi - lo), 4) AS level
  FROM series s LEFT JOIN kept k USING (stay_id, source, variable, minute)
  JOIN (SELECT variable, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM series GROUP BY 1) USING (variable)""")
def thin_journey_prices(t: Tables) -> DataFrame:
    minute = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date")).cast("bigint").alias("minute")
    priced = t.table("lineitem").select(
        F.col("l_suppkey").alias("stay_id"), F.col("l_linestatus").alias("source"), F.col("l_returnflag").alias("variable"),
        F.col("l_extendedprice").alias("value"), minute,
    )
    thinned = journeys.thin_journey(priced, stats.percentile_bounds(priced))
    return thinned.select("stay_id", "source", "variable", "minute", "value", "shown", r("level", 4))


@query("""
  SELECT stay_id, minute, CASE variable WHEN 'click' THEN 'Click' ELSE variable END AS variable, round(value, 6) AS value FROM v_processed
  WHERE stay_id IN (SELECT stay_id FROM v_processed GROUP BY 1 ORDER BY count(*) DESC, stay_id LIMIT 1)
    AND variable IN ('click', 'view', 'error', 'purchase') AND minute BETWEEN 200 AND 5000""")
def journey_extract(t: Tables) -> DataFrame:
    busiest = t.processed.groupBy("stay_id").count().orderBy(F.desc("count"), "stay_id").limit(1)
    extract = journeys.journey_extract(t.processed, busiest, ["click", "view", "error", "purchase"], (200, 5000), {"click": "Click"})
    return extract.select("stay_id", "minute", "variable", r("value"))


@query(f"SELECT statistic, round(value, 6) AS value FROM ({JOURNEY} UNION ALL {SPLIT_STATISTICS} UNION ALL {FEATURES} UNION ALL {RAW_NUMBERS})")
def statistics_bundle(t: Tables) -> DataFrame:
    labels, events, splits = _splits(t)
    return stats.statistics_bundle(
        _journeys(t, events), stats.split_statistics(labels, events, splits), stats.feature_statistics(t.rules, t.raw.items()),
        stats.raw_numbers(t.raw.patients(), t.raw.adult_stays()),
    ).select("statistic", r("value"))


# --- I. scores of predictions ------------------------------------------------------------------------
@query("""
  SELECT score AS threshold, round(fp / n, 9) AS fpr, round(tp / p, 9) AS tpr FROM v_thresholds
  UNION ALL SELECT CAST('inf' AS DOUBLE), 0, 0""")
def roc_curve(t: Tables) -> DataFrame:
    return evaluate.roc_curve(t.predictions).select("threshold", r_ties("fpr", 9), r_ties("tpr", 9))


@query("""
  SELECT round((sum(rank) FILTER (label = 1) - p * (p + 1) / 2::DOUBLE) / (p * (count(*) - p)), 9) AS auroc FROM (
    SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2::DOUBLE AS rank,
      sum(label) OVER () AS p FROM v_predictions) GROUP BY p""")
def auroc(t: Tables) -> DataFrame:
    return evaluate.auroc(t.predictions).select(r_ties("auroc", 9))


PR_POINTS = "SELECT score AS threshold, tp / (tp + fp) AS precision, tp / p AS recall FROM v_thresholds UNION ALL SELECT CAST('inf' AS DOUBLE), 1, 0"


@query(f"SELECT threshold, round(precision, 9) AS precision, round(recall, 9) AS recall FROM ({PR_POINTS})")
def pr_curve(t: Tables) -> DataFrame:
    return evaluate.pr_curve(t.predictions).select("threshold", r_ties("precision", 9), r_ties("recall", 9))


@query(f"""
  SELECT round(sum((recall - before) * (precision + prior) / 2), 9) AS pr_auc FROM (
    SELECT precision, recall, lag(recall) OVER w AS before, lag(precision) OVER w AS prior FROM ({PR_POINTS})
    WINDOW w AS (ORDER BY threshold DESC))""")
def pr_auc(t: Tables) -> DataFrame:
    return evaluate.pr_auc(t.predictions).select(r_ties("pr_auc", 9))


@query(f"""
  WITH roc AS (
    SELECT (sum(rank) FILTER (label = 1) - p * (p + 1) / 2::DOUBLE) / (p * (count(*) - p)) AS auroc FROM (
      SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2::DOUBLE AS rank,
        sum(label) OVER () AS p FROM v_predictions) GROUP BY p),
  pr AS (
    SELECT sum((recall - before) * (precision + prior) / 2) AS pr_auc, max(least(precision, recall)) AS minrp FROM (
      SELECT precision, recall, lag(recall) OVER w AS before, lag(precision) OVER w AS prior FROM ({PR_POINTS})
      WINDOW w AS (ORDER BY threshold DESC)))
  SELECT round((SELECT avg(score) FROM v_predictions), 9) AS mean_prediction, round(auroc, 9) AS auroc, round(pr_auc, 9) AS pr_auc,
    round(pr_auc + auroc, 9) AS pr_roc_auc_sum, round(minrp, 9) AS minrp FROM roc, pr""")
def score_metrics(t: Tables) -> DataFrame:
    return evaluate.score_metrics(t.predictions).select(*[r_ties(c, 9) for c in ("mean_prediction", "auroc", "pr_auc", "pr_roc_auc_sum", "minrp")])


@query(f"SELECT round(max(least(precision, recall)), 9) AS minrp FROM ({PR_POINTS})")
def minrp(t: Tables) -> DataFrame:
    return evaluate.minrp(t.predictions).select(r_ties("minrp", 9))


@query("""
  SELECT round(loss, 6) AS unweighted_loss, round(loss * (1 - p) / p, 6) AS weighted_loss FROM (
    SELECT avg(-(label * ln(score) + (1 - label) * ln(1 - score))) AS loss, avg(label) AS p FROM v_predictions)""")
def log_loss(t: Tables) -> DataFrame:
    preds = t.predictions
    return evaluate.log_loss(preds, class_prevalence(preds)).select(r("unweighted_loss"), r("weighted_loss"))


@query("""
  SELECT round(m, 9) AS mean_prediction, round(p, 9) AS pos_class_frac, round((m - p) / p, 9) AS pred_diff
  FROM (SELECT avg(score) AS m, avg(label) AS p FROM v_predictions)""")
def prediction_bias(t: Tables) -> DataFrame:
    return evaluate.prediction_bias(t.predictions).select(r_ties("mean_prediction", 9), r_ties("pos_class_frac", 9), r_ties("pred_diff", 9))


@query("""
  SELECT label, CAST(bin AS INTEGER) AS bin, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 9) AS joint_share,
    round(count(*) / sum(count(*)) OVER (PARTITION BY label), 9) AS class_share
  FROM (SELECT label, least(floor(score * 20), 19) AS bin FROM v_predictions) GROUP BY label, bin""")
def score_distribution(t: Tables) -> DataFrame:
    return evaluate.score_distribution(t.predictions, 20).select("label", "bin", "count", r_ties("joint_share", 9), r_ties("class_share", 9))


CELL_KEY = ["stay_id", "minute", "variable"]
VIEWS["v_cells"] = f"""
  SELECT variable, value AS true_value, value + ({u(CELL_KEY, "'error'")} - 0.5::DOUBLE) * 20 AS pred_value
  FROM v_processed WHERE {u(CELL_KEY, "'mask'")} < 0.5::DOUBLE"""


@query(f"""
  SELECT 'standard' AS space, round(avg(pow(d, 2)), 6) AS mse_loss, round(avg(abs(d)), 6) AS mae_loss FROM (
    SELECT (true_value - pred_value) / std AS d FROM v_cells JOIN v_zscores USING (variable))
  UNION ALL SELECT 'ecdf', round(avg(pow(d, 2)), 6), round(avg(abs(d)), 6) FROM (
    SELECT a.y_out - b.y_out AS d FROM
      ({interpolate_sql('(SELECT *, row_number() OVER (ORDER BY variable, true_value, pred_value) AS i FROM v_cells)', 'true_value', 'v_knots')}) a
    JOIN ({interpolate_sql('(SELECT *, row_number() OVER (ORDER BY variable, true_value, pred_value) AS i FROM v_cells)', 'pred_value', 'v_knots')}) b USING (i))""")
def masked_losses(t: Tables) -> DataFrame:
    params, knots = settle(scalers.zscore_fit(t.processed)), settle(scalers.ecdf_fit(t.processed))
    shift = (uniform(CELL_KEY, 42, "error") - 0.5) * 20
    raw = t.processed.select(
        "variable", F.col("value").alias("true"), (F.col("value") + shift).alias("pred"),
        (uniform(CELL_KEY, 42, "mask") < 0.5).alias("mask"),
    )
    cells = scalers.zscore_transform(raw, params, "true", "pred")
    losses = evaluate.masked_losses(cells, ("zscore", params), {"standard": ("zscore", params), "ecdf": ("ecdf", knots)})
    return losses.select("space", r("mse_loss"), r("mae_loss"))


# --- I. experiment runs ----------------------------------------------------------------------------------
NAMES = {n: f"Model {n}" for n in ("click", "error", "purchase", "signup", "view")}
METRICS = ["test_auroc", "test_pr_auc", "test_minrp"]
FLAT = "run_id, name, stage, kind, data, noise_type, batch_size, data_fraction, training_time, epoch, test_auroc, test_pr_auc, test_minrp"


def _flat(t: Tables, **options) -> DataFrame:
    return experiments.runs_flatten(t.runs, NAMES, metrics=tuple(METRICS), **options)


@query(f"SELECT {FLAT} FROM v_flat WHERE stage = 'finetune' AND data_fraction BETWEEN 0.1 AND 1.0")
def runs_flatten(t: Tables) -> DataFrame:
    return _flat(t, stage="finetune", fraction_range=(0.1, 1.0))


def _mean_sem_sql(metrics=METRICS, keys: str = "kind, name", source: str = "v_flat") -> str:
    return " UNION ALL ".join(
        f"SELECT {keys}, '{m}' AS metric, avg({m}) AS mean, stddev_samp({m}) / sqrt(count({m})) AS sem FROM {source} GROUP BY ALL"
        for m in metrics
    )


MEAN_SEM = f"SELECT kind, name, metric, round(mean, 3) AS mean, round(sem, 3) AS sem FROM ({_mean_sem_sql()})"


def _mean_sem(t: Tables) -> DataFrame:
    return experiments.mean_sem(_flat(t), ["kind", "name"], METRICS)


@query(MEAN_SEM)
def mean_sem(t: Tables) -> DataFrame:
    return _mean_sem(t)


@query(f"""
  SELECT data_fraction, name, metric, round(mean, 12) AS mean, round(sem, 12) AS sem
  FROM ({_mean_sem_sql(keys='data_fraction, name')})""")
def learning_curve(t: Tables) -> DataFrame:
    return experiments.mean_sem(_flat(t), ["data_fraction", "name"], METRICS, digits=12)


@query(f"""
  SELECT a.kind, a.name, a.metric, a.mean, a.sem, round((a.mean - b.mean) / b.mean, 6) AS rel_diff
  FROM ({MEAN_SEM}) a LEFT JOIN ({MEAN_SEM}) b ON a.kind = b.kind AND a.metric = b.metric AND b.name = 'Model view'""")
def baseline_diff(t: Tables) -> DataFrame:
    table = experiments.baseline_diff(_mean_sem(t), "Model view", "name", ["kind"])
    return table.select("kind", "name", "metric", "mean", "sem", r("rel_diff"))


@query(f"""
  SELECT kind, name, metric, mean, sem, CASE metric WHEN 'test_pr_auc' THEN mean = min(mean) OVER w
    WHEN 'test_minrp' THEN abs(mean) = min(abs(mean)) OVER w ELSE mean = max(mean) OVER w END AS best
  FROM ({MEAN_SEM}) WINDOW w AS (PARTITION BY kind, metric)""")
def best_flag(t: Tables) -> DataFrame:
    how = {"test_auroc": "max", "test_pr_auc": "min", "test_minrp": "abs_min"}
    return experiments.best_flag(_mean_sem(t), ["kind"], how)


@query("""
  WITH limits AS (
    SELECT data_fraction, min(a) AS lo_a, max(a) AS hi_a, min(b) AS lo_b, max(b) AS hi_b FROM (
      SELECT data, data_fraction, avg(test_auroc) AS a, avg(test_pr_auc) AS b FROM v_flat GROUP BY 1, 2) GROUP BY 1)
  SELECT run_id, data_fraction, round((test_auroc - lo_a) / (hi_a - lo_a), 6) AS test_auroc,
    round((test_pr_auc - lo_b) / (hi_b - lo_b), 6) AS test_pr_auc
  FROM v_flat LEFT JOIN limits USING (data_fraction) WHERE noise_type = 'uniform'""")
def rescale_between(t: Tables) -> DataFrame:
    flat = _flat(t)
    rescaled = experiments.rescale_between(flat.filter("noise_type = 'uniform'"), flat, ["test_auroc", "test_pr_auc"])
    return rescaled.select("run_id", "data_fraction", r("test_auroc"), r("test_pr_auc"))


@query("SELECT run_id, test_minrp FROM v_flat WHERE test_minrp IS NOT NULL ORDER BY test_minrp, run_id LIMIT 1")
def best_run(t: Tables) -> DataFrame:
    return experiments.best_run(_flat(t), "test_minrp")


@query("""
  SELECT name, data_fraction, round(training_time, 6) AS training_time, test_auroc FROM v_flat WHERE data_fraction IN (0.1, 0.5, 1.0)
  UNION ALL SELECT CASE o_orderstatus WHEN 'F' THEN 'Finished' ELSE o_orderstatus END, fraction, round(o_totalprice / 60, 6), round(score, 6) FROM (
    SELECT *, o_orderkey % 10 / 10.0::DOUBLE AS fraction, o_custkey / 10000::DOUBLE AS score FROM orders) WHERE fraction IN (0.1, 0.5, 1.0)""")
def combine_results(t: Tables) -> DataFrame:
    own = _flat(t).select("name", "data_fraction", "training_time", "test_auroc", F.lit(None).cast("double").alias("test_loss"))
    external = t.table("orders").select(
        F.col("o_orderstatus").alias("name"), (F.col("o_orderkey") % 10 / F.lit(10.0)).alias("data_fraction"),
        F.col("o_totalprice").alias("training_time"), F.round(F.col("o_custkey") / 10_000, 6).alias("test_auroc"),
    )
    both = experiments.combine_results(own, external, {"F": "Finished"}, [0.1, 0.5, 1.0])
    return both.withColumn("training_time", F.round("training_time", 6))
