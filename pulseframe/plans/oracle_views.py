"""SQL views over the test tables, used to check the Spark results independently."""

from __future__ import annotations

from pulseframe.plans.views import EPOCH, LINE_MEDIAN, LINE_REMOVE, RULES, TYPES, WEEK
from pulseframe.sources.rules import DEFAULTS


def u(keys: list[str], salt: str, seed: int = 42) -> str:
    """The keyed uniform draw of ``functions.keyed`` in SQL; ``salt`` is an SQL expression."""
    parts = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    digest = f"md5(concat_ws('|', {parts}, '{seed}', {salt}))"
    return f"(CAST('0x' || substr({digest}, 1, 13) AS BIGINT) / 4503599627370496::DOUBLE)"


def literal(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, bool):
        return str(x).upper()
    if isinstance(x, str):
        return f"'{x}'"
    if isinstance(x, list):
        return "[" + ", ".join(literal(v) for v in x) + "]"
    return f"{x!r}::DOUBLE" if isinstance(x, float) else str(x)


def rules_sql(features=RULES) -> str:
    columns = [c for c in DEFAULTS if c != "text_map"]
    types = {"a": "DOUBLE", "b": "DOUBLE", "lo": "DOUBLE", "hi": "DOUBLE", "units": "VARCHAR[]",
             "sel_unit": "VARCHAR", "action": "VARCHAR"}
    rows = []
    for rule in features:
        spec = {**DEFAULTS, **rule}
        cells = [f"CAST({literal(spec[c])} AS {types[c]})" if c in types else literal(spec[c]) for c in columns]
        rows += [f"({code}, '{spec['variable']}', {', '.join(cells)})" for code in spec["codes"]]
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS x(code, variable, {', '.join(columns)})"


def texts_sql() -> str:
    rows = [
        f"({code}, '{text}', {number!r}::DOUBLE)"
        for rule in RULES for code in rule["codes"] for text, number in (rule.get("text_map") or {}).items()
    ]
    return f"SELECT * FROM (VALUES {', '.join(rows)}) AS x(code, txt, num)"


def hourly_sql(source: str, keep: str) -> str:
    """Hourly pieces of ``source``, which has time_start, time_end, value and the ``keep`` columns."""
    return f"""
      SELECT {keep}, time_us, value FROM (
        WITH src AS (
          SELECT *, epoch_us(time_end) AS e, (epoch_us(time_end) - epoch_us(time_start)) // 1000000 AS secs FROM {source}
        ), long AS (
          SELECT *, value * 3600.0::DOUBLE / secs AS hourly, secs % 3600 AS rest FROM src WHERE secs > 3600
        )
        SELECT {keep}, e AS time_us, value FROM src WHERE secs BETWEEN 0 AND 3600
        UNION ALL
        SELECT {keep}, e - (secs - i * 3600) * 1000000, hourly
          FROM (SELECT *, unnest(range(1, secs // 3600)) AS i FROM long)
        UNION ALL
        SELECT {keep}, e, hourly * (rest / 3600::DOUBLE + 1) FROM long WHERE rest < 300
        UNION ALL
        SELECT {keep}, e - rest * 1000000, hourly FROM long WHERE rest >= 300
        UNION ALL
        SELECT {keep}, e, hourly * rest / 3600::DOUBLE FROM long WHERE rest >= 300
      )"""


def convert_sql(source: str, value: str = "value") -> str:
    return f"""
      SELECT * REPLACE (
        CASE unit WHEN 'mcg' THEN {value} * 0.001::DOUBLE WHEN 'L' THEN {value} * 1000::DOUBLE ELSE {value} END AS {value},
        CASE unit WHEN 'mcg' THEN 'mg' WHEN 'L' THEN 'ml' ELSE unit END AS unit)
      FROM {source}"""


def outliers_sql(source: str) -> str:
    """Outlier treatment of ``source``, whose rows already carry the rule columns."""
    return f"""
      SELECT * EXCLUDE (valid, med) REPLACE (
        CASE WHEN action = 'replace_with_median' AND NOT valid THEN med ELSE value END AS value)
      FROM (SELECT *, quantile_disc(CASE WHEN valid THEN value END, 0.5) OVER (PARTITION BY variable) AS med
            FROM (SELECT *, coalesce(value BETWEEN lo AND hi AND
                    CASE WHEN unit_waiver THEN value = 0 OR list_contains(units, unit)
                         ELSE units IS NULL OR list_contains(units, unit) END, FALSE) AS valid
                  FROM {source}))
      WHERE action IS NULL OR action = 'replace_with_median' OR valid"""


def ecdf_sql(source: str) -> str:
    """Knots of ``source(variable, value)``."""
    return f"""
      SELECT variable, value, (cum - c + (c + 1) / 2::DOUBLE) / n AS quantile
      FROM (SELECT variable, value, c,
                   sum(c) OVER (PARTITION BY variable ORDER BY value) AS cum, sum(c) OVER (PARTITION BY variable) AS n
            FROM (SELECT variable, value, count(*) AS c FROM {source} GROUP BY 1, 2))"""


def interpolate_sql(source: str, col: str, knots: str, x: str = "value", y: str = "quantile") -> str:
    """``source`` with ``y_out``: its ``col`` on the line through the knots, by two as-of joins."""
    return f"""
      SELECT s.*, CASE WHEN l.{x} IS NULL THEN h.{y} WHEN h.{x} IS NULL OR h.{x} = l.{x} THEN l.{y}
                       ELSE l.{y} + (h.{y} - l.{y}) / (h.{x} - l.{x}) * (s.{col} - l.{x}) END AS y_out
      FROM {source} s
      ASOF LEFT JOIN {knots} l ON s.variable = l.variable AND s.{col} >= l.{x}
      ASOF LEFT JOIN {knots} h ON s.variable = h.variable AND s.{col} <= h.{x}
      WHERE l.{x} IS NOT NULL OR h.{x} IS NOT NULL"""


def zscore_sql(source: str) -> str:
    return f"""
      SELECT variable, avg(value) AS mean, CASE WHEN stddev_samp(value) > 0 THEN stddev_samp(value) ELSE 1 END AS std
      FROM {source} GROUP BY variable"""


UNIT = "CASE k % 3 WHEN 0 THEN 'mcg' WHEN 1 THEN 'L' ELSE 'ml' END"
LINE_UNIT = "CASE l_returnflag WHEN 'A' THEN 'mcg' WHEN 'N' THEN 'L' ELSE 'ml' END"

VIEWS = {
    # events as readings
    "v_ev": f"""
      SELECT event_id, ts, user_id, event_type, value, k, w, t, user_id * 1000 + w AS stay FROM (
        SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k,
          (epoch_us(ts) - {EPOCH}000000) // {WEEK}000000 AS w,
          CAST(list_position({literal(list(TYPES))}, event_type) AS BIGINT) AS t FROM events)""",
    "v_point_events": f"""
      SELECT event_id, stay AS stay_id, user_id AS admission_id, event_type AS variable, ts AS time, value,
        {UNIT} AS unit, 's' || (k % 2) AS source FROM v_ev""",
    "v_timed": """
      SELECT stay_id, variable, value, unit, source, event_id,
        CAST(round(((epoch_us(time) - min(epoch_us(time)) OVER (PARTITION BY stay_id)) // 1000000) / 60.0::DOUBLE) AS INTEGER) AS minute
      FROM v_point_events""",
    "v_processed": """
      SELECT stay_id, minute, variable, avg(value) AS value, array_to_string(list_sort(list(DISTINCT source)), ',') AS source,
        min(unit) AS unit
      FROM v_timed GROUP BY ALL""",
    "v_lines": f"""
      SELECT l_orderkey AS stay_id, l_linenumber, l_partkey, l_suppkey,
        CAST(l_linenumber * 300 + l_partkey % 300 AS INTEGER) AS minute, l_returnflag || l_linestatus AS variable,
        l_extendedprice AS value, {LINE_UNIT} AS unit, 's' || (l_suppkey % 3) AS source FROM lineitem""",
    "v_line_intervals": f"""
      SELECT stay_id, code, time_end - to_seconds(s) AS time_start, time_end, value, unit FROM (
        SELECT l_orderkey AS stay_id, l_partkey AS code, l_shipdate + to_seconds(l_partkey % 1440 * 60) AS time_end,
          CAST(l_quantity * 420 AS BIGINT) - CASE WHEN l_linenumber = 7 THEN 9000 ELSE l_suppkey % 60 END AS s,
          l_extendedprice AS value, {LINE_UNIT} AS unit FROM lineitem)""",
    # orders as stays
    "v_order_stays": """
      SELECT o_orderkey AS stay_id, o_custkey AS patient_id, o_orderkey AS admission_id, o_orderdate AS time_start,
        o_orderdate + to_hours(o_orderkey % 72) AS time_end FROM orders""",
    "v_order_admissions": """
      SELECT o_orderkey AS admission_id, o_custkey AS patient_id, o_orderstatus = 'F' AS died,
        CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_hours(o_custkey % 48) END AS death_time FROM orders""",
    "v_order_adults": """
      SELECT s.*, coalesce(year(time_start) - year(DOB), 0) AS age
      FROM v_order_stays s LEFT JOIN v_raw_patients p ON s.patient_id = p.SUBJECT_ID""",
    "v_order_cohort": """
      SELECT s.*, a.died FROM v_order_stays s JOIN v_order_admissions a USING (admission_id)
      WHERE epoch_us(time_end) - epoch_us(time_start) >= 86400000000
        AND (death_time IS NULL OR epoch_us(death_time) - epoch_us(time_start) >= 86400000000)
        AND stay_id IN (SELECT stay_id FROM v_lines WHERE minute < 1440)""",
    "v_order_held_out": f"""
      SELECT stay_id, CASE WHEN x < (0.64::DOUBLE + 0.2::DOUBLE) THEN 'test' ELSE 'val' END AS split
      FROM (SELECT *, {u(['patient_id'], "'split'")} AS x FROM v_order_cohort) WHERE x >= 0.64::DOUBLE""",
    "v_order_splits": """
      SELECT stay_id, split FROM v_order_held_out UNION ALL
      SELECT DISTINCT stay_id, 'train' FROM v_lines WHERE stay_id NOT IN (SELECT stay_id FROM v_order_held_out)""",
    # raw tables
    "v_raw_patients": """
      SELECT c_custkey AS SUBJECT_ID,
        CASE WHEN c_custkey % 17 <> 0 THEN make_timestamp(CASE WHEN c_custkey % 10 = 3 THEN 1700 ELSE 1930 + c_custkey % 90 END, 6, 15, 0, 0, 0.0) END AS DOB,
        CASE WHEN c_mktsegment = 'AUTOMOBILE' OR (c_mktsegment = 'MACHINERY' AND c_nationkey > 0) THEN 'M'
             WHEN c_mktsegment <> 'MACHINERY' THEN 'F' END AS GENDER
      FROM customer""",
    "v_raw_stays": f"""
      SELECT stay AS ICUSTAY_ID, user_id AS SUBJECT_ID, user_id AS HADM_ID, start AS INTIME,
        CASE WHEN (user_id + w) % 29 <> 0 THEN start + to_hours(12 + (user_id * 7 + w * 13) % 108) END AS OUTTIME
      FROM (SELECT DISTINCT stay, user_id, w, make_timestamp((w * {WEEK} + {EPOCH} + 86400) * 1000000) AS start FROM v_ev)""",
    "v_raw_admissions": f"""
      SELECT c_custkey AS HADM_ID, c_custkey AS SUBJECT_ID, CAST(c_nationkey % 4 = 0 AS INTEGER) AS HOSPITAL_EXPIRE_FLAG,
        CASE WHEN c_nationkey % 4 = 0 THEN make_timestamp(({EPOCH} + c_custkey * 5 % 720 * 3600) * 1000000) END AS DEATHTIME
      FROM customer""",
    "v_raw_chart": f"""
      SELECT stay AS ICUSTAY_ID, user_id AS SUBJECT_ID, ts AS CHARTTIME, 100 + 10 * t + k % 2 AS ITEMID,
        CASE WHEN k % 10 < 7 THEN value END AS VALUENUM,
        CASE WHEN k % 20 = 9 THEN 'calm' WHEN k % 20 = 19 THEN 'restless'
             WHEN k % 10 = 7 THEN CAST(k AS VARCHAR) END AS VALUE,
        {UNIT} AS VALUEUOM, CASE WHEN k % 7 = 0 THEN 1 WHEN k % 7 <> 1 THEN 0 END AS ERROR FROM v_ev""",
    "v_raw_lab": f"""
      SELECT user_id AS HADM_ID, user_id AS SUBJECT_ID, ts AS CHARTTIME, 200 + 10 * t + k % 2 AS ITEMID,
        CASE WHEN k % 10 < 8 THEN value END AS VALUENUM,
        CASE WHEN k % 20 = 9 THEN 'device on' WHEN k % 20 = 19 THEN 'device off' END AS VALUE,
        {UNIT} AS VALUEUOM FROM v_ev""",
    "v_raw_output": """
      SELECT stay AS ICUSTAY_ID, user_id AS SUBJECT_ID, ts AS CHARTTIME, 300 + 10 * t AS ITEMID,
        CASE WHEN k % 13 <> 0 THEN value END AS VALUE, 'ml' AS VALUEUOM FROM v_ev""",
    "v_raw_cv": f"""
      SELECT stay AS ICUSTAY_ID, user_id AS SUBJECT_ID, ts AS CHARTTIME, 400 + 10 * t AS ITEMID, value AS AMOUNT,
        CASE WHEN k % 5 <> 0 THEN {UNIT} END AS AMOUNTUOM FROM v_ev""",
    "v_raw_mv": f"""
      SELECT stay AS ICUSTAY_ID, user_id AS SUBJECT_ID,
        ts - to_seconds(k * 420 - 600 + CASE WHEN k % 4 = 1 THEN 170 ELSE 0 END) AS STARTTIME, ts AS ENDTIME,
        500 + 10 * t AS ITEMID, value AS AMOUNT, {UNIT} AS AMOUNTUOM,
        CASE WHEN k % 3 = 0 THEN CAST(k + 40 AS DOUBLE) END AS PATIENTWEIGHT FROM v_ev""",
    # cleaned relations
    "v_patients": """
      SELECT SUBJECT_ID AS patient_id, DOB AS dob, GENDER AS gender FROM v_raw_patients
      WHERE DOB IS NOT NULL AND GENDER IS NOT NULL""",
    "v_stays": """
      SELECT ICUSTAY_ID AS stay_id, SUBJECT_ID AS patient_id, HADM_ID AS admission_id, INTIME AS time_start,
        OUTTIME AS time_end, year(INTIME) - year(dob) AS age
      FROM v_raw_stays JOIN v_patients ON SUBJECT_ID = patient_id
      WHERE OUTTIME IS NOT NULL AND year(INTIME) - year(dob) >= 18""",
    "v_admissions": """
      SELECT HADM_ID AS admission_id, SUBJECT_ID AS patient_id, DEATHTIME AS death_time, HOSPITAL_EXPIRE_FLAG = 1 AS died
      FROM v_raw_admissions WHERE HADM_ID IN (SELECT admission_id FROM v_stays)""",
    "v_items": """
      SELECT p_partkey AS code, p_name AS name FROM part WHERE p_size <> 13 AND p_name IS NOT NULL
      UNION ALL SELECT s_suppkey + 1000000, s_name FROM supplier WHERE s_name IS NOT NULL""",
    "v_chart": """
      SELECT ICUSTAY_ID AS stay_id, ITEMID AS code, CHARTTIME AS time, VALUENUM AS value_num, VALUE AS value_text, VALUEUOM AS unit
      FROM v_raw_chart WHERE coalesce(ERROR, 0) = 0 AND (VALUENUM IS NOT NULL OR VALUE IS NOT NULL)
        AND ICUSTAY_ID IN (SELECT stay_id FROM v_stays)""",
    "v_lab": """
      SELECT HADM_ID AS admission_id, SUBJECT_ID AS patient_id, ITEMID AS code, CHARTTIME AS time, VALUENUM AS value_num,
        VALUE AS value_text, VALUEUOM AS unit
      FROM v_raw_lab WHERE VALUENUM IS NOT NULL OR VALUE IS NOT NULL""",
    "v_output": """
      SELECT ICUSTAY_ID AS stay_id, ITEMID AS code, CHARTTIME AS time, VALUE AS value, VALUEUOM AS unit FROM v_raw_output
      WHERE VALUE IS NOT NULL AND ICUSTAY_ID IN (SELECT stay_id FROM v_stays)""",
    "v_cv": """
      SELECT ICUSTAY_ID AS stay_id, ITEMID AS code, CHARTTIME AS time, AMOUNT AS value, AMOUNTUOM AS unit FROM v_raw_cv
      WHERE ICUSTAY_ID IN (SELECT stay_id FROM v_stays)""",
    "v_mv": """
      SELECT ICUSTAY_ID AS stay_id, ITEMID AS code, STARTTIME AS time_start, ENDTIME AS time_end, AMOUNT AS value,
        AMOUNTUOM AS unit FROM v_raw_mv
      WHERE ICUSTAY_ID IN (SELECT stay_id FROM v_stays)""",
    "v_mv_hourly": hourly_sql("v_mv", "stay_id, code, unit"),
    "v_weight": """
      SELECT ICUSTAY_ID AS stay_id, 224639 AS code, STARTTIME AS time, PATIENTWEIGHT AS value, 'kg' AS unit FROM v_raw_mv
      WHERE PATIENTWEIGHT IS NOT NULL AND ICUSTAY_ID IN (SELECT stay_id FROM v_stays)""",
    "v_lab_stay": """
      SELECT l.*, s.stay_id FROM v_lab l JOIN v_stays s USING (admission_id)
      WHERE l.time BETWEEN s.time_start - INTERVAL 1 HOUR AND s.time_end + INTERVAL 1 HOUR""",
    # from assembled to clean
    "v_rules": rules_sql(),
    "v_texts": texts_sql(),
    "v_line_remove": rules_sql(LINE_REMOVE),
    "v_line_median": rules_sql(LINE_MEDIAN),
    "v_assembled": f"""
      SELECT * FROM (
        SELECT stay_id, code, epoch_us(time) AS time_us, value_num, value_text, unit, 'chartevents' AS source FROM v_chart
        UNION ALL SELECT stay_id, code, epoch_us(time), value_num, value_text, unit, 'labevents' FROM v_lab_stay
        UNION ALL SELECT stay_id, code, epoch_us(time), value, NULL, unit, 'outputevents' FROM v_output
        UNION ALL SELECT stay_id, code, epoch_us(time), value, NULL, unit, 'inputevents_cv' FROM ({convert_sql('v_cv')})
        UNION ALL SELECT stay_id, code, time_us, value, NULL, unit, 'inputevents_mv' FROM ({convert_sql('v_mv_hourly')})
        UNION ALL SELECT stay_id, code, epoch_us(time), value, NULL, unit, 'weight' FROM v_weight)
      WHERE code IN (SELECT code FROM v_rules)""",
    "v_selected": """
      SELECT * FROM (
        SELECT e.* EXCLUDE (value_num, value_text, raw, txt), r.* EXCLUDE (code, sel_kind, a, b, sel_unit), coalesce(CASE sel_kind
            WHEN 'linear' THEN raw * a + b
            WHEN 'percent' THEN CASE WHEN raw > 1 THEN raw / 100 ELSE raw END
            WHEN 'text_map' THEN x.num
            WHEN 'unit_scale' THEN CASE WHEN unit = sel_unit THEN raw / a ELSE raw END
            WHEN 'constant' THEN a END, raw) AS value
        FROM (SELECT *, coalesce(value_num, TRY_CAST(value_text AS DOUBLE)) AS raw,
                     CASE WHEN value_num IS NULL THEN value_text END AS txt FROM v_assembled) e
        JOIN v_rules r ON e.code = r.code LEFT JOIN v_texts x ON e.code = x.code AND e.txt = x.txt)
      WHERE value IS NOT NULL""",
    "v_clean": outliers_sql("v_selected"),
    "v_active": """
      SELECT * FROM v_stays WHERE stay_id IN (SELECT stay_id FROM v_clean GROUP BY 1 HAVING count(*) > 1)""",
    "v_full_timed": """
      SELECT *, CAST(round(((time_us - min(time_us) OVER (PARTITION BY stay_id)) // 1000000) / 60.0::DOUBLE) AS INTEGER) AS minute
      FROM v_clean WHERE stay_id IN (SELECT stay_id FROM v_active)""",
    "v_full_events": """
      SELECT stay_id, minute, variable, avg(value) AS value, array_to_string(list_sort(list(DISTINCT source)), ',') AS source,
        min(unit) AS unit FROM v_full_timed GROUP BY ALL""",
    "v_eligible": """
      SELECT s.*, a.died FROM v_active s JOIN v_admissions a USING (admission_id)
      WHERE epoch_us(time_end) - epoch_us(time_start) >= 86400000000
        AND (death_time IS NULL OR epoch_us(death_time) - epoch_us(time_start) >= 86400000000)
        AND stay_id IN (SELECT stay_id FROM v_full_events WHERE minute < 1440)""",
    "v_label_splits": f"""
      SELECT stay_id, died, CASE WHEN x < 0.64::DOUBLE THEN 'train' WHEN x < (0.64::DOUBLE + 0.2::DOUBLE) THEN 'test' ELSE 'val' END AS split
      FROM (SELECT *, {u(['patient_id'], "'split'")} AS x FROM v_eligible)""",
    "v_splits": """
      SELECT stay_id, split FROM v_label_splits WHERE split <> 'train'
      UNION ALL
      SELECT DISTINCT stay_id, 'train' FROM v_full_events
      WHERE stay_id NOT IN (SELECT stay_id FROM v_label_splits WHERE split <> 'train')""",
    "v_stay_labels": """
      SELECT DISTINCT stay_id, HOSPITAL_EXPIRE_FLAG = 1 AS died FROM v_point_events JOIN v_raw_admissions ON admission_id = HADM_ID""",
    "v_stay_traits": """
      SELECT DISTINCT stay_id, CAST(coalesce(2024 - year(DOB), 0) AS DOUBLE) AS age, CASE WHEN GENDER = 'M' THEN 0 ELSE 1 END AS gender
      FROM v_point_events JOIN v_raw_patients ON admission_id = SUBJECT_ID""",
    # predictions
    "v_predictions": """
      SELECT *, ln(score / (1 - score)) AS logit FROM (
        SELECT doc_id AS id, least(greatest(round(n_chars / 20000::DOUBLE, 2), 0.01::DOUBLE), 0.99::DOUBLE) AS score, toxic AS label
        FROM labels JOIN documents USING (doc_id))""",
    "v_thresholds": """
      SELECT *, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp,
        sum(pos) OVER () AS p, sum(neg) OVER () AS n
      FROM (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label <> 1) AS neg FROM v_predictions GROUP BY 1)""",
    # runs
    "v_run_facts": """
      SELECT user_id, event_type, count(*) AS n, max(k) % 10 + 1 AS k,
        CAST(sum(CAST(round(value * 100) AS BIGINT)) * 10 // count(*) AS DOUBLE) / 1000000 AS m
      FROM v_ev GROUP BY 1, 2""",
    "v_runs": """
      SELECT user_id || '-' || event_type AS run_id, event_type AS run_name, user_id, n,
        CASE WHEN n % 7 = 0 THEN 'failed' ELSE 'finished' END AS state,
        CASE WHEN user_id % 4 = 0 THEN 'pretrain' ELSE 'finetune' END AS stage,
        CASE WHEN user_id % 2 = 0 THEN 'z' ELSE 'ecdf' END AS kind,
        CASE user_id % 3 WHEN 0 THEN 'noisy_gaussian_p1.0_m1.0' WHEN 1 THEN 'noisy_uniform_p0.5' ELSE 'original' END AS data,
        CASE user_id % 3 WHEN 0 THEN 'gaussian' WHEN 1 THEN 'uniform' ELSE 'none' END AS noise_type,
        CAST(16 * (1 + user_id % 3) AS INTEGER) AS batch_size, k / 10.0::DOUBLE AS data_fraction,
        CAST(n AS DOUBLE) AS training_time, CAST(n + 5 - CASE WHEN n % 2 = 0 THEN n % 4 ELSE 0 END AS INTEGER) AS epoch,
        m AS test_auroc, m / 2 AS test_pr_auc, CASE WHEN user_id % 5 <> 0 THEN m / 4 END AS test_minrp
      FROM v_run_facts""",
    "v_flat": """
      SELECT run_id, 'Model ' || run_name AS name, stage, kind, data, noise_type, batch_size, data_fraction, training_time, epoch,
        test_auroc, test_pr_auc, test_minrp, user_id
      FROM v_runs WHERE state = 'finished' AND user_id % 11 <> 0""",
}
