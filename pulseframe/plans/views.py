"""The test tables seen as raw clinical-style tables and as clean events.

``oracle_views`` states the same mapping in SQL.
"""

from __future__ import annotations

import functools
import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from pulseframe.functions.clock import shift_seconds
from pulseframe.operators import cohort, events as ev
from pulseframe.session import settle
from pulseframe.sources.readers import WEIGHT_CODE, RawData
from pulseframe.sources.rules import rules_table

TYPES = ("click", "error", "purchase", "signup", "view")
EPOCH = 1_704_067_200  # 2024-01-01, a Monday
WEEK = 604_800

READING_TEXT = {"calm": 0.0, "steady": 0.0, "restless": 1.0}
TUBE_TEXT = {"device on": 1.0, "device off": 0.0}
INPUT_RULE = {"lo": 0.0, "hi": 50.0, "units": ["mg", "ml"], "action": "replace_with_median"}
SIGNUP_RULE = {"lo": 0.0, "hi": 60.0, "units": ["mcg", "ml"], "action": "replace_with_median"}
CLICK_RULE = {"lo": 0.0, "hi": 150.0, "action": "remove"}

# Code = 100 x source + 10 x event type + parity: every selector, validity test and action occurs.
RULES = (
    {"variable": "click", "codes": [110, 210, 211], **CLICK_RULE},
    {"variable": "click", "codes": [111], "sel_kind": "linear", "a": 5.0 / 9.0, "b": -160.0 / 9.0, **CLICK_RULE},
    {"variable": "error", "codes": [120, 121], "sel_kind": "percent", "lo": 0.2, "hi": 1.0, "action": "remove"},
    {"variable": "purchase", "codes": [130, 131], "sel_kind": "text_map", "text_map": READING_TEXT, "categorical": True},
    {"variable": "signup", "codes": [140, 141], "sel_kind": "unit_scale", "a": 1000.0, "sel_unit": "ml", **SIGNUP_RULE},
    {"variable": "signup", "codes": [240, 241], **SIGNUP_RULE},
    {"variable": "view", "codes": [150]},
    {"variable": "view_flag", "codes": [151], "sel_kind": "constant", "a": 1.0},
    {"variable": "lab_error", "codes": [220, 221], "lo": 1.0, "hi": 100.0, "action": "replace_with_median"},
    {"variable": "intubated", "codes": [230, 231], "sel_kind": "text_map", "text_map": TUBE_TEXT, "categorical": True},
    {"variable": "lab_view", "codes": [250, 251], "lo": 0.0, "hi": 80.0, "units": ["L"], "unit_waiver": True,
     "action": "replace_with_median"},
    *[{"variable": f"out_{n}", "codes": [310 + 10 * i], "lo": 0.0, "hi": 100.0, "action": "replace_with_median"}
      for i, n in enumerate(TYPES)],
    *[{"variable": f"in_{n}", "codes": [410 + 10 * i, 510 + 10 * i], **INPUT_RULE} for i, n in enumerate(TYPES[:4])],
    {"variable": "Weight", "codes": [WEIGHT_CODE], "lo": 0.0, "hi": 120.0, "action": "remove"},
)



def _once(method):
    return functools.cached_property(method)


# Rules over the variables of ``lineitem``; the codes are arbitrary.
LINE_REMOVE = tuple({"variable": v, "codes": [i], "lo": 5_000.0 * i, "hi": 90_000.0 - 5_000.0 * i, "action": "remove"}
                    for i, v in enumerate(("AF", "AO", "NF", "NO", "RF")))
LINE_MEDIAN = (
    {"variable": "AF", "codes": [1], "lo": 10_000.0, "hi": 60_000.0, "action": "replace_with_median"},
    {"variable": "AO", "codes": [2], "lo": 0.0, "hi": 50_000.0, "units": ["mcg", "mg"], "action": "replace_with_median"},
    {"variable": "NF", "codes": [3], "lo": 0.0, "hi": 50_000.0, "units": ["dose"], "unit_waiver": True,
     "action": "replace_with_median"},
    {"variable": "NO", "codes": [4], "lo": 20_000.0, "hi": 70_000.0, "units": ["dose", "L"], "unit_waiver": True,
     "action": "replace_with_median"},
    {"variable": "RF", "codes": [5]},
    {"variable": "RO", "codes": [6], "lo": 15_000.0, "hi": 95_000.0, "action": "remove"},
)


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.raw = RawData(lambda name: getattr(self, f"raw_{name.lower()}"))

    def path(self, name: str) -> str:
        return os.path.join(self.sf_dir, f"{name}.parquet")

    def table(self, name: str) -> DataFrame:
        """A driver table; its zone-less timestamps are UTC."""
        df = self.spark.read.parquet(self.path(name))
        return df.select(*[F.col(c).cast("timestamp").alias(c) if t == "timestamp_ntz" else F.col(c) for c, t in df.dtypes])

    # --- events as readings -------------------------------------------------------------------
    @_once
    def ev(self) -> DataFrame:
        """Events with k (from props), week w, type number t, and stay = user and week."""
        k = F.get_json_object("props", "$.k").cast("int")
        number = F.array_position(F.array(*[F.lit(n) for n in TYPES]), F.col("event_type")).cast("int")
        week = F.floor((F.unix_seconds("ts") - EPOCH) / WEEK)
        return self.table("events").select(
            "event_id", "ts", "user_id", "event_type", "value", k.alias("k"), week.alias("w"), number.alias("t"),
            (F.col("user_id") * 1000 + week).alias("stay"),
        )

    @_once
    def _charted(self) -> DataFrame:
        """``ev``, stored: the raw event tables and the stays are all made from it."""
        return settle(self.ev)

    @_once
    def point_events(self) -> DataFrame:
        """One clean event per row of ``events``: variable = type, source by parity, unit by thirds."""
        k = F.col("k")
        return self.ev.select(
            "event_id", F.col("stay").alias("stay_id"), F.col("user_id").alias("admission_id"),
            F.col("event_type").alias("variable"), F.col("ts").alias("time"), "value", self._unit().alias("unit"),
            F.concat(F.lit("s"), (k % 2).cast("string")).alias("source"),
        )

    @staticmethod
    def _unit():
        k = F.col("k")
        return F.when(k % 3 == 0, "mcg").when(k % 3 == 1, "L").otherwise("ml")

    @_once
    def processed(self) -> DataFrame:
        """Long table (stay_id, minute, variable, value, source, unit) made by the library, stored once."""
        stays = self.point_events.select("stay_id").distinct()
        return settle(ev.throttle_events(ev.relative_minutes(self.point_events, stays)))

    @_once
    def lines(self) -> DataFrame:
        """``lineitem`` as events: stay = order, variable = flags, value = price."""
        return self.table("lineitem").select(
            F.col("l_orderkey").alias("stay_id"), "l_linenumber", "l_partkey", "l_suppkey",
            (F.col("l_linenumber") * 300 + F.col("l_partkey") % 300).cast("int").alias("minute"),
            F.concat("l_returnflag", "l_linestatus").alias("variable"),
            F.col("l_extendedprice").alias("value"),
            F.when(F.col("l_returnflag") == "A", "mcg").when(F.col("l_returnflag") == "N", "L").otherwise("ml").alias("unit"),
            F.concat(F.lit("s"), (F.col("l_suppkey") % 3).cast("string")).alias("source"),
        )

    @_once
    def line_intervals(self) -> DataFrame:
        """``lineitem`` as intervals of quantity x 7 minutes ending at the ship date plus the line's minutes."""
        l = self.table("lineitem")
        end = shift_seconds(F.col("l_shipdate"), F.col("l_partkey") % 1440 * 60)
        seconds = (F.col("l_quantity") * 420).cast("bigint") - F.when(F.col("l_linenumber") == 7, 9_000).otherwise(F.col("l_suppkey") % 60)
        return l.select(
            F.col("l_orderkey").alias("stay_id"), F.col("l_partkey").alias("code"),
            shift_seconds(end, -seconds).alias("time_start"), end.alias("time_end"),
            F.col("l_extendedprice").alias("value"),
            F.when(F.col("l_returnflag") == "A", "mcg").when(F.col("l_returnflag") == "N", "L").otherwise("ml").alias("unit"),
        )

    # --- orders as stays ----------------------------------------------------------------------
    @_once
    def order_stays(self) -> DataFrame:
        o = self.table("orders")
        return o.select(
            F.col("o_orderkey").alias("stay_id"), F.col("o_custkey").alias("patient_id"),
            F.col("o_orderkey").alias("admission_id"), F.col("o_orderdate").alias("time_start"),
            shift_seconds(F.col("o_orderdate"), F.col("o_orderkey") % 72 * 3600).alias("time_end"),
        )

    @_once
    def order_admissions(self) -> DataFrame:
        died = F.col("o_orderstatus") == "F"
        return self.table("orders").select(
            F.col("o_orderkey").alias("admission_id"), F.col("o_custkey").alias("patient_id"), died.alias("died"),
            F.when(died, shift_seconds(F.col("o_orderdate"), F.col("o_custkey") % 48 * 3600)).alias("death_time"),
        )

    @_once
    def order_adults(self) -> DataFrame:
        """Order stays with the age of the customer."""
        born = self.raw_patients.select(F.col("SUBJECT_ID").alias("patient_id"), "DOB")
        age = F.coalesce(F.year("time_start") - F.year("DOB"), F.lit(0)).alias("age")
        return self.order_stays.join(born, "patient_id", "left").select(*self.order_stays.columns, age)

    @_once
    def order_cohort(self) -> DataFrame:
        return cohort.eligible_cohort(self.order_stays, self.lines, self.order_admissions)

    # --- raw tables ---------------------------------------------------------------------------
    @_once
    def raw_patients(self) -> DataFrame:
        key, segment = F.col("c_custkey"), F.col("c_mktsegment")
        year = F.when(key % 17 == 0, F.lit(None)).when(key % 10 == 3, 1700).otherwise(1930 + key % 90)
        gender = (F.when(segment == "AUTOMOBILE", "M")
                  .when((segment == "MACHINERY") & (F.col("c_nationkey") > 0), "M")
                  .when(segment != "MACHINERY", "F"))
        born = F.make_timestamp(year.cast("int"), F.lit(6), F.lit(15), F.lit(0), F.lit(0), F.lit(0).cast("decimal(16,6)"))
        return self.table("customer").select(key.alias("SUBJECT_ID"), born.alias("DOB"), gender.alias("GENDER"))

    @_once
    def raw_icustays(self) -> DataFrame:
        start = F.timestamp_seconds(F.col("w") * WEEK + EPOCH + 86_400)
        hours = 12 + (F.col("user_id") * 7 + F.col("w") * 13) % 108
        end = F.when((F.col("user_id") + F.col("w")) % 29 != 0, shift_seconds(start, hours * 3600))
        return self._charted.select("user_id", "w", "stay").distinct().select(
            F.col("stay").alias("ICUSTAY_ID"), F.col("user_id").alias("SUBJECT_ID"), F.col("user_id").alias("HADM_ID"),
            start.alias("INTIME"), end.alias("OUTTIME"),
        )

    @_once
    def raw_admissions(self) -> DataFrame:
        flag = (F.col("c_nationkey") % 4 == 0).cast("int")
        return self.table("customer").select(
            F.col("c_custkey").alias("HADM_ID"), F.col("c_custkey").alias("SUBJECT_ID"),
            flag.alias("HOSPITAL_EXPIRE_FLAG"),
            F.when(flag == 1, F.timestamp_seconds(F.lit(EPOCH) + F.col("c_custkey") * 5 % 720 * 3600)).alias("DEATHTIME"),
        )

    @_once
    def raw_d_items(self) -> DataFrame:
        return self.table("part").select(
            F.col("p_partkey").alias("ITEMID"), F.when(F.col("p_size") != 13, F.col("p_name")).alias("LABEL")
        )

    @_once
    def raw_d_labitems(self) -> DataFrame:
        return self.table("supplier").select(
            (F.col("s_suppkey") + 1_000_000).alias("ITEMID"), F.col("s_name").alias("LABEL"), F.lit("Blood").alias("FLUID")
        )

    def _keys(self):
        return F.col("stay").alias("ICUSTAY_ID"), F.col("user_id").alias("SUBJECT_ID"), F.col("ts").alias("CHARTTIME")

    def _code(self, base: int, parity: bool = False):
        code = base + 10 * F.col("t")
        return (code + F.col("k") % 2 if parity else code).cast("bigint").alias("ITEMID")

    @_once
    def raw_chartevents(self) -> DataFrame:
        k = F.col("k")
        text = (F.when(k % 20 == 9, "calm").when(k % 20 == 19, "restless")
                .when(k % 10 == 7, k.cast("string")))
        return self._charted.select(
            *self._keys(), self._code(100, True), F.when(k % 10 < 7, F.col("value")).alias("VALUENUM"),
            text.alias("VALUE"), self._unit().alias("VALUEUOM"),
            F.when(k % 7 == 0, 1).when(k % 7 != 1, 0).alias("ERROR"),
        )

    @_once
    def raw_labevents(self) -> DataFrame:
        k = F.col("k")
        return self._charted.select(
            F.col("user_id").alias("HADM_ID"), F.col("user_id").alias("SUBJECT_ID"), F.col("ts").alias("CHARTTIME"),
            self._code(200, True), F.when(k % 10 < 8, F.col("value")).alias("VALUENUM"),
            F.when(k % 20 == 9, "device on").when(k % 20 == 19, "device off").alias("VALUE"),
            self._unit().alias("VALUEUOM"),
        )

    @_once
    def raw_outputevents(self) -> DataFrame:
        return self._charted.select(
            *self._keys(), self._code(300), F.when(F.col("k") % 13 != 0, F.col("value")).alias("VALUE"),
            F.lit("ml").alias("VALUEUOM"),
        )

    @_once
    def raw_inputevents_cv(self) -> DataFrame:
        unit = F.when(F.col("k") % 5 != 0, self._unit())
        return self._charted.select(*self._keys(), self._code(400), F.col("value").alias("AMOUNT"), unit.alias("AMOUNTUOM"))

    @_once
    def raw_inputevents_mv(self) -> DataFrame:
        k = F.col("k")
        seconds = k * 420 - 600 + F.when(k % 4 == 1, 170).otherwise(0)
        return self._charted.select(
            F.col("stay").alias("ICUSTAY_ID"), F.col("user_id").alias("SUBJECT_ID"),
            shift_seconds(F.col("ts"), -seconds).alias("STARTTIME"), F.col("ts").alias("ENDTIME"), self._code(500),
            F.col("value").alias("AMOUNT"), self._unit().alias("AMOUNTUOM"),
            F.when(k % 3 == 0, (k + 40).cast("double")).alias("PATIENTWEIGHT"),
        )

    @_once
    def rules(self) -> DataFrame:
        return rules_table(self.spark, RULES)

    # --- labels and traits of the user-week stays ------------------------------------------------
    @_once
    def stay_labels(self) -> DataFrame:
        outcome = self.raw_admissions.select(
            F.col("HADM_ID").alias("admission_id"), (F.col("HOSPITAL_EXPIRE_FLAG") == 1).alias("died")
        )
        stays = self.point_events.select("stay_id", "admission_id").distinct()
        return stays.join(outcome, "admission_id").select("stay_id", "died")

    @_once
    def stay_traits(self) -> DataFrame:
        age = F.coalesce(2024 - F.year("DOB"), F.lit(0)).cast("double").alias("age")
        people = self.raw_patients.select(
            F.col("SUBJECT_ID").alias("admission_id"), age, F.when(F.col("GENDER") == "M", 0).otherwise(1).alias("gender")
        )
        stays = self.point_events.select("stay_id", "admission_id").distinct()
        return stays.join(people, "admission_id").select("stay_id", "age", "gender")

    # --- predictions and runs -----------------------------------------------------------------
    @_once
    def predictions(self) -> DataFrame:
        """Toxicity labels with a score from the text length: many ties, all within 0.01..0.99."""
        # Rounded as its SQL does it: the double times 100 to a whole number, not its decimal digits (2,900 gives 0.14, not 0.15).
        hundredths = F.round(F.col("n_chars") / F.lit(20_000.0) * F.lit(100.0)) / F.lit(100.0)
        score = F.least(F.greatest(hundredths, F.lit(0.01)), F.lit(0.99))
        joined = self.table("labels").join(self.table("documents").select("doc_id", "n_chars"), "doc_id")
        return joined.select(
            F.col("doc_id").alias("id"), score.alias("score"), F.log(score / (1 - score)).alias("logit"),
            F.col("toxic").alias("label"),
        )

    @_once
    def runs(self) -> DataFrame:
        """One run per user and event type; its settings are JSON texts."""
        n, u = F.col("n"), F.col("user_id")
        scaler = F.when(u % 2 == 0, "VariableStandardScaler").otherwise("VariableECDFScaler")
        folder = (F.when(u % 3 == 0, "noisy_gaussian_p1.0_m1.0").when(u % 3 == 1, "noisy_uniform_p0.5")
                  .otherwise("original"))
        stop = F.when(n % 2 == 0, F.struct((n % 4).cast("int").alias("patience")))
        loader = F.struct(F.struct(scaler.alias("scaler_class"), F.concat(F.lit("data/"), folder, F.lit("/train")).alias("path")).alias("dataset"),
                          F.struct((16 * (1 + u % 3)).cast("int").alias("batch_size")).alias("loader"))
        config = F.struct((F.col("k") / 10.0).alias("data_fraction"), F.struct(loader.alias("train")).alias("data_config"),
                          stop.alias("early_stop_callback"))
        summary = F.struct((n * 60).alias("_runtime"), (n + 5).cast("int").alias("epoch"),
                           F.col("m").alias("test_auroc"), (F.col("m") / 2).alias("test_pr_auc"),
                           F.when(u % 5 != 0, F.col("m") / 4).alias("test_minrp"))
        grouped = self.ev.groupBy("user_id", "event_type").agg(
            F.count(F.lit(1)).alias("n"), (F.max("k") % 10 + 1).alias("k"),
            (F.floor(F.sum(F.round(F.col("value") * 100).cast("bigint")) * 10 / F.count(F.lit(1))) / 1_000_000).alias("m"),
        )
        tags = F.when(u % 11 == 0, F.array(F.lit("archive"))).otherwise(F.array(F.lit("kept")))
        return grouped.select(
            F.concat(u.cast("string"), F.lit("-"), F.col("event_type")).alias("run_id"),
            F.col("event_type").alias("name"),
            F.when(n % 7 == 0, "failed").otherwise("finished").alias("state"),
            F.when(u % 4 == 0, "pretrain").otherwise("finetune").alias("stage"),
            tags.alias("tags"), F.to_json(config).alias("config"), F.to_json(summary).alias("summary"),
        )
