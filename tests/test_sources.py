import os

import pytest
from pyspark.sql import functions as F

from test_clean import INVENTED

from pulseframe.operators import cohort
from pulseframe.plans import dataset
from pulseframe.sources import io
from pulseframe.sources.readers import RawData
from pulseframe.sources.rules import load_rules, rules_table

RAW = ("PATIENTS ICUSTAYS ADMISSIONS D_ITEMS D_LABITEMS OUTPUTEVENTS CHARTEVENTS LABEVENTS INPUTEVENTS_MV INPUTEVENTS_CV").split()


@pytest.fixture(scope="module")
def raw(spark, tables, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("raw"))
    for name in RAW:
        tables.raw.table(name).write.parquet(f"{folder}/{name}.parquet")
    return RawData.at(spark, folder)


@pytest.mark.parametrize("reader, columns", [
    ("patients", ["patient_id", "dob", "gender"]),
    ("adult_stays", ["stay_id", "patient_id", "admission_id", "time_start", "time_end", "age"]),
    ("admissions", ["patient_id", "admission_id", "death_time", "died"]),
    ("items", ["code", "name"]),
    ("point_events", ["stay_id", "patient_id", "code", "time", "value", "unit"]),
    ("charted", ["stay_id", "patient_id", "code", "time", "value_num", "value_text", "unit"]),
    ("lab", ["patient_id", "admission_id", "code", "time", "value_num", "value_text", "unit"]),
    ("interval_events", ["stay_id", "patient_id", "code", "time_start", "time_end", "value", "unit"]),
    ("point_inputs", ["stay_id", "patient_id", "code", "time", "value", "unit"]),
    ("derived_weight", ["stay_id", "patient_id", "code", "time", "value", "unit"]),
])
def test_readers(raw, reader, columns):
    df = getattr(raw, reader)()
    assert df.columns == columns and df.count() > 0


def test_reader_types(raw):
    types = dict(raw.charted().dtypes)
    assert types["value_num"] == "double" and types["value_text"] == "string"
    assert dict(raw.admissions().dtypes)["died"] == "boolean"
    assert raw.adult_stays().agg(F.min("age")).first()[0] >= 18


def test_splits_are_disjoint_and_complete(spark, raw, tables):
    built = dataset.build_dataset(raw, tables.rules)
    sides = built.splits.groupBy("stay_id").agg(F.count_distinct("split").alias("n"))
    assert sides.filter("n > 1").count() == 0
    assert built.events.join(built.splits, "stay_id", "left_anti").count() == 0
    people = built.label_splits.join(raw.adult_stays(), "stay_id").groupBy("patient_id").agg(F.count_distinct("split").alias("n"))
    assert people.filter("n > 1").count() == 0


def test_noisy_dataset(raw, tables):
    options = {"kind": "uniform", "p": 1.0, "key_cols": ["stay_id", "code", "source"]}
    built = dataset.build_dataset(raw, tables.rules, leave_outliers=True, noise_options=options)
    plain = dataset.build_dataset(raw, tables.rules, leave_outliers=True)
    assert built.events.count() == plain.events.count() > 0
    assert built.events.select("value").exceptAll(plain.events.select("value")).count() > 0


def test_write_splits(spark, raw, tables, tmp_path):
    built = dataset.build_dataset(raw, tables.rules)
    paths = io.write_splits(built.labels, built.demographics, built.events, built.label_splits, built.splits, str(tmp_path / "out"))
    total = sum(io.read_split(spark, paths["events"], s).count() for s in cohort.FRACTIONS)
    assert total == built.events.count()
    assert io.read_split(spark, paths["labels"]).count() == built.labels.count()


def test_fractions_must_sum_to_one(tables):
    with pytest.raises(ValueError):
        cohort.split_by_entity(tables.order_stays, fractions={"train": 0.5, "test": 0.4})


def test_csv_gz(spark, tables, tmp_path):
    orders = tables.table("orders")
    folder = io.write_csv(orders, str(tmp_path / "csv"), "gzip")
    assert any(f.endswith(".csv.gz") for f in os.listdir(folder))
    typed = io.csv_to_parquet(spark, f"{folder}/*.csv.gz", str(tmp_path / "typed"), orders.schema)
    assert typed.exceptAll(orders).count() == 0 and typed.count() == orders.count()
    inferred = io.csv_to_parquet(spark, f"{folder}/*.csv.gz", str(tmp_path / "inferred"))
    assert dict(inferred.dtypes)["o_totalprice"] == "double"


def test_materialize(spark, tmp_path):
    path = str(tmp_path / "stored")
    first = spark.range(5).withColumn("tags", F.array(F.lit("a")))
    stored = io.materialize(first, path)
    assert io.same_schema(stored.schema, first.schema) and not stored.schema["id"].nullable
    assert io.materialize(spark.range(9).withColumn("tags", F.array(F.lit("a"))), path).count() == 5  # reused
    assert io.materialize(spark.range(9), path).count() == 9  # another schema: written anew


def test_table_key(spark, tmp_path):
    file = tmp_path / "input.txt"
    file.write_text("x")
    key = io.table_key(spark, "t", {"p": 1}, [str(tmp_path)])
    assert key == io.table_key(spark, "t", {"p": 1}, [str(tmp_path)]) != io.table_key(spark, "t", {"p": 2}, [str(tmp_path)])
    file.write_text("longer")
    assert key != io.table_key(spark, "t", {"p": 1}, [str(tmp_path)])


def test_input_state_follows_every_file(spark, tmp_path):
    folder = str(tmp_path / "parts")
    spark.range(40).withColumn("k", F.col("id") % 4).repartition(3).write.partitionBy("k").parquet(folder)
    (_, files, size, *digest), = io.input_state(spark, [folder])
    data = [os.path.join(d, f) for d, _, names in os.walk(folder) for f in names if f.endswith(".parquet")]
    assert files == len(data) and size == sum(map(os.path.getsize, data)) and len(digest) == 2
    assert io.input_state(spark, [folder]) == io.input_state(spark, [folder])
    before = io.table_key(spark, "t", {}, [folder])
    os.utime(data[0], (1, 1))  # written anew, as long as before
    assert io.table_key(spark, "t", {}, [folder]) != before
    empty = tmp_path / "empty"
    empty.mkdir()
    assert io.input_state(spark, [str(empty)]) == [(str(empty), 0, None, None, None)]


def test_inventory(spark, tables):
    got = {r.file: r for r in io.file_inventory(spark, {n: tables.path(n) for n in ("orders", "events")}).collect()}
    assert got["orders"]["rows"] == 1500 and got["Total"]["rows"] == 2500
    size = os.path.getsize(tables.path("orders")) / 2**20
    assert got["orders"].size_mb == pytest.approx(size)


def test_sample(tables):
    labels, events, demo = io.sample_dataset(tables.stay_labels, tables.processed, tables.stay_traits, 0.3)
    ids = {r.stay_id for r in labels.collect()}
    assert ids and {r.stay_id for r in events.select("stay_id").collect()} == ids == {r.stay_id for r in demo.collect()}


def test_rules_round_trip(spark, tmp_path):
    rules = rules_table(spark, INVENTED)
    rules.write.parquet(str(tmp_path / "rules.parquet"))
    rules.write.json(str(tmp_path / "rules.json"))
    for name in ("rules.parquet", "rules.json"):
        back = load_rules(spark, str(tmp_path / name))
        assert back.columns == rules.columns and back.count() == rules.count()


KINDS = """
  SELECT id, DATE'2020-01-02' + CAST(id AS INT) AS day, TIMESTAMP'2020-01-02 03:04:05' AS at, X'00FF' AS raw, id = 1 AS flag,
    CAST(id AS DECIMAL(38, 18)) AS amount, 'a' AS name, named_struct('d', DATE'2020-01-01', 'n', named_struct('x', id, 'y', CAST(NULL AS INT))) AS pair,
    array(id, 2L) AS list, map('k', id) AS kv, if(id = 1, NULL, named_struct('z', id)) AS maybe, TIMESTAMP_NTZ'2020-01-01 00:00:00' AS local,
    INTERVAL '1' DAY AS wait, CAST(NULL AS DATE) AS nothing FROM range(3)"""


def test_materialize_keeps_every_type(spark, tmp_path):
    path = str(tmp_path / "kinds")
    kinds = spark.sql(KINDS)
    assert {"day", "raw", "pair", "list"} <= {f.name for f in kinds.schema if not f.nullable}
    stored = io.materialize(kinds, path)
    assert {f.name for f in stored.schema if not f.nullable} == {f.name for f in kinds.schema if not f.nullable} - {"wait"}
    assert [f.dataType for f in stored.schema] == [f.dataType for f in kinds.schema]
    assert sorted(stored.collect()) == sorted(kinds.collect())
    files = stored.inputFiles()
    assert io.materialize(kinds, path).inputFiles() == files  # reused, not written anew


def test_interrupted_write_is_no_stored_table(spark, tmp_path):
    path = str(tmp_path / "broken")
    breaks = spark.range(4).select("id", F.when(F.col("id") < 3, F.col("id")).otherwise(F.raise_error(F.lit("lost")).cast("bigint")).alias("v"))
    with pytest.raises(Exception, match="lost"):
        io.materialize(breaks, path)
    with pytest.raises(FileNotFoundError):
        io.read_stored(spark, path)
    whole = spark.range(4).select("id", F.when(F.col("id") < 9, F.col("id")).alias("v"))
    assert io.materialize(whole, path).count() == 4  # the same schema: nothing of the broken write is used
    other = breaks.withColumn("w", F.lit(1))
    with pytest.raises(Exception, match="lost"):
        io.materialize(other, path)
    assert io.read_stored(spark, path).count() == 4  # the earlier table is still the stored one
    spark.range(2).write.parquet(f"{path}/rows-of-a-lost-driver")  # whole rows, but no manifest names them
    assert io.read_stored(spark, path).count() == 4
    io.materialize(spark.range(7), path)
    assert io.read_stored(spark, path).count() == 7
    assert len([f for f in os.listdir(path) if f.startswith("rows-")]) == 4  # two broken ones, the lost one, the stored one
