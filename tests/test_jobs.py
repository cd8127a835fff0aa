import pandas as pd
import pytest

from pulseframe.plans import jobs
from test_sources import RAW


@pytest.fixture(scope="module")
def folder(spark, tables, tmp_path_factory):
    base = tmp_path_factory.mktemp("jobs")
    for name in RAW:
        tables.raw.table(name).write.parquet(f"{base}/raw/{name}.parquet")
    tables.rules.write.parquet(f"{base}/rules.parquet")
    return base


def test_dataset_and_statistics(spark, folder):
    common = ["--raw", f"{folder}/raw", "--rules", f"{folder}/rules.parquet"]
    args = jobs.parse(["dataset", *common, "--output", f"{folder}/out", "--noise-p", "0.5", "--noise-type", "shuffle"])
    paths = args.run(spark, args)
    assert set(paths) == {"labels", "demographics", "events"}
    args = jobs.parse(["statistics", *common, "--dataset", f"{folder}/out", "--output", f"{folder}/stats"])
    args.run(spark, args)
    read = lambda name: pd.concat(pd.read_csv(f) for f in (folder / "stats" / name).glob("*.csv"))
    events = spark.read.parquet(paths["events"])
    variables = read("variables")
    assert variables["count"].sum() == events.count() and variables["count"].is_monotonic_decreasing
    table = read("splits_table").set_index("split")["num_events"]
    training = read("training").set_index("statistic")["value"]
    assert training["UnsupervisedTrainLengthEvents"] == table["unsupervised_train"]
    assert read("raw_dataset")["file"].tolist().count("Total") == 1


def test_ingest(spark, tables, tmp_path):
    tables.table("nation").write.option("header", True).option("compression", "gzip").csv(str(tmp_path / "nation"))
    args = jobs.parse(["ingest", "--source", f"{tmp_path}/nation/*.csv.gz", "--target", f"{tmp_path}/nation.parquet",
                       "--schema", "n_nationkey int, n_name string, n_regionkey int"])
    assert args.run(spark, args).exceptAll(tables.table("nation")).count() == 0
