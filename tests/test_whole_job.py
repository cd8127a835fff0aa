"""Results over all rows, where a sample would show."""

import statistics

import numpy as np
import pandas as pd
import pytest

from pulseframe.operators import stats
from pulseframe.plans import jobs
from test_jobs import folder  # noqa: F401


def plain_distance(values):
    v = np.sort(values)
    z = (v - v.mean()) / v.std(ddof=1)
    q = np.array([statistics.NormalDist().inv_cdf((i + 0.5) / len(v)) for i in range(len(v))])
    return np.abs(z - q).mean()


def test_statistics_job_takes_all_events(spark, folder, monkeypatch, tmp_path):  # noqa: F811
    common = ["--raw", f"{folder}/raw", "--rules", f"{folder}/rules.parquet"]
    args = jobs.parse(["dataset", *common, "--output", f"{tmp_path}/out"])
    paths = args.run(spark, args)
    taken = []
    whole = stats.normality_distance
    monkeypatch.setattr(stats, "normality_distance", lambda df: taken.append(df.count()) or whole(df))
    events = spark.read.parquet(paths["events"])
    most = events.groupBy("variable").count().agg({"count": "max"}).first()[0]
    # Repeated until the largest variable is beyond any sample of 5,000.
    copies = 6_000 // most + 1
    read = jobs.io.read_split

    def larger(session, path):
        df = read(session, path)
        return df.crossJoin(session.range(copies).select()) if path.endswith("events.parquet") else df

    monkeypatch.setattr(jobs.io, "read_split", larger)
    args = jobs.parse(["statistics", *common, "--dataset", f"{tmp_path}/out", "--output", f"{tmp_path}/stats"])
    args.run(spark, args)
    assert taken == [events.count() * copies]


def test_normality_distance_of_many_equal_values(spark):
    values = np.concatenate([np.repeat([1.0, 2.0, 4.0], [9_000, stats.PLACES, stats.PLACES + 1]), np.arange(500) / 100])
    df = spark.createDataFrame(pd.DataFrame({"variable": "v", "value": values}))
    assert stats.normality_distance(df).first().wasserstein_distance == pytest.approx(plain_distance(values))
