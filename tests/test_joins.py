import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulseframe.operators.joins import attach, interval_join


@pytest.fixture
def hot(spark):
    """Half of the rows share one key."""
    return spark.range(2000).select("id", F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("id") % 50).alias("key"))


@pytest.mark.parametrize("how", ["inner", "left", "left_semi"])
def test_attach_beyond_its_bound_gives_the_same(spark, hot, how):
    dim = spark.range(30).select(F.col("id").alias("key"), (F.col("id") * 10).alias("x"))
    small, large = attach(hot, dim, "key", how), attach(hot, dim, "key", how, max_rows=0)
    plan = large._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in small._jdf.queryExecution().optimizedPlan().toString() and "strategy=broadcast" not in plan
    assert small.exceptAll(large).count() == 0 and small.count() == large.count() > 0


@pytest.mark.parametrize("cell", [1, 7, 100, 10_000])
def test_interval_join(spark, cell):
    rng = np.random.default_rng(9)
    points = pd.DataFrame({"k": rng.integers(0, 3, 300), "p": rng.integers(-200, 200, 300), "i": range(300)})
    low = rng.integers(-200, 200, 80)
    spans = pd.DataFrame({"k": rng.integers(0, 3, 80), "lo": low, "hi": low + rng.integers(-5, 120, 80), "j": range(80)})
    got = interval_join(spark.createDataFrame(points), spark.createDataFrame(spans), ["k"], F.col("p"), F.col("lo"), F.col("hi"), cell)
    pairs = points.merge(spans, on="k")
    pairs = pairs[(pairs["lo"] <= pairs["p"]) & (pairs["p"] <= pairs["hi"])]
    assert sorted((r.i, r.j) for r in got.collect()) == sorted(zip(pairs["i"], pairs["j"]))


def test_wide_rows_are_not_broadcast(spark, hot, monkeypatch):
    from pulseframe.operators import joins

    monkeypatch.setattr(joins, "BROADCAST_BYTES", 10_000)
    dim = spark.range(30).select(F.col("id").alias("key"), F.repeat(F.lit("x"), 1_000).alias("text"))
    plan = attach(hot, dim, "key")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" not in plan
