"""Rank correlation in ranges and passes, and what it leaves on the disk."""

import glob
import time

import numpy as np
import pandas as pd
import pytest

from pulseframe.operators import correlation


def readings(rows=400):
    rng = np.random.default_rng(17)
    wide = pd.DataFrame({"tied": rng.integers(0, 6, rows), "wide": rng.normal(size=rows), "still": np.full(rows, 3.0)}).astype(float)
    wide["mostly"] = np.where(rng.random(rows) < 0.7, 0.0, wide["wide"] + rng.normal(size=rows))  # one value in most rows
    wide["ends"] = np.where(rng.random(rows) < 0.5, -9.0, np.where(rng.random(rows) < 0.5, 9.0, wide["tied"]))
    wide["few"] = np.where(np.arange(rows) < 20, wide["wide"], np.nan)
    for name, gone in (("tied", 0.3), ("mostly", 0.1), ("ends", 0.5)):
        wide.loc[rng.random(rows) < gone, name] = np.nan
    return wide


@pytest.mark.parametrize("range_rows, pass_points", [(1 << 22, 1 << 25), (1 << 22, 300), (150, 1 << 25), (11, 300)])
def test_ranges_and_passes_rank_alike(many_ranges, range_rows, pass_points):
    wide = readings()
    long = wide.rename_axis("day").reset_index().melt("day", var_name="variable").dropna().assign(stay_id=1)
    got = correlation.spearman_pairs(many_ranges.createDataFrame(long), range_rows=range_rows, pass_points=pass_points).toPandas()
    want = wide.corr(method="spearman", min_periods=30).dropna(axis=0, how="all").dropna(axis=1, how="all")
    matrix = got.pivot(index="variable_a", columns="variable_b", values="rho")
    assert list(matrix) == list(matrix.index) == sorted(want) == ["ends", "mostly", "tied", "wide"]
    assert np.allclose(matrix, want.loc[sorted(want), sorted(want)], atol=1e-12)
    present = wide[sorted(want)].notna().astype(int)
    assert (got.pivot(index="variable_a", columns="variable_b", values="n") == present.T @ present).all(axis=None)


def test_days_that_are_not_known_are_a_day_and_nan_ranks_last(spark):
    nan = float("nan")
    rows = [(s, d, v, x) for s in (None, 1) for d in (None, *range(40)) for v, x in (("p", nan if d == 7 else float(d or -1)), ("q", float((d or 0) % 5)), (None, 1.0))]
    rows.append((2, 0, "q", None))
    got = {(r.variable_a, r.variable_b): r for r in correlation.spearman_pairs(spark.createDataFrame(rows, "stay_id long, day int, variable string, value double")).collect()}
    p = pd.Series([99.0 if d == 7 else float(d or -1) for _ in range(2) for d in (None, *range(40))])
    q = pd.Series([float((d or 0) % 5) for _ in range(2) for d in (None, *range(40))])
    assert set(got) == {("p", "p"), ("p", "q"), ("q", "p"), ("q", "q")} and {r.n for r in got.values()} == {82}
    assert got["p", "q"].rho == pytest.approx(p.rank().corr(q.rank()), abs=1e-12) and got["p", "p"].rho == 1.0


def test_nothing_in_is_nothing_out(spark):
    none = spark.createDataFrame([], "stay_id long, day int, variable string, value float")
    assert correlation.spearman_pairs(none).collect() == []


def test_passes_leave_no_shuffle_files(spark):
    """The files stayed until the driver collected garbage: at 24 times sf0.1, 2.1 GB of disk for 0.26 GB of input."""
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()

    def files():
        return {f for folder in folders for f in glob.glob(f"{folder}/**/shuffle_*.data", recursive=True)}

    daily = spark.range(4000).selectExpr("0L AS stay_id", "id div 8 AS day", "concat('v', id % 8) AS variable", "cast(xxhash64(id) % 99 AS float) AS value")
    before, kept = files(), correlation.spearman_pairs(daily)
    for _ in range(50):  # files are removed in the background
        if not (left := files() - before):
            break
        time.sleep(0.2)
    assert not left
    assert kept.count() == 64
