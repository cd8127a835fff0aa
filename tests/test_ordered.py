import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulseframe.operators.ordered import RANGE, exact_quantiles, numbered, running, sort_and_store, value_counts


@pytest.fixture
def skewed(many_ranges):
    """A key with most rows, one with a single row, over several ranges."""
    rng = np.random.default_rng(0)
    n = 3000
    pdf = pd.DataFrame({
        "key": np.where(rng.random(n) < 0.9, "hot", rng.choice(list("abc"), n)),
        "value": rng.integers(0, 400, n) / 4,
    })
    pdf = pd.concat([pdf, pd.DataFrame({"key": ["one"], "value": [5.0]})], ignore_index=True)
    return pdf, many_ranges.createDataFrame(pdf)


def test_a_hot_key_is_spread(skewed):
    pdf, df = skewed
    stored = sort_and_store(df.distinct(), ["key"], ["value"])
    assert stored.filter("key = 'hot'").select(RANGE).distinct().count() > 3


def test_running(skewed):
    pdf, df = skewed
    counts = df.groupBy("key", "value").agg(F.count(F.lit(1)).alias("c"))
    even = F.when(F.col("value") % 2 == 0, F.col("value"))
    got = running(counts, ["key"], ["value"], {"cum": ("sum", F.col("c")), "prev": ("max", even)}, totals=True,
                  backward={"next": ("min", even), "left": ("sum", F.col("c"))}).toPandas()
    want = pdf.groupby(["key", "value"]).size().rename("c").reset_index().sort_values(["key", "value"])
    want["cum"] = want.groupby("key")["c"].cumsum()
    want["cum_total"] = want.groupby("key")["c"].transform("sum")
    want["left"] = want["cum_total"] - want["cum"] + want["c"]
    even_values = want["value"].where(want["value"] % 2 == 0)
    want["prev"] = even_values.groupby(want["key"]).ffill()
    want["next"] = even_values.groupby(want["key"]).bfill()
    got = got.sort_values(["key", "value"]).reset_index(drop=True)
    columns = ["key", "value", "c", "cum", "cum_total", "left", "prev", "next"]
    pd.testing.assert_frame_equal(got[columns], want[columns].reset_index(drop=True), check_dtype=False)


def test_numbered(skewed):
    pdf, df = skewed
    values = df.select("value").distinct()
    got = numbered(values, ["value"]).toPandas().sort_values("value")
    assert got["row"].tolist() == list(range(1, len(got) + 1))


def test_value_counts(skewed):
    pdf, df = skewed
    got = value_counts(df, ["key"]).filter("key = 'one'").collect()
    assert [(r.copies, r.upto, r.upto_total) for r in got] == [(1, 1, 1)]


def test_exact_quantiles(skewed):
    pdf, df = skewed
    wanted = {"a": 0.01, "b": 0.37, "c": 0.5, "d": 1.0}
    got = exact_quantiles(df, ["key"], wanted).toPandas().set_index("key").sort_index()
    for name, p in wanted.items():
        assert got[name].to_numpy() == pytest.approx(pdf.groupby("key")["value"].quantile(p).sort_index().to_numpy())
