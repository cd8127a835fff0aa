import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulseframe.operators import scalers


@pytest.fixture
def fitted(many_ranges):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"stay_id": np.arange(400), "variable": rng.choice(["a", "b"], 400),
                        "value": np.round(rng.normal(10, 4, 400), 1)})
    pdf.loc[pdf["variable"] == "b", "value"] *= 100
    df = many_ranges.createDataFrame(pdf)
    return pdf, df, scalers.ecdf_fit(df)


def reference(pdf):
    out = {}
    for name, values in pdf.groupby("variable")["value"]:
        knots = pd.DataFrame({"v": values, "q": values.rank() / len(values)}).drop_duplicates("v").sort_values("v")
        out[name] = knots["v"].to_numpy(), knots["q"].to_numpy()
    return out


def test_ecdf_fit(fitted):
    pdf, df, knots = fitted
    got = knots.toPandas().sort_values(["variable", "value"])
    for name, (v, q) in reference(pdf).items():
        mine = got[got["variable"] == name]
        assert mine["value"].to_numpy() == pytest.approx(v)
        assert mine["quantile"].to_numpy() == pytest.approx(q, abs=1e-12)


@pytest.mark.parametrize("fitted_path", [True, False])
def test_ecdf_round_trip(fitted, fitted_path):
    pdf, df, knots = fitted
    scaled = scalers.ecdf_transform(df, knots, fitted=fitted_path)
    bounds = scaled.agg(F.min("value"), F.max("value")).first()
    assert 0 < bounds[0] and bounds[1] <= 1
    back = scalers.ecdf_inverse(scaled, knots).toPandas().sort_values("stay_id")
    assert back["value"].to_numpy() == pytest.approx(pdf["value"].to_numpy())


def test_ecdf_unseen_values(fitted, many_ranges):
    pdf, df, knots = fitted
    rng = np.random.default_rng(2)
    asked = pd.DataFrame({"variable": rng.choice(["a", "b"], 300), "value": rng.uniform(-100, 3000, 300)})
    asked = pd.concat([asked, pd.DataFrame({"variable": ["a", "none"], "value": [None, 1.0]})])
    got = scalers.ecdf_transform(many_ranges.createDataFrame(asked).withColumn("raw", F.col("value")), knots).toPandas()
    assert len(got) == 301  # a variable without knots is dropped, a missing value stays missing
    assert got[got["raw"].isna()]["value"].isna().all()
    for name, (v, q) in reference(pdf).items():
        mine = got[(got["variable"] == name) & got["raw"].notna()]
        assert mine["value"].to_numpy() == pytest.approx(np.interp(mine["raw"], v, q), abs=1e-12)


def test_ecdf_inverse_clamps(fitted, many_ranges):
    pdf, df, knots = fitted
    asked = many_ranges.createDataFrame([("a", -0.1), ("a", 1.1)], "variable string, value double")
    got = sorted(r.value for r in scalers.ecdf_inverse(asked, knots).collect())
    values = pdf[pdf["variable"] == "a"]["value"]
    assert got == [values.min(), values.max()]


def test_zscore(spark):
    events = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 5.0), ("c", 2.0), ("c", 2.0)], "variable string, value double")
    params = scalers.zscore_fit(events)
    assert {r.variable: r.std for r in params.collect()} == pytest.approx({"a": 2 ** 0.5, "b": 1.0, "c": 1.0})
    scaled = scalers.zscore_transform(events, params)
    assert sorted(r.value for r in scaled.collect()) == pytest.approx([-0.5 ** 0.5, 0, 0, 0, 0.5 ** 0.5])
    back = scalers.zscore_inverse(scaled, params)
    assert sorted(r.value for r in back.collect()) == pytest.approx([1, 2, 2, 3, 5])


def test_demographics_and_equality(spark):
    demo = spark.createDataFrame([(1, 20.0, 0), (2, 40.0, 1)], "stay_id long, age double, gender int")
    got = scalers.demographic_scale(demo, scalers.demographic_fit(demo)).orderBy("stay_id").collect()
    assert [r.age for r in got] == pytest.approx([-0.5 ** 0.5, 0.5 ** 0.5]) and [r.gender for r in got] == [-1, 1]
    other = demo.withColumn("age", F.col("age") + (F.col("stay_id") == 2).cast("int"))
    assert scalers.scaler_tables_equal(demo, demo.repartition(7)).first().equal
    assert scalers.scaler_tables_equal(demo, other).first().different_rows == 2


def test_time_scale(spark):
    rows = spark.createDataFrame([(1, 9, m) for m in (0, 1440, 2880)], "stay_id long, t1 int, minute int")
    got = scalers.time_scale(rows, 2880).orderBy("minute").collect()
    assert [r.time for r in got] == [-1.0, 0.0, 1.0]


@pytest.mark.parametrize("width", [2, 3, 256])
def test_knot_index_of_any_depth(spark, width):
    """Values before, on, between and after the knots, through several levels of fences."""
    import numpy as np

    rng = np.random.default_rng(3)
    xs = {v: np.unique(np.round(rng.normal(size=n) * 10, 3)) for v, n in (("one", 1), ("two", 2), ("many", 400))}
    knots = spark.createDataFrame([(v, float(x), float(x) ** 3 + i) for v, own in xs.items() for i, x in enumerate(own)], "variable string, value double, quantile double").repartition(3)
    asked = [(v, float(x)) for v, own in xs.items() for x in [*own[:50], *(own[:50] + 0.0004), -1e9, 1e9, 0.0]]
    asked += [("many", None), ("many", float("nan")), ("other", 1.0), ("other", None)]
    events = spark.createDataFrame([(i, v, x) for i, (v, x) in enumerate(asked)], "id int, variable string, value double").repartition(4)
    found = {r.id: r.value for r in scalers.KnotIndex(knots, "value", "quantile", width).look_up(events, "value").collect()}
    for i, (v, x) in enumerate(asked):
        if v == "other" and x is not None:
            assert i not in found
        elif x is None or x != x:
            assert found[i] is None or found[i] != found[i]
        else:
            ys = [y**3 + k for k, y in enumerate(xs[v])]
            assert found[i] == pytest.approx(np.interp(x, xs[v], ys), rel=1e-9, abs=1e-9)
    none = scalers.KnotIndex(knots.filter("false"), "value", "quantile", width).look_up(events, "value").collect()
    assert sorted(asked[r.id][0] for r in none) == ["many", "many", "other"]


def test_events_are_not_sorted_for_the_look_up(spark, tables):
    knots = scalers.ecdf_fit(tables.processed)
    plan = scalers.ecdf_transform(tables.processed, knots)._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan
