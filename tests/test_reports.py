import math
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pulseframe.functions.quantile import normal_quantile
from pulseframe.operators import correlation, evaluate, experiments, journeys, stats


def test_normal_quantile(spark):
    points = [1e-300, 1e-20, 1e-9, 0.01, 0.07, 0.3, 0.5, 0.77, 0.99, 1 - 1e-9]
    got = spark.createDataFrame([(p,) for p in points], "p double").select("p", normal_quantile(F.col("p")).alias("x")).collect()
    for r in got:
        assert r.x == pytest.approx(statistics.NormalDist().inv_cdf(r.p), rel=1e-14, abs=1e-15)


def test_normality_distance(many_ranges):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"variable": ["n"] * 500 + ["t"] * 300 + ["flat"] * 9 + ["one"],
                        "value": np.concatenate([rng.normal(size=500), rng.integers(0, 5, 300), [2.0] * 9, [1.0]])})
    got = {r.variable: r.wasserstein_distance for r in stats.normality_distance(many_ranges.createDataFrame(pdf)).collect()}
    for name in ("n", "t"):
        v = np.sort(pdf[pdf["variable"] == name]["value"].to_numpy())
        z = (v - v.mean()) / v.std(ddof=1)
        p = (np.arange(1, len(v) + 1) - 0.5) / len(v)
        q = np.array([statistics.NormalDist().inv_cdf(x) for x in p])
        assert got[name] == pytest.approx(np.abs(z - q).mean())
    assert got["flat"] is None and got["one"] is None


@pytest.mark.parametrize("values", [
    np.random.default_rng(4).normal(size=40), np.random.default_rng(5).exponential(size=300), np.full(7, 3.0),
    np.concatenate([np.zeros(90), np.arange(10.0)]),
])
def test_histogram_matches_automatic_bins(spark, values):
    df = spark.createDataFrame([("v", float(x)) for x in values], "variable string, value double")
    rows = stats.histogram(df).orderBy("bin").collect()
    q1, q3 = np.percentile(values, [25, 75])
    reach, n = np.ptp(values), len(values)
    width = reach / (np.log2(n) + 1)
    robust = 2 * (q3 - q1) * n ** (-1 / 3)
    width = min(width, robust) if robust else width
    bins = min(30, int(np.ceil(reach / width))) if width else 1
    counts, edges = np.histogram(values, bins)
    assert [r["count"] for r in rows] == counts.tolist()
    assert [r.left_edge for r in rows] + [rows[-1].right_edge] == pytest.approx(edges.tolist())


def test_spearman(many_ranges):
    rng = np.random.default_rng(6)
    wide = pd.DataFrame({"a": rng.integers(0, 9, 120), "b": rng.normal(size=120), "c": rng.normal(size=120)}).astype(float)
    wide["b"] += wide["a"]
    wide.loc[rng.random(120) < 0.3, "a"] = np.nan
    wide["d"] = np.where(np.arange(120) < 20, 1.0 * np.arange(120), np.nan)
    long = wide.rename_axis("day").reset_index().melt("day", var_name="variable").dropna().assign(stay_id=1)
    got = correlation.spearman_pairs(many_ranges.createDataFrame(long)).toPandas()
    want = wide.corr(method="spearman", min_periods=30).dropna(axis=0, how="all").dropna(axis=1, how="all")
    matrix = got.pivot(index="variable_a", columns="variable_b", values="rho")
    assert list(matrix) == list(want) and np.allclose(matrix, want, atol=1e-9, equal_nan=True)
    top = correlation.top_correlated(many_ranges.createDataFrame(got), 2).toPandas()
    assert top["variable"].tolist() == want.abs().mean().sort_values(ascending=False).index[:2].tolist()


def test_thin_journey(spark):
    rng = np.random.default_rng(7)
    rows = sorted({(int(s), int(m), v) for s, m, v in zip(rng.integers(0, 4, 400), rng.integers(0, 3000, 400), rng.choice(list("ab"), 400))})
    events = spark.createDataFrame([(s, ["x", "y"], v, m, 7.9) for s, m, v in rows],
                                   "stay_id long, source array<string>, variable string, minute int, value double")
    bounds = spark.createDataFrame([("a", 0.0, 14.0), ("b", 0.0, 7.0)], "variable string, p_lo double, p_hi double")
    got = journeys.thin_journey(events, bounds).toPandas()
    assert len(got) == len(rows) and set(got["level"]) == {0.5, 1.0} and set(got["source"]) == {"x"}
    for (stay, variable), group in got.groupby(["stay_id", "variable"]):
        last = got[got["stay_id"] == stay]["minute"].max()
        kept, shown = None, []
        for m in sorted(group["minute"]):
            if kept is None or (m - kept) * 20 > last:
                kept = m
                shown.append(m)
        assert sorted(group[group["shown"]]["minute"]) == shown


@pytest.fixture
def preds(many_ranges):
    rng = np.random.default_rng(8)
    label = (rng.random(500) < 0.2).astype(int)
    score = np.clip(np.round(rng.normal(0.4 + 0.2 * label, 0.2), 2), 0.01, 0.99)
    pdf = pd.DataFrame({"id": range(500), "score": score, "label": label, "logit": np.log(score / (1 - score))})
    return pdf, many_ranges.createDataFrame(pdf)


def test_scores(preds):
    pdf, df = preds
    pos, neg = pdf[pdf["label"] == 1]["score"].to_numpy(), pdf[pdf["label"] == 0]["score"].to_numpy()
    pairs = (pos[:, None] > neg).mean() + 0.5 * (pos[:, None] == neg).mean()
    assert evaluate.auroc(df).first()[0] == pytest.approx(pairs)
    cuts = np.sort(pdf["score"].unique())[::-1]
    tp = np.array([(pos >= c).sum() for c in cuts])
    fp = np.array([(neg >= c).sum() for c in cuts])
    precision, recall = np.r_[1, tp / (tp + fp)], np.r_[0, tp / len(pos)]
    area = np.sum(np.diff(recall) * (precision[1:] + precision[:-1]) / 2)
    assert evaluate.pr_auc(df).first()[0] == pytest.approx(area)
    assert evaluate.minrp(df).first()[0] == pytest.approx(np.minimum(precision, recall).max())
    loss = -(pdf["label"] * np.log(pdf["score"]) + (1 - pdf["label"]) * np.log(1 - pdf["score"])).mean()
    row = evaluate.log_loss(df, 4.0).first()
    assert (row.unweighted_loss, row.weighted_loss) == pytest.approx((loss, 4 * loss))
    shares = evaluate.score_distribution(df, 10).toPandas()
    assert shares["joint_share"].sum() == pytest.approx(1) and shares.groupby("label")["class_share"].sum().tolist() == pytest.approx([1, 1])
    roc = evaluate.roc_curve(df).toPandas().sort_values("threshold", ascending=False)
    assert roc["threshold"].iloc[0] == math.inf and roc["tpr"].is_monotonic_increasing and roc["fpr"].iloc[-1] == 1


def test_scores_of_one_class(spark):
    df = spark.createDataFrame([(0.5, 0), (0.7, 0)], "score double, label int")
    assert evaluate.auroc(df).first()[0] == 0.0
    assert evaluate.prediction_bias(df).first().pred_diff is None


def test_runs(spark):
    config = ('{"data_fraction": %s, "data_config": {"train": {"dataset": {"scaler_class": "%s", "path": "%s"}, '
              '"loader": {"batch_size": 32}}}%s}')
    summary = '{"_runtime": 600, "epoch": 12, "test_auroc": %s}'
    def run(i, name="ours", state="finished", tags=(), fraction=0.5, scaler="VariableECDFScaler", path="d/noisy_uniform_p0.5/train",
            stop=', "early_stop_callback": {"patience": 3}', score=0.8):
        return (i, name, state, "finetune", list(tags), config % (fraction, scaler, path, stop), summary % score)
    runs = spark.createDataFrame([
        run("a"), run("b", scaler="VariableStandardScaler", path="d/original/train", stop="", score=0.6), run("c", state="failed"),
        run("d", tags=["archive"]), run("e", name="other"), run("f", fraction=0.05),
    ], "run_id string, name string, state string, stage string, tags array<string>, config string, summary string")
    flat = experiments.runs_flatten(runs, {"ours": "Ours"}, "finetune", (0.1, 1.0))
    got = flat.collect()
    assert [(r.run_id, r.name, r.kind, r.data, r.noise_type, r.epoch, r.training_time) for r in got] == [
        ("b", "Ours", "z", "original", "none", 12, 10.0), ("a", "Ours", "ecdf", "noisy_uniform_p0.5", "uniform", 9, 10.0)]
    table = experiments.mean_sem(flat, ["name", "kind"], ["test_auroc", "test_loss"])
    rows = {r.kind: r for r in table.collect()}
    assert set(rows) == {"z", "ecdf"} and rows["z"]["mean"] == 0.6 and rows["z"].sem is None  # a metric without values is dropped
    diff = {r.kind: r.rel_diff for r in experiments.baseline_diff(table, "z", "kind", ["name"]).collect()}
    assert diff == pytest.approx({"z": 0, "ecdf": 1 / 3})
    best = {r.kind: r.best for r in experiments.best_flag(table, ["name"], "min").collect()}
    assert best == {"z": True, "ecdf": False}
    assert experiments.best_run(flat, "test_auroc").first().run_id == "b"


def test_journey_numbers(spark):
    events = spark.createDataFrame([(1,), (1,), (2,)], "stay_id long")
    stays = spark.sql("""select * from values (1L, 7L, timestamp'2020-01-01 00:00:00', timestamp'2020-01-01 01:00:59'),
      (2L, 7L, timestamp'2020-01-01 00:00:00', timestamp'2020-01-01 03:00:00') as t(stay_id, patient_id, time_start, time_end)""")
    got = {r.statistic: r.value for r in stats.journey_statistics(events, stays).collect()}
    assert len(got) == 17 and got["MeanNumOfEventsPerStay"] == 1.5 and got["MinDurationMin"] == 60.0
    assert got["NumPatientsWithICUStay"] == 1 and got["MaxNumOfEventsPerPatient"] == 3 and got["StdNumOfEventsPerPatient"] is None


def test_sketches_come_near_the_exact_percentiles(tables):
    for exact, sketch in ((stats.variable_statistics(tables.lines), stats.variable_statistics(tables.lines, exact=False)),
                          (stats.percentile_bounds(tables.lines), stats.percentile_bounds(tables.lines, exact=False))):
        a, b = (df.toPandas().set_index("variable").sort_index() for df in (exact, sketch))
        assert list(a) == list(b)
        percentiles = [c for c in a if c.startswith("p")]  # prices; a sketch names a neighbouring value
        assert np.allclose(a[percentiles], b[percentiles], rtol=0.02, atol=500)
        assert np.allclose(a.drop(columns=percentiles), b.drop(columns=percentiles))


def test_losses_are_shown_times_a_thousand(spark):
    runs = spark.createDataFrame([("a", 0.0012), ("a", 0.0034)], "name string, loss double")
    row = experiments.mean_sem(runs, ["name"], ["loss"], factors={"loss": 1000}).first()
    assert row["mean"] == 2.3 and row["sem"] == pytest.approx(1.1)


def test_combine_drops_empty_columns(spark):
    own = spark.createDataFrame([("Ours", 0.5, 1.0, None)], "name string, data_fraction double, training_time double, loss double")
    other = spark.createDataFrame([("b", 0.5, 120.0), ("c", 0.2, 60.0)], "name string, data_fraction double, training_time double")
    got = experiments.combine_results(own, other, {"b": "Base"}, [0.5])
    assert got.columns == ["name", "data_fraction", "training_time"]
    assert sorted(tuple(r) for r in got.collect()) == [("Base", 0.5, 2.0), ("Ours", 0.5, 1.0)]


def test_scores_are_rounded_as_in_sql(spark, tmp_path):
    import duckdb

    from pulseframe.plans.oracle_views import VIEWS
    from pulseframe.plans.views import Tables

    docs = pd.DataFrame({"doc_id": np.arange(20_001), "n_chars": np.arange(20_001)})
    docs.to_parquet(tmp_path / "documents.parquet")
    docs.assign(toxic=docs["doc_id"] % 2)[["doc_id", "toxic"]].to_parquet(tmp_path / "labels.parquet")
    got = Tables(spark, str(tmp_path)).predictions.select("id", "score").toPandas().sort_values("id")["score"].tolist()
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet'")
    assert got == con.execute(f"SELECT score FROM ({VIEWS['v_predictions']}) ORDER BY id").df()["score"].tolist()


def test_ties_are_rounded_as_in_sql(spark):
    import duckdb

    from pulseframe.plans.registry import r_ties

    shares = [(k / 5120,) for k in range(5121)] + [(k / 1024,) for k in range(1025)]
    got = [row.x for row in spark.createDataFrame(shares, "x double").coalesce(1).select(r_ties("x", 9)).collect()]
    assert got == [x for (x,) in duckdb.execute("SELECT round(unnest(?::DOUBLE[]), 9)", [[x for (x,) in shares]]).fetchall()]


def test_values_on_an_edge_stay_there_as_scores(spark):
    rng = np.random.default_rng(11)
    values = np.concatenate([np.tile([0.0, 92.84, 464.2], (300, 1)), rng.integers(1, 9000, (300, 9)) / 100], axis=1)
    df = spark.createDataFrame(pd.DataFrame({"variable": np.repeat([f"v{i}" for i in range(300)], 12), "value": values.ravel()}))
    table = stats.transform_comparison(df).toPandas().set_index(["variable", "bin"])
    counts = [table[table["space"] == space]["count"].sort_index() for space in ("original", "zscore")]
    pd.testing.assert_series_equal(*counts)


def test_spearman_computes_its_input_once(spark):
    rows = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            rows.add(batch.num_rows)
            yield batch

    daily = spark.range(400).selectExpr("0L AS stay_id", "id div 4 AS day", "concat('v', id % 4) AS variable", "cast(xxhash64(id) % 9 AS float) AS value")
    pairs = correlation.spearman_pairs(daily.mapInArrow(counted, daily.schema)).collect()
    assert len(pairs) == 16 and rows.value == 400
