"""Composed model input: windows that dropout empties, stored fitted state, and the job."""

import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from pulseframe.operators import windows
from pulseframe.plans import inputs


def u(*keys):
    return int(hashlib.md5("|".join(map(str, keys)).encode()).hexdigest()[:13], 16) / 16**13


def walk(events, stay, p, draw, max_minute, min_input, seed=42):
    """Visit by visit, as a loader would."""
    own = [(m, v) for s, m, v in events if s == stay]
    first, last = min(m for m, _ in own), max(m for m, _ in own)
    ends = sorted({m for m, _ in own if m - first >= min_input and m < last}, key=lambda t1: (u(stay, t1, seed, "t1"), t1))
    if not ends:
        return None
    ends = ends[draw % len(ends) :] + ends[: draw % len(ends)]
    visit = 0
    while True:
        t1, cycle = ends[visit % len(ends)], visit // len(ends)
        inside = {v for m, v in own if t1 - max_minute <= m <= t1}
        kept = {v for v in inside if p == 0 or math.floor(math.log(1 - u(stay, t1, v, draw, seed, "kept")) / math.log(p)) == cycle}
        if kept:
            return t1, kept, visit
        visit += 1


@pytest.mark.parametrize("p", [0, 0.5, 0.95, 0.99])
def test_an_emptied_window_gives_way_to_the_next(spark, p):
    rng = random.Random(2)
    events = sorted({(s, 0 if k == 0 else rng.randrange(600), f"v{rng.randrange(3)}") for s in range(25) for k in range(rng.choice([1, 2, 9, 30]))})
    df = spark.createDataFrame([(*e, 1.0) for e in events], "stay_id bigint, minute bigint, variable string, value double").repartition(4)
    found = windows.kept_windows(df, windows.window_candidates(df, 60), 200, p, draws=3)
    got = {}
    for r in found.collect():
        t1, kept = got.setdefault((r.stay_id, r.draw), (r.t1, set()))
        assert t1 == r.t1
        kept.add(r.variable)
    want = {(s, d): w for s in range(25) for d in range(3) if (w := walk(events, s, p, d, 200, 60))}
    assert got == {k: w[:2] for k, w in want.items()}
    assert (max(w[2] for w in want.values()) > 0) == (p > 0)


def test_kept_share_is_that_of_one_draw(spark):
    rows = spark.range(40_000).withColumn("variable", F.lit("x"))
    cycles = dict(windows.first_kept(rows, ["id", "variable"], 0.8).groupBy("cycle").count().collect())
    for c in range(4):
        assert abs(cycles[c] / 40_000 - 0.2 * 0.8**c) < 0.01
    with pytest.raises(ValueError):
        windows.first_kept(rows, ["id"], 1.0)


def test_fitted_state_is_stored_read_and_compared(spark, tables, tmp_path):
    train = tables.processed.filter("stay_id % 5 <> 0")
    fitted = inputs.fit(train, tables.stay_traits, 1440)
    inputs.save(fitted, str(tmp_path / "a"))
    again = inputs.load(spark, str(tmp_path / "a"))
    assert inputs.same(fitted, again)
    other = inputs.fit(tables.processed, tables.stay_traits, 1440)
    assert not inputs.same(other, again)
    spark.createDataFrame([("x", 0, 0.0, 1.0)], "variable string, var_id int, mean double, std double").write.mode("overwrite").parquet(str(tmp_path / "a/variables.parquet"))
    with pytest.raises(ValueError):
        inputs.load(spark, str(tmp_path / "a"))
    top = inputs.fit(train, tables.stay_traits, 1440, top=2)
    assert top.variables.count() == 2
    assert {r.variable for r in inputs.encode(tables.processed, top).select("variable").distinct().collect()} == {r.variable for r in top.variables.collect()}


def test_job_writes_samples_of_every_split(spark, tables, tmp_path):
    from pulseframe.plans import jobs
    from pulseframe.sources import io

    split = F.when(F.col("stay_id") % 5 == 0, "val").when(F.col("stay_id") % 5 == 1, "test").otherwise("train").alias("split")
    splits = tables.processed.select("stay_id").distinct().select("stay_id", split)
    labels = tables.stay_labels.select("stay_id", "died")
    io.write_splits(labels, tables.stay_traits, tables.processed, splits, splits, str(tmp_path / "data"))
    args = jobs.parse(["inputs", "--dataset", str(tmp_path / "data"), "--output", str(tmp_path / "out"), "--max-minute", "1440", "--min-input", "720", "--forecast", "120", "--batch", "16", "--dropout", "0.5"])
    args.run(spark, args)
    for kind in ("pretrain", "finetune"):
        rows = spark.read.parquet(str(tmp_path / "out" / f"{kind}.parquet"))
        assert {r.split for r in rows.select("split").distinct().collect()} == {"train", "val", "test"}
        assert rows.filter("size(values) <> size(input_mask) OR size(values) % 8 <> 0").count() == 0
    fitted = inputs.load(spark, str(tmp_path / "out" / "fitted"))
    assert inputs.same(fitted, inputs.fit(tables.processed.filter("stay_id % 5 > 1"), tables.stay_traits.filter("stay_id % 5 > 1"), 1440))
