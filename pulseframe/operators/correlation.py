"""Rank correlation between variables."""

from __future__ import annotations

import functools
import math

from pyspark.sql import DataFrame, Window, functions as F

from pulseframe.operators.joins import attach
from pulseframe.operators.ordered import numbered
from pulseframe.session import freed_shuffles, scratch_path, settle

#: Readings of a variable from which its values are cut into ranges, so that no task ranks more of a pair.
RANGE_ROWS = 1 << 22
#: Points that one pass over the days shuffles, and the most passes; more points make the passes larger.
PASS_POINTS = 1 << 25
PASSES = 16


def spearman_pairs(
    daily: DataFrame, min_periods: int = 30, range_rows: int = RANGE_ROWS, pass_points: int = PASS_POINTS
) -> DataFrame:
    """Spearman matrix ``(variable_a, variable_b, rho, n)``, pairwise complete, both triangles.

    ``daily`` holds one value per (stay, day, variable). Ranks are taken among the days on which
    both variables are present. ``rho`` is null below ``min_periods`` days, and variables without
    any rho are left out.

    The days are stored as one array each, bounded by the vocabulary. Every two readings of a day are a point of
    their pair of variables; a point is shuffled once, ranked on both sides beside the others of its pair, and
    leaves the task as sums. That takes several passes over the days, each for the pairs of some variables, and
    the shuffle files of a pass are removed before the next, so the disk holds the points of one pass.
    """
    with freed_shuffles(daily.sparkSession):
        days = _days(daily)
        names = _names(days, range_rows)
        in_day, variables = F.size("_row").cast("bigint"), names.count()
        points = days.agg(F.sum(in_day * (in_day - 1) / 2)).first()[0] or 0
        passes = max(1, min(PASSES, variables, math.ceil(points / pass_points)))
        known = settle(names.drop("n", "lo", "hi"))
        parts = [settle(_sums(_points(days, known, variables).filter(F.col("id_x") % passes == i))) for i in range(passes)]
        sums = _moved(functools.reduce(DataFrame.union, parts))
        rho = F.try_divide(F.col("_xy"), F.sqrt(F.col("_xx")) * F.sqrt(F.col("_yy")))
        pair = F.col("pair") - 1
        half = sums.select(
            (F.floor(pair / variables) + 1).alias("a"), (pair % variables + 1).alias("b"), "n", rho.alias("rho")
        )
        itself = names.select(F.col("id").alias("a"), F.col("id").alias("b"), "n", F.expr("if(lo < hi, 1D, null)").alias("rho"))
        mirrored = half.select(F.col("b").alias("a"), F.col("a").alias("b"), "n", "rho")
        full = half.union(mirrored).union(itself).withColumn("rho", F.when(F.col("n") >= min_periods, F.col("rho")))
        return _named(settle(full), names)


def _days(daily: DataFrame) -> DataFrame:
    """(_row[(variable, value)], _salt): the readings of each day, in the order of the variables, and a hash of the day."""
    known = daily.filter("value is not null and variable is not null")
    row = F.array_sort(F.collect_list(F.struct("variable", "value"))).alias("_row")
    days = known.groupBy("stay_id", "day").agg(row).select("_row", F.pmod(F.xxhash64("stay_id", "day"), F.lit(64)).cast("int").alias("_salt"))
    path = scratch_path(daily.sparkSession, "days")
    days.write.option("compression", "zstd").parquet(path)
    return daily.sparkSession.read.schema(days.schema).parquet(path)


def _names(days: DataFrame, range_rows: int) -> DataFrame:
    """(variable, id, n, lo, hi), ids in the order of the variables, and ``edges`` if any has more than ``range_rows`` readings.

    Edges are values of such a variable that at most about as many readings lie between.
    """
    readings = days.select(F.inline("_row"))
    counts = readings.groupBy("variable").agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    names = settle(numbered(counts, ["variable"], "id"))
    most = names.agg(F.max("n")).first()[0] or 0
    if most <= range_rows:
        return names
    cuts = math.ceil(most / range_rows)
    at = F.percentile_approx("value", [i / cuts for i in range(1, cuts)], max(10_000, 20 * cuts))
    large = attach(readings, names.filter(F.col("n") > range_rows).select("variable"), "variable", how="left_semi")
    edges = large.groupBy("variable").agg(F.array_sort(F.array_distinct(at)).alias("edges"))
    return settle(names.join(edges, "variable", "left"))


def _points(days: DataFrame, known: DataFrame, variables: int) -> DataFrame:
    """(pair, id_x, x, y) of every two readings of a day; if ``known`` (variable, id) has edges also (in_x, in_y), the
    ranges of the values, and (salt_x, salt_y)."""

    def placed(rows: DataFrame, side: str) -> DataFrame:
        found = attach(rows, known, "variable").drop("variable").withColumnRenamed("id", f"id_{side}")
        if "edges" not in known.columns:
            return found
        # Even ranges lie between two edges, odd ones are the edges themselves: one value, in which ranks are equal.
        edges = F.coalesce(F.col("edges"), F.array().cast(known.schema["edges"].dataType))
        below, upto = F.filter(edges, lambda e: e < F.col(side)), F.filter(edges, lambda e: e <= F.col(side))
        found = found.withColumn(f"in_{side}", F.size(below) + F.size(upto)).drop("edges")
        return found.withColumn(f"salt_{side}", F.when(F.col(f"in_{side}") % 2 == 1, F.col("_salt")).otherwise(0))

    def opened(rows: DataFrame, side: str) -> DataFrame:
        return placed(rows.select(*[c for c in rows.columns if c != "_one"], "_one.variable", F.col("_one.value").alias(side)), side)

    one = days.select("_salt", "_row", F.posexplode("_row").alias("_at", "_one"))
    later = F.slice("_row", F.col("_at") + 2, F.size("_row")).alias("_later")
    one = opened(one.select("_salt", later, "_one").filter(F.size("_later") > 0), "x")
    two = opened(one.select(*[c for c in one.columns if c != "_later"], F.explode("_later").alias("_one")), "y")
    pair = (F.col("id_x") - 1) * variables + F.col("id_y")
    return two.withColumn("pair", pair).drop("id_y", "_salt")


def _sums(points: DataFrame) -> DataFrame:
    """Sums (n, _x, _y, _xy, _xx, _yy) of the ranks per pair, with ranges per pair and both ranges.

    A rank is the number of lower values less that of higher ones, in the range, so it is twice the mean rank,
    centred. Rows of one value have rank 0 however they are dealt out, so they are spread by their salt.
    """
    ranked, ranges = points.drop("id_x"), "in_x" in points.columns
    for side, rank in (("x", "p"), ("y", "q")):
        group = Window.partitionBy("pair", *([f"in_{side}", f"salt_{side}"] if ranges else []))
        below, upto = F.rank().over(group.orderBy(side)) - 1, F.count(F.lit(1)).over(group.orderBy(side))
        ranked = ranked.withColumn(rank, (below + upto - F.count(F.lit(1)).over(group)).cast("double")).drop(side)
    p, q = F.col("p"), F.col("q")
    return ranked.groupBy("pair", *(["in_x", "in_y"] if ranges else [])).agg(
        F.count(F.lit(1)).alias("n"), F.sum(p).alias("_x"), F.sum(q).alias("_y"),
        F.sum(p * q).alias("_xy"), F.sum(p * p).alias("_xx"), F.sum(q * q).alias("_yy"),
    )


def _moved(sums: DataFrame) -> DataFrame:
    """(pair, n, _xy, _xx, _yy): the sums of all ranges of a pair, each moved from the middle of its range to that of the pair."""
    if "in_x" not in sums.columns:
        return sums
    pair = Window.partitionBy("pair")  # as many rows as the pair has ranges
    for side in ("x", "y"):
        upto, here = F.sum("n").over(pair.orderBy(f"in_{side}")), F.sum("n").over(Window.partitionBy("pair", f"in_{side}"))
        sums = sums.withColumn(f"by_{side}", 2 * upto - here - F.sum("n").over(pair))
    n, x, y, dx, dy = (F.col(c).cast("double") for c in ("n", "_x", "_y", "by_x", "by_y"))
    return sums.groupBy("pair").agg(
        F.sum("n").alias("n"), F.sum(F.col("_xy") + dx * y + dy * x + n * dx * dy).alias("_xy"),
        F.sum(F.col("_xx") + 2 * dx * x + n * dx * dx).alias("_xx"), F.sum(F.col("_yy") + 2 * dy * y + n * dy * dy).alias("_yy"),
    )


def _named(full: DataFrame, names: DataFrame) -> DataFrame:
    """``full`` (a, b, n, rho) without the variables that have no rho at all, and with the names of the others."""
    kept = names.join(full.filter("rho is not null").select(F.col("a").alias("id")).distinct(), "id", "left_semi")
    for side in ("a", "b"):
        full = full.join(kept.select(F.col("id").alias(side), F.col("variable").alias(f"variable_{side}")), side)
    return full.select("variable_a", "variable_b", "rho", "n")


def top_correlated(pairs: DataFrame, k: int = 50) -> DataFrame:
    """The ``k`` variables with the largest mean absolute correlation (diagonal included)."""
    strength = pairs.groupBy("variable_a").agg(F.avg(F.abs("rho")).alias("mean_abs_rho"))
    return strength.orderBy(F.desc("mean_abs_rho"), "variable_a").limit(k).select(
        F.col("variable_a").alias("variable"), "mean_abs_rho"
    )
