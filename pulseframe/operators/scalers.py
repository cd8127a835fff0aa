"""Normalisers. A fitted model is a table; transform and inverse take that table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pulseframe.operators.joins import attach
from pulseframe.operators.ordered import numbered, value_counts
from pulseframe.session import settle


def zscore_fit(events: DataFrame) -> DataFrame:
    """Mean and sample std per variable; a std that is 0 or undefined becomes 1."""
    std = F.stddev_samp("value")
    return events.groupBy("variable").agg(
        F.avg("value").alias("mean"), F.when(std > 0, std).otherwise(F.lit(1.0)).alias("std")
    )


def zscore_transform(events: DataFrame, params: DataFrame, *cols: str) -> DataFrame:
    """(value - mean) / std of the variable, in the given columns (``value`` by default)."""
    scaled = {c: (F.col(c) - F.col("mean")) / F.col("std") for c in cols or ("value",)}
    return attach(events, params, "variable").withColumns(scaled).select(*events.columns)


def zscore_inverse(events: DataFrame, params: DataFrame, *cols: str) -> DataFrame:
    restored = {c: F.col(c) * F.col("std") + F.col("mean") for c in cols or ("value",)}
    return attach(events, params, "variable").withColumns(restored).select(*events.columns)


def ecdf_fit(events: DataFrame) -> DataFrame:
    """One knot per distinct value of a variable; its quantile is the average rank over n."""
    ranks = F.col("upto") - F.col("copies") + (F.col("copies") + 1) / F.lit(2.0)
    return value_counts(events, ["variable"]).select(
        "variable", "value", (ranks / F.col("upto_total")).alias("quantile")
    )


#: Knots of a leaf, and children of a node above them.
WIDTH = 256


class KnotIndex:
    """Knots (x, y) of every variable in sorted leaves, with levels of fences above them.

    A node holds the first x of up to ``WIDTH`` children, whose numbers follow from its own, so a value finds
    its leaf by one equi-join a level, from the one node at the top of its variable down. Events are
    neither sorted nor joined on their values; only the knots, which are fewer, are sorted once.
    """

    def __init__(self, knots: DataFrame, x: str, y: str, width: int = WIDTH):
        self.width = width
        known = knots.select("variable", F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).filter("x IS NOT NULL")
        placed = numbered(known, ["x", "y"], keys=["variable"])
        leaves = self._nodes(placed.withColumn("child", F.col("row") - 1), F.struct("x", "y"), "knots")
        ahead = leaves.select("variable", (F.col("node") - 1).alias("node"), F.col("knots")[0].alias("next"))
        self.leaves = settle(leaves.join(ahead, ["variable", "node"], "left"))
        self.levels: list[DataFrame] = []
        children = self.leaves.select("variable", F.col("node").alias("child"), F.col("knots.x")[0].alias("x"))
        while (children.agg(F.max("child")).first()[0] or 0) > 0 or not self.levels:
            level = settle(self._nodes(children, F.struct("x"), "fences"))
            self.levels.append(level)
            children = level.select("variable", F.col("node").alias("child"), F.col("fences.x")[0].alias("x"))

    def _nodes(self, children: DataFrame, entry: Column, name: str) -> DataFrame:
        node = F.floor(F.col("child") / self.width).alias("node")
        return children.groupBy("variable", node).agg(F.array_sort(F.collect_list(entry)).alias(name))

    def _upto(self, entries: Column, value: Column) -> Column:
        """How many of the sorted entries have an x up to ``value``, by halving steps."""
        steps, step = [], 1
        while step <= self.width:
            steps.insert(0, step)
            step *= 2

        def halve(found: Column, step: Column) -> Column:
            ahead = found + step
            return F.when((ahead <= F.size(entries)) & (F.try_element_at(entries, ahead)["x"] <= value), ahead).otherwise(found)

        return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), halve)

    def look_up(self, events: DataFrame, column: str) -> DataFrame:
        """``column`` replaced by the line through its neighbouring knots, clamped at the ends.

        A missing value stays missing; a value of a variable without knots loses its row.
        """
        value, names = F.col(column), events.columns
        missing = value.isNull() | F.isnan(column)
        found = events.withColumn("_node", F.lit(0).cast("bigint"))
        for level in reversed(self.levels):
            fences = level.withColumnsRenamed({"node": "_node", "fences": "_fences"})
            found = attach(found, fences, ["variable", "_node"], "left")
            child = F.greatest(self._upto(F.col("_fences"), value), F.lit(1)) - 1
            found = found.withColumn("_node", F.col("_node") * self.width + child).drop("_fences")
        leaves = self.leaves.withColumnsRenamed({"node": "_node", "knots": "_knots", "next": "_next"})
        found = attach(found, leaves, ["variable", "_node"], "left").withColumn("_at", self._upto(F.col("_knots"), value))
        left, right = F.try_element_at("_knots", F.greatest("_at", F.lit(1))), F.coalesce(F.try_element_at("_knots", F.col("_at") + 1), F.col("_next"))
        line = left["y"] + (right["y"] - left["y"]) / (right["x"] - left["x"]) * (value - left["x"])
        result = F.when((F.col("_at") == 0) | (left["x"] == value) | right.isNull(), left["y"]).otherwise(line)
        kept = found.filter(F.col("_knots").isNotNull() | missing)
        return kept.withColumn(column, F.when(missing, value).otherwise(result)).select(*names)


def _interpolate(events: DataFrame, knots: DataFrame, cols: tuple[str, ...], x: str, y: str) -> DataFrame:
    index = KnotIndex(knots, x, y)
    for column in cols:
        events = index.look_up(events, column)
    return events


def ecdf_transform(events: DataFrame, knots: DataFrame, *cols: str, fitted: bool = False) -> DataFrame:
    """Value -> quantile. Events of variables without knots are dropped.

    ``fitted`` says that the knots were fitted on these very events; every value then is a knot, and its
    quantile is returned as it is. Both ways read the same index.
    """
    return _interpolate(events, knots, cols or ("value",), "value", "quantile")


def ecdf_inverse(events: DataFrame, knots: DataFrame, *cols: str) -> DataFrame:
    """Quantile -> value."""
    return _interpolate(events, knots, cols or ("value",), "quantile", "value")


def demographic_fit(demo: DataFrame) -> DataFrame:
    return demo.agg(F.avg("age").alias("mean"), F.stddev_samp("age").alias("std"))


def demographic_scale(demo: DataFrame, params: DataFrame) -> DataFrame:
    """Age as z-score, gender as -1 or 1."""
    age = F.try_divide(F.col("age") - params.select("mean").scalar(), params.select("std").scalar())
    return demo.withColumns({"age": age, "gender": F.col("gender") * 2 - 1})


def scaled_time(minute: Column, first: Column, max_minute: int) -> Column:
    half = F.lit(max_minute / 2.0)
    return (minute - (first + half)) / half


def time_scale(window_events: DataFrame, max_minute: int, keys: tuple[str, ...] = ("stay_id", "t1")) -> DataFrame:
    """Add ``time``: the minute mapped so that the first event of the window is -1."""
    first = window_events.groupBy(*keys).agg(F.min("minute").alias("_first"))
    return (
        window_events.join(first, list(keys))
        .withColumn("time", scaled_time(F.col("minute"), F.col("_first"), max_minute))
        .drop("_first")
    )


def scaler_tables_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: are the two model (or result) tables equal, and how many rows differ."""
    columns = sorted(a.columns)
    if columns != sorted(b.columns):
        raise ValueError("the tables have different columns")
    side = [t.select(*columns, F.lit(s).alias("_side")) for t, s in ((a, 1), (b, -1))]
    return (
        side[0]
        .unionByName(side[1])
        .groupBy(*columns)
        .agg(F.sum("_side").alias("_balance"))
        .agg(F.coalesce(F.sum(F.abs("_balance")), F.lit(0)).cast("bigint").alias("different_rows"))
        .withColumn("equal", F.col("different_rows") == 0)
    )
