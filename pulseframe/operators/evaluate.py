"""Scores of predictions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from pulseframe.operators.ordered import running
from pulseframe.operators.scalers import ecdf_inverse, ecdf_transform, zscore_inverse, zscore_transform
from pulseframe.session import settle


def thresholds(preds: DataFrame) -> DataFrame:
    """One row per distinct score, from the highest: positives and negatives here and so far."""
    positive = F.col("label").cast("int") == 1
    by_score = preds.groupBy("score").agg(F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg"))
    return running(
        by_score, [], [F.desc("score")], {"tp": ("sum", F.col("pos")), "fp": ("sum", F.col("neg"))}, totals=True
    )


def roc_curve(preds: DataFrame) -> DataFrame:
    """Points (threshold, fpr, tpr); the curve starts at (infinity, 0, 0)."""
    table = thresholds(preds)
    points = table.select(
        F.col("score").alias("threshold"),
        F.try_divide(F.col("fp"), F.col("fp_total")).alias("fpr"),
        F.try_divide(F.col("tp"), F.col("tp_total")).alias("tpr"),
    )
    zero = F.lit(0.0)
    start = preds.agg(F.lit(math.inf).alias("threshold"), zero.alias("fpr"), zero.alias("tpr"))
    return start.unionByName(points)


def auroc(preds: DataFrame) -> DataFrame:
    """Area under the ROC curve; equal scores count half. 0 when a class is missing."""
    strip = F.col("neg") * (F.col("tp") - F.col("pos") / F.lit(2.0))
    area = F.try_divide(F.sum(strip), F.max(F.col("tp_total").cast("double") * F.col("fp_total")))
    return thresholds(preds).agg(F.coalesce(area, F.lit(0.0)).alias("auroc"))


def _precision(tp: Column, fp: Column) -> Column:
    return F.coalesce(F.try_divide(tp, tp + fp), F.lit(1.0))


def pr_curve(preds: DataFrame) -> DataFrame:
    """Points (threshold, precision, recall), closed by (infinity, 1, 0)."""
    points = thresholds(preds).select(
        F.col("score").alias("threshold"),
        _precision(F.col("tp"), F.col("fp")).alias("precision"),
        F.try_divide(F.col("tp"), F.col("tp_total")).alias("recall"),
    )
    end = preds.agg(F.lit(math.inf).alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"))
    return points.unionByName(end)


def pr_auc(preds: DataFrame) -> DataFrame:
    """Area under the precision-recall curve by trapezoids.

    The previous point of a threshold is its own counts less what it adds, so no neighbour is read.
    """
    tp, fp, pos, neg = (F.col(c) for c in ("tp", "fp", "pos", "neg"))
    height = (_precision(tp, fp) + _precision(tp - pos, fp - neg)) / F.lit(2.0)
    area = F.sum(F.try_divide(pos, F.col("tp_total")) * height)
    return thresholds(preds).agg(area.alias("pr_auc"))


def minrp(preds: DataFrame) -> DataFrame:
    """The largest min(precision, recall) over all thresholds."""
    return pr_curve(preds).agg(F.max(F.least("precision", "recall")).alias("minrp"))


def score_metrics(preds: DataFrame) -> DataFrame:
    """One row: mean_prediction, auroc, pr_auc, pr_roc_auc_sum and minrp, all from one table of thresholds.

    The scores are sorted once; ranges of them carry the counts of the ranges before, and every measure
    is a sum or a maximum over thresholds. Areas are those of ``auroc`` and ``pr_auc``; without
    predictions there is no mean, and areas that a missing class leaves undefined are as there.
    """
    tp, fp, pos, neg = (F.col(c) for c in ("tp", "fp", "pos", "neg"))
    strip = neg * (tp - pos / F.lit(2.0))
    height = (_precision(tp, fp) + _precision(tp - pos, fp - neg)) / F.lit(2.0)
    roc = F.coalesce(F.try_divide(F.sum(strip), F.max(F.col("tp_total").cast("double") * F.col("fp_total"))), F.lit(0.0))
    measures = thresholds(preds).agg(
        F.try_divide(F.sum(F.col("score") * (pos + neg)), F.sum(pos + neg)).alias("mean_prediction"),
        roc.alias("auroc"),
        F.sum(F.try_divide(pos, F.col("tp_total")) * height).alias("pr_auc"),
        F.coalesce(F.max(F.least(_precision(tp, fp), F.try_divide(tp, F.col("tp_total")))), F.lit(0.0)).alias("minrp"),
    )
    return measures.withColumn("pr_roc_auc_sum", F.col("pr_auc") + F.col("auroc"))


def log_loss(preds: DataFrame, weight: float | DataFrame | None = None) -> DataFrame:
    """Mean binary cross entropy from ``logit``, unweighted and times ``weight``.

    ``weight`` is a number or a one-row table with ``pos_class_weight``.
    """
    x, y = F.col("logit"), F.col("label").cast("double")
    loss = F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))
    factor = weight.select("pos_class_weight").scalar() if isinstance(weight, DataFrame) else F.lit(float(weight or 1.0))
    return preds.agg(F.avg(loss).alias("unweighted_loss")).withColumn("weighted_loss", F.col("unweighted_loss") * factor)


def prediction_bias(preds: DataFrame) -> DataFrame:
    """Mean prediction, share of positives and their relative difference."""
    means = preds.agg(
        F.avg("score").alias("mean_prediction"), F.avg(F.col("label").cast("double")).alias("pos_class_frac")
    )
    return means.withColumn(
        "pred_diff", F.try_divide(F.col("mean_prediction") - F.col("pos_class_frac"), F.col("pos_class_frac"))
    )


def score_distribution(preds: DataFrame, bins: int = 20) -> DataFrame:
    """Histogram of scores in [0, 1] by class: share of all rows and share of the class."""
    place = F.least(F.floor(F.col("score") * bins), F.lit(bins - 1)).cast("int")
    counts = preds.groupBy(F.col("label").cast("int").alias("label"), place.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    of_class = counts.groupBy("label").agg(F.sum("count").alias("_class"))
    total = preds.agg(F.count(F.lit(1))).scalar()
    return counts.join(of_class, "label").select(
        "label", "bin", "count",
        (F.col("count") / total).alias("joint_share"),
        (F.col("count") / F.col("_class")).alias("class_share"),
    )


def masked_losses(
    cells: DataFrame, original: tuple[str, DataFrame], targets: dict[str, tuple[str, DataFrame]]
) -> DataFrame:
    """MSE and MAE of masked cells in several value spaces.

    ``cells`` has ``variable, pred, true, mask`` in the space of the ``original`` scaler; each
    scaler is a kind (``zscore`` or ``ecdf``) and its model table. Values are brought back to
    their own units and scaled anew for every target space.
    """
    inverse = {"zscore": zscore_inverse, "ecdf": ecdf_inverse}
    forward = {"zscore": zscore_transform, "ecdf": ecdf_transform}
    kind, model = original
    plain = inverse[kind](cells.filter("mask").select("variable", "pred", "true"), settle(model), "true", "pred")
    result = None
    for name, (kind, model) in targets.items():
        scaled = forward[kind](plain, settle(model), "true", "pred")
        gap = F.col("true") - F.col("pred")
        row = scaled.agg(F.avg(gap * gap).alias("mse_loss"), F.avg(F.abs(gap)).alias("mae_loss")).withColumn(
            "space", F.lit(name)
        )
        result = row if result is None else result.unionByName(row)
    return result
