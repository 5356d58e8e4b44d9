"""Exact areas under the ROC and precision-recall curves, for many runs at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwatch.functions.rates import share
from ledgerwatch.operators.evaluation import score_points
from ledgerwatch.operators.ordered import ROWS_PER_RANGE, running_totals
from ledgerwatch.session import materialize


def areas_under_curves(
    scored: DataFrame,
    score: str = "fraud_score",
    label: str = "label",
    by: Sequence[str] = (),
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """``roc_auc`` and ``auc_pr`` per group, by the trapezoid rule over every distinct score.

    Both need only a point's own counts and its running totals: the previous point on the
    curve is the running total minus the own counts, so there is no lag across ranges.
    The PR curve starts at recall 0 with the first point's precision.
    """
    points = materialize(score_points(scored, score, label, by), "score-points")
    ranked = running_totals(
        points, score, ["positives", "negatives"], by, descending=True, rows_per_range=rows_per_range
    )
    tp, fp = F.col("cum_positives"), F.col("cum_negatives")
    own_tp, own_fp = F.col("positives"), F.col("negatives")
    tp_before, fp_before = tp - own_tp, fp - own_fp
    precision_here = share(tp, tp + fp)
    precision_before = F.when(tp_before + fp_before == 0, precision_here).otherwise(
        share(tp_before, tp_before + fp_before)
    )
    sums = ranked.groupBy(*by).agg(
        F.sum("positives").alias("p"),
        F.sum("negatives").alias("n"),
        # As doubles before the product: counts of one score may be in the billions.
        F.sum(own_fp.cast("double") * (tp_before + tp) / 2.0).alias("roc_area"),
        F.sum(own_tp * (precision_before + precision_here) / 2.0).alias("pr_area"),
    )
    p, n = F.col("p").cast("double"), F.col("n").cast("double")
    roc = F.when(p == 0, 0.0).when(n == 0, 1.0).otherwise(F.col("roc_area") / (p * n))
    return sums.filter(p + n > 0).select(
        *by, roc.alias("roc_auc"), share(F.col("pr_area"), p).alias("auc_pr")
    )
