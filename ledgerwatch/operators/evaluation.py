"""Confusion matrices and rates over a threshold grid, for one score column or many runs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwatch.functions import rates
from ledgerwatch.session import materialize

MOST_BROADCAST_RUNS = 100_000


def double_array(values: Sequence[float]) -> Column:
    """A constant array, parsed once instead of built element by element."""
    return F.expr(f"array({', '.join(f'{float(value)!r}D' for value in values)})")


def confusion_sweep(
    scored: DataFrame,
    thresholds: Sequence[float],
    score: str = "fraud_score",
    label: str = "label",
    by: Sequence[str] = (),
) -> DataFrame:
    """tp, fp, tn, fn for each threshold and group, in one pass over the rows.

    A row only adds one to the cell "how many thresholds does this score reach", found by
    binary search; at most ``len(thresholds) + 1`` cells per group leave a map task, and
    the matrices are sums over those cells. Rows with a NULL score or a label outside {0, 1} count nowhere.
    """
    limits = [float(value) for value in thresholds]
    if not limits:
        raise ValueError("At least one threshold is needed.")
    distinct = sorted(set(limits))
    # Interval i of the cutter holds the scores that reach exactly i distinct thresholds.
    cutter = Bucketizer(
        splits=[float("-inf"), *distinct, float("inf")],
        inputCol=score,
        outputCol="reached",
        handleInvalid="keep",
    )
    counted = scored.filter(F.col(score).isNotNull() & F.col(label).isin(0, 1)).select(
        *by, F.col(score).cast("double").alias(score), label
    )
    cells = (
        cutter.transform(counted)
        .groupBy(*by, F.col("reached").cast("int").alias("reached"))
        .agg(
            F.count_if(F.col(label) == 1).alias("positives"),
            F.count_if(F.col(label) == 0).alias("negatives"),
        )
    )
    gathered = cells.groupBy(*by).agg(
        F.collect_list(F.struct("reached", "positives", "negatives")).alias("cells")
    )
    grid = gathered.select(
        *by, "cells", F.posexplode(double_array(limits)).alias("position", "threshold")
    ).withColumn("rank", F.array_position(double_array(distinct), F.col("threshold")))

    def total(column: str, hit: bool):
        def chosen(cell):
            return (cell["reached"] >= F.col("rank")) if hit else (cell["reached"] < F.col("rank"))

        picked = F.filter("cells", chosen)
        return F.aggregate(picked, F.lit(0).cast("long"), lambda acc, cell: acc + cell[column])

    return grid.select(
        *by,
        "position",
        "threshold",
        total("positives", True).alias("tp"),
        total("negatives", True).alias("fp"),
        total("negatives", False).alias("tn"),
        total("positives", False).alias("fn"),
    )


def with_rates(matrices: DataFrame) -> DataFrame:
    """Add precision, recall and f1_score to confusion-matrix rows."""
    rated = matrices.select(
        "*",
        rates.precision(F.col("tp"), F.col("fp")).alias("precision"),
        rates.recall(F.col("tp"), F.col("fn")).alias("recall"),
    )
    return rated.withColumn("f1_score", rates.f1(F.col("precision"), F.col("recall")))


def threshold_metrics(
    scored: DataFrame,
    thresholds: Sequence[float],
    score: str = "fraud_score",
    label: str = "label",
    by: Sequence[str] = (),
) -> DataFrame:
    return with_rates(confusion_sweep(scored, thresholds, score, label, by))


def score_points(
    scored: DataFrame, score: str = "fraud_score", label: str = "label", by: Sequence[str] = ()
) -> DataFrame:
    """Positives and negatives per distinct score; equal scores combine before the shuffle."""
    return (
        scored.filter(F.col(score).isNotNull() & F.col(label).isin(0, 1))
        .groupBy(*by, score)
        .agg(
            F.count_if(F.col(label) == 1).alias("positives"),
            F.count_if(F.col(label) == 0).alias("negatives"),
        )
    )


def confusion_at_own_threshold(
    scored: DataFrame,
    chosen: DataFrame,
    by: Sequence[str],
    score: str = "fraud_score",
    label: str = "label",
) -> DataFrame:
    """One matrix per run of ``chosen``, each at the run's own threshold.

    Thresholds are joined to the rows where they lie and the cells summed per run, so a task
    sends one row per run and scores are not shuffled. The stored thresholds, one row a run,
    are counted, and broadcast as long as there are at most ``MOST_BROADCAST_RUNS`` of them. A
    run without rows gets zeros.
    """
    own = materialize(chosen.select(*by, "threshold"), "own-thresholds")
    few = F.broadcast(own) if own.count() <= MOST_BROADCAST_RUNS else own
    reached, positive = F.col(score) >= F.col("threshold"), F.col(label) == 1
    cells = {"tp": reached & positive, "fp": reached & ~positive, "tn": ~reached & ~positive, "fn": ~reached & positive}
    counted = scored.filter(F.col(score).isNotNull() & F.col(label).isin(0, 1))
    found = (
        counted.select(*by, score, label)
        .join(few, list(by))
        .groupBy(*by)
        .agg(*[F.count_if(when).alias(name) for name, when in cells.items()])
    )
    filled = [F.coalesce(name, F.lit(0)).alias(name) for name in cells]
    return own.join(found, list(by), "left").select(*by, "threshold", *filled)
