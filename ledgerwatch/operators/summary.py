"""Mean and spread of run metrics, and long-format metric tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The metrics a summary reports, by name there and by column here.
SUMMARY_METRICS = {
    "precision": "precision",
    "recall": "recall",
    "f1": "f1_score",
    "auc_pr": "auc_pr",
    "roc_auc": "roc_auc",
    "threshold": "threshold",
}


def long_metrics(df: DataFrame, keep: Sequence[str], metrics: Mapping[str, str]) -> DataFrame:
    """One row per metric: ``metric_name``, ``metric_value``."""
    pairs = [
        F.struct(F.lit(name).alias("metric_name"), F.col(column).cast("double").alias("metric_value"))
        for name, column in metrics.items()
    ]
    return df.select(*keep, F.inline(F.array(*pairs)))


def run_summary(
    runs: DataFrame,
    by: Sequence[str] = ("candidate_id", "split_name"),
    metrics: Mapping[str, str] = SUMMARY_METRICS,
) -> DataFrame:
    """Mean, sample standard deviation (0.0 for a single run) and run count per metric."""
    return (
        long_metrics(runs, by, metrics)
        .groupBy(*by, "metric_name")
        .agg(
            F.avg("metric_value").alias("mean_value"),
            F.coalesce(F.stddev_samp("metric_value"), F.lit(0.0)).alias("sample_stdev"),
            F.count(F.lit(1)).cast("int").alias("runs"),
        )
    )
