"""Label counts and the balanced weights that follow from them."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwatch.functions.rates import share


class ClassWeights(NamedTuple):
    legit: float
    positive: float


def class_counts(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))


def weights_from_counts(counts: DataFrame, label: str = "label") -> DataFrame:
    """One row: total, per-class counts and weights total / (2 * class count)."""
    per_class = {
        name: F.coalesce(F.sum(F.when(F.col(label) == value, F.col("count"))), F.lit(0))
        for name, value in (("legit_count", 0.0), ("positive_count", 1.0))
    }
    totals = counts.agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("total"),
        *[column.alias(name) for name, column in per_class.items()],
    )
    return totals.select(
        "*",
        share(F.col("total"), 2 * F.col("legit_count")).alias("legit_weight"),
        share(F.col("total"), 2 * F.col("positive_count")).alias("positive_weight"),
    )


def balanced_weights(df: DataFrame, label: str = "label") -> ClassWeights:
    """Run the count and return the two weights (one row reaches the driver)."""
    return checked_weights(class_counts(df, label), label)


def checked_weights(counts: DataFrame, label: str = "label") -> ClassWeights:
    row = weights_from_counts(counts, label).first()
    if row["total"] <= 0:
        raise ValueError("Cannot weight classes of an empty table.")
    if row["legit_count"] <= 0 or row["positive_count"] <= 0:
        raise ValueError("Balanced weights need at least one row of each class.")
    return ClassWeights(row["legit_weight"], row["positive_weight"])
