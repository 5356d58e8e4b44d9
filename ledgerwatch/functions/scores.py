"""From model output vectors to a score, a decision and a histogram bucket."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column
from pyspark.sql import functions as F


def vector_item(vector: Column, index: int = 1) -> Column:
    """Element of an ML vector, 0.0 where the vector is NULL (tested first: the
    conversion itself does not accept NULL)."""
    return F.when(vector.isNull(), F.lit(0.0)).otherwise(vector_to_array(vector)[index])


def margin_probability(raw: Column) -> Column:
    """Probability of class 1 from a boosted model's margin: 1 / (1 + exp(-2 m)).

    The boosted model's own probability column holds the same number; this form is for
    stored margins.
    """
    return F.when(raw.isNull(), F.lit(0.0)).otherwise(
        1.0 / (1.0 + F.exp(-2.0 * vector_to_array(raw)[1]))
    )


def ensemble(*probabilities: Column) -> Column:
    total = probabilities[0]
    for extra in probabilities[1:]:
        total = total + extra
    return total / F.lit(float(len(probabilities)))


def decide(score: Column, threshold: float | Column) -> Column:
    """1 where the score reaches the threshold (inclusive), else 0; NULL stays NULL."""
    limit = threshold if isinstance(threshold, Column) else F.lit(float(threshold))
    return (score >= limit).cast("int")


def score_bucket(score: Column, buckets: int = 10) -> Column:
    """Equal-width bucket of a score in [0, 1): 1 .. buckets, 0 below, buckets + 1 from 1.0 up."""
    return F.width_bucket(score, F.lit(0.0), F.lit(1.0), F.lit(int(buckets)))
