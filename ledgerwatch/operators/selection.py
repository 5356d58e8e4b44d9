"""Picking a threshold per run, a champion among candidates, the latest of a kind."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwatch.spec import ThresholdPolicy


def choose_threshold(
    metrics: DataFrame, policy: ThresholdPolicy, by: Sequence[str] = ()
) -> DataFrame:
    """The chosen row of each group of :func:`threshold_metrics`.

    With a precision floor: most recall among the rows reaching it (then f1, then
    precision); where none does, and for ``best_f1``: best f1 (then recall, then
    precision). What is still equal goes to the row listed first.
    """
    meets = F.col("precision") >= F.lit(policy.min_precision) if policy.uses_floor else F.lit(False)
    meets = F.coalesce(meets, F.lit(False))
    first = F.when(meets, F.col("recall")).otherwise(F.col("f1_score"))
    second = F.when(meets, F.col("f1_score")).otherwise(F.col("recall"))
    rank = F.struct(
        meets.alias("a"),
        first.alias("b"),
        second.alias("c"),
        F.col("precision").alias("d"),
        (-F.col("position")).alias("e"),
    )
    best = metrics.groupBy(*by).agg(F.max_by(F.struct(*metrics.columns), rank).alias("best"))
    return best.filter(F.col("best").isNotNull()).select("best.*")


def rank_candidates(
    runs: DataFrame, candidate: str = "candidate_id", position: str = "candidate_position"
) -> DataFrame:
    """Mean PR area and mean f1 per candidate, with its place in the configured list."""
    return runs.groupBy(candidate).agg(
        F.avg("auc_pr").alias("mean_auc_pr"),
        F.avg("f1_score").alias("mean_f1"),
        F.min(position).alias(position),
    )


def champion(
    runs: DataFrame, candidate: str = "candidate_id", position: str = "candidate_position"
) -> DataFrame:
    """One row: the candidate with the best mean PR area, then mean f1, then listed first."""
    ranked = rank_candidates(runs, candidate, position)
    order = F.struct(F.col("mean_auc_pr"), F.col("mean_f1"), (-F.col(position)).alias("listed_first"))
    best = ranked.agg(F.max_by(F.struct(*ranked.columns), order).alias("best"))
    return best.filter(F.col("best").isNotNull()).select("best.*")


def mark_selected(runs: DataFrame, champion_id: str, candidate: str = "candidate_id") -> DataFrame:
    return runs.withColumn("selected_candidate", F.col(candidate) == F.lit(champion_id))


def median_threshold(runs: DataFrame) -> DataFrame:
    """Median over runs, halfway between the middle two for an even count."""
    return runs.agg(F.median("threshold").alias("threshold"))


def latest(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """The single row with the greatest ``order_by``; no row for an empty table."""
    newest = df.agg(F.max_by(F.struct(*df.columns), F.struct(*order_by)).alias("newest"))
    return newest.filter(F.col("newest").isNotNull()).select("newest.*")
