"""Indicators over scored transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwatch.functions.rates import share
from ledgerwatch.functions.scores import score_bucket

# The time column of each indicator table, by grain.
GRAINS = {"hour": "metric_window", "day": "metric_date"}


def kpis(
    scores: DataFrame,
    grain: str,
    timestamp: str = "event_timestamp",
    amount: str = "Amount",
    accuracy: int = 10_000,
) -> DataFrame:
    """Volume, alerts, suspicious amount, mean and 95th-percentile score per hour or day.

    One shuffle on the truncated time. Every measure, the percentile sketch included,
    combines on the map side, so an hour with a third of all rows costs its tasks one
    buffer each. ``accuracy`` is the sketch's: its rank error is 1 / accuracy.
    """
    period = F.date_trunc(grain, F.col(timestamp)).alias(time_column(grain))
    return with_rate(scores.groupBy(period).agg(*measures(amount, accuracy)))


def time_column(grain: str) -> str:
    if grain not in GRAINS:
        raise ValueError(f"Unknown grain {grain!r}; use one of {', '.join(GRAINS)}.")
    return GRAINS[grain]


def measures(amount: str, accuracy: int = 10_000) -> list[Column]:
    """What is measured of each period's scores, in a table or in a stream."""
    alerted = F.col("prediction") == 1
    suspicious = F.sum(F.when(alerted, F.col(amount)).otherwise(F.lit(0.0)))
    return [
        F.count(F.lit(1)).alias("total_transactions"),
        F.sum("prediction").alias("predicted_frauds"),
        suspicious.alias("suspicious_amount"),
        F.avg("fraud_score").alias("avg_fraud_score"),
        F.percentile_approx("fraud_score", 0.95, accuracy).alias("p95_fraud_score"),
    ]


def with_rate(measured: DataFrame) -> DataFrame:
    rate = share(F.col("predicted_frauds"), F.col("total_transactions"))
    return measured.withColumn("predicted_fraud_rate", rate)


def current_scores(
    scores: DataFrame, model_version: str | None = None, key: str = "raw_event_id"
) -> DataFrame:
    """One score per raw event: the latest, of one model version if given.

    The score table holds a row per scoring; without this an event scored twice counts twice.
    The content id is no key for this: genuine repeat transactions share it.
    """
    if model_version is not None:
        scores = scores.filter(F.col("model_version") == model_version)
    rest = [name for name in scores.columns if name not in (key, "scored_at")]
    newest = scores.groupBy(key).agg(F.max(F.struct("scored_at", *rest)).alias("newest"))
    return newest.select(
        *[F.col(key) if name == key else F.col(f"newest.`{name}`") for name in scores.columns]
    )


def alerts(scores: DataFrame) -> DataFrame:
    return scores.filter(F.col("prediction") == 1)


def score_histogram(scores: DataFrame, buckets: int = 10, score: str = "fraud_score") -> DataFrame:
    return (
        scores.groupBy(score_bucket(F.col(score), buckets).alias("score_bucket"))
        .agg(F.count(F.lit(1)).alias("transactions"))
        .orderBy("score_bucket")
    )


def newest_first(indicators: DataFrame, columns: tuple[str, ...] | None = None) -> DataFrame:
    """Dashboard listing of an indicator table, newest period first."""
    time_column = indicators.columns[0]
    listed = columns or (
        time_column,
        "total_transactions",
        "predicted_frauds",
        "predicted_fraud_rate",
        "suspicious_amount",
        "p95_fraud_score",
    )
    return indicators.select(*listed).orderBy(F.desc(time_column))


def riskiest(indicators: DataFrame, top: int, by: Column | None = None) -> DataFrame:
    """The ``top`` periods by alert rate; equal rates go to the earlier period."""
    rate = F.desc("predicted_fraud_rate") if by is None else by
    return indicators.orderBy(rate, F.asc(indicators.columns[0])).limit(top)
