"""Stream operators with state, all of it bounded by a watermark."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerwatch.operators.kpi import measures, time_column, with_rate
from ledgerwatch.sources.catalog import layer_tables
from ledgerwatch.sources.writers import start_append
from ledgerwatch.spec import TransactionSpec

# The indicator table of each grain.
STREAMED_TABLES = {"hour": "gold.fraud_kpis_hourly", "day": "gold.fraud_kpis_daily"}


def first_deliveries(rows: DataFrame, key: str, time: str, within: str) -> DataFrame:
    """The first of several rows with one ``key``, in one micro-batch or in several.

    A key is remembered until the watermark, the largest ``time`` so far less ``within``, has
    passed the time of its first row by as much again, so state grows with the rate of arrival,
    not with the stream. ``time`` should be when a row arrived: it never lies behind the
    watermark then, and no row is lost as late. Rows with a NULL key are one key.
    """
    return rows.withWatermark(time, within).dropDuplicatesWithinWatermark([key])


def windowed_kpis(
    scores: DataFrame,
    grain: str,
    late: str,
    timestamp: str = "event_timestamp",
    amount: str = "Amount",
    accuracy: int = 10_000,
) -> DataFrame:
    """The measures of :func:`~ledgerwatch.operators.kpi.kpis` over a stream of scores.

    A period is complete, and comes out once, when the watermark (the newest score's time less
    ``late``) has reached its end. So the newest periods stay open, and a score that arrives
    after its period came out is not counted here; recomputing that day from the stored scores
    (:func:`~ledgerwatch.plans.gold.build_indicators`) counts it. State holds one row, with a
    quantile sketch, per open period. Periods are cut in UTC, like the session's.
    """
    name = time_column(grain)
    kept = scores.select(timestamp, amount, "prediction", "fraud_score").withWatermark(timestamp, late)
    period = F.window(timestamp, f"1 {grain}").alias("period")
    measured = kept.groupBy(period).agg(*measures(amount, accuracy))
    return with_rate(measured).withColumn(name, F.col("period.start")).drop("period")


def start_indicators(
    scores: DataFrame,
    spec: TransactionSpec,
    grain: str,
    late: str,
    checkpoint: str,
    target: str | None = None,
    trigger: Mapping[str, object] | None = None,
) -> StreamingQuery:
    """Append complete periods to the indicator table of the grain, each once."""
    table = layer_tables(spec)[STREAMED_TABLES[grain]]
    rows = table.laid_out(windowed_kpis(scores, grain, late, spec.timestamp, spec.amount))
    return start_append(rows, target or table.name, checkpoint, table.partition_by, trigger)
