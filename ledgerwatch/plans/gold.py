"""Indicator tables, exports, layer volumes and the quality report."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwatch.operators.kpi import current_scores, kpis
from ledgerwatch.operators.quality import quality_report
from ledgerwatch.session import materialize
from ledgerwatch.sources.catalog import layer_tables, read_layer, save_layer
from ledgerwatch.sources.writers import export_csv
from ledgerwatch.spec import TransactionSpec

# The table of each grain.
INDICATOR_TABLES = {"hour": "gold.fraud_kpis_hourly", "day": "gold.fraud_kpis_daily"}


def build_indicators(
    scores: DataFrame,
    spec: TransactionSpec,
    targets: Mapping[str, str] | None = None,
    model_version: str | None = None,
    latest_only: bool = True,
) -> None:
    """Recompute hourly and daily indicators; days present in the scores are replaced.

    By default each delivered event counts once, with its latest score: repeat transactions
    share their content id and still count each. The rows kept are stored so that the shuffle
    by event runs once for both grains; ``latest_only=False`` counts every stored scoring.
    """
    tables = layer_tables(spec)
    if latest_only:
        measured = scores.select(
            spec.raw_id,
            "scored_at",
            spec.timestamp,
            spec.amount,
            "fraud_score",
            "prediction",
            "model_version",
        )
        current = current_scores(measured, model_version, spec.raw_id)
        scores = materialize(current.drop(spec.raw_id, "scored_at", "model_version"), "current-scores")
    elif model_version is not None:
        scores = scores.filter(F.col("model_version") == model_version)
    for grain, name in INDICATOR_TABLES.items():
        rows = kpis(scores, grain, spec.timestamp, spec.amount)
        save_layer(rows, tables[name], overwrite=True, target=(targets or {}).get(name))


def export_gold(
    scores: DataFrame, hourly: DataFrame, daily: DataFrame, folder: str
) -> dict[str, str]:
    """CSV folders for dashboards: one file for each indicator table, many for the scores."""
    exports = {
        "fraud_scores": (scores, False),
        "fraud_kpis_hourly": (hourly, True),
        "fraud_kpis_daily": (daily, True),
    }
    paths = {}
    for name, (frame, single_file) in exports.items():
        paths[name] = f"{folder}/{name}"
        export_csv(frame, paths[name], single_file)
    return paths


def write_quality(
    tables: Mapping[str, DataFrame],
    spec: TransactionSpec,
    created_at: str,
    raw_tables: tuple[str, ...] = ("bronze.transactions_raw",),
    target: str | None = None,
) -> None:
    """Append one dated report over all given tables."""
    report = quality_report(tables, spec, created_at, raw_tables)
    save_layer(report, layer_tables(spec)["gold.data_quality_metrics"], target=target)


def indicators(
    spark: SparkSession, spec: TransactionSpec, grain: str, source: str | None = None
) -> DataFrame:
    """A stored indicator table in its declared columns."""
    table = layer_tables(spec)[INDICATOR_TABLES[grain]]
    return read_layer(spark, table, source).select(*table.schema.fieldNames())
