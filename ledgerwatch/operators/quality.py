"""Data-quality metrics in long format: table, metric, dimension, value."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwatch.operators.classes import class_counts
from ledgerwatch.operators.duplicates import repeated_id_count
from ledgerwatch.operators.schema import missing_columns
from ledgerwatch.spec import TransactionSpec


def _metric(name: str, dimension: Column, value: Column) -> Column:
    return F.struct(
        F.lit(name).alias("metric_name"),
        dimension.cast("string").alias("metric_dimension"),
        value.cast("double").alias("metric_value"),
    )


def null_counts(df: DataFrame) -> DataFrame:
    """``row_count`` and one ``null_count`` row per column, from a single pass."""
    nulls = [F.count_if(F.col(f"`{name}`").isNull()).alias(f"nulls_{i}") for i, name in enumerate(df.columns)]
    counted = df.agg(F.count(F.lit(1)).alias("row_count"), *nulls)
    rows = [_metric("row_count", F.lit("*"), F.col("row_count"))]
    rows += [
        _metric("null_count", F.lit(name), F.col(f"nulls_{i}")) for i, name in enumerate(df.columns)
    ]
    return counted.select(F.inline(F.array(*rows)))


def duplicate_ids(df: DataFrame, key: str) -> DataFrame:
    """How many ids have more than one row."""
    found = repeated_id_count(df, key)
    row = _metric("duplicate_transaction_id", F.lit(key), F.col("duplicate_ids"))
    return found.select(row.alias("m")).select("m.*")


def class_distribution(df: DataFrame, label_source: str) -> DataFrame:
    """Rows per class value; a missing class shows as ``None``."""
    value = F.col(label_source)
    shown = F.when(value.isNull(), "None").otherwise(value.cast("string"))
    rows = class_counts(df, label_source)
    return rows.select(_metric("class_distribution", shown, F.col("count")).alias("m")).select("m.*")


def missing_required(df: DataFrame, spec: TransactionSpec) -> DataFrame:
    absent = missing_columns(df.columns, spec)
    row = (
        "schema_missing_required_columns",
        ",".join(absent) or "none",
        float(len(absent)),
    )
    return df.sparkSession.createDataFrame(
        [row], "metric_name string, metric_dimension string, metric_value double"
    )


def quality_report(
    tables: Mapping[str, DataFrame],
    spec: TransactionSpec,
    created_at: str,
    raw_tables: Iterable[str] = (),
) -> DataFrame:
    """All metrics of all tables.

    Per table: one pass for row and null counts, one over the id column alone, one over
    the class column alone. The schema check is added for ``raw_tables`` only.
    """
    raw = frozenset(raw_tables)
    parts = []
    for table_name, df in tables.items():
        metrics = [null_counts(df)]
        if spec.id in df.columns:
            metrics.append(duplicate_ids(df, spec.id))
        if spec.label_source in df.columns:
            metrics.append(class_distribution(df, spec.label_source))
        if table_name in raw:
            metrics.append(missing_required(df, spec))
        parts += [part.withColumn("table_name", F.lit(table_name)) for part in metrics]
    return (
        reduce(DataFrame.unionByName, parts)
        .withColumn("created_at", F.lit(created_at))
        .select("table_name", "metric_name", "metric_dimension", "metric_value", "created_at")
    )
