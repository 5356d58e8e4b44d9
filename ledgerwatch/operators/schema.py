"""Checks and projections on column lists; no data is read."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame

from ledgerwatch.spec import TransactionSpec


def missing_columns(columns: Iterable[str], spec: TransactionSpec) -> list[str]:
    """Required columns that are absent, case-sensitively, in the spec's order."""
    present = frozenset(columns)
    return [name for name in spec.required if name not in present]


def require_columns(columns: Iterable[str], spec: TransactionSpec) -> None:
    absent = missing_columns(columns, spec)
    if absent:
        raise ValueError(f"Input lacks required columns: {', '.join(absent)}")


def project(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """The table layout: exactly these columns in this order."""
    return df.select(*columns)
