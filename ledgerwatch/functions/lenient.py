"""Casts that turn bad text into NULL instead of failing the job.

Spark 4 runs in ANSI mode, where a plain cast of bad text raises. Input from outside
goes through these functions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_double(value: Column) -> Column:
    return value.try_cast("double")


def filled_double(value: Column, default: float = 0.0) -> Column:
    """The number, or ``default`` where it is NULL, NaN or not a number at all."""
    return F.coalesce(F.nanvl(to_double(value), F.lit(None).cast("double")), F.lit(float(default)))


def to_timestamp_or(value: Column, fallback: Column | None = None) -> Column:
    """Parsed event time; ``fallback`` (default: now) where the text is missing or unreadable."""
    instead = F.current_timestamp() if fallback is None else fallback
    return F.coalesce(F.try_to_timestamp(value.cast("string")), instead)


def blank_to_null(value: Column) -> Column:
    return F.nullif(value, F.lit(""))


def strict_double(text: Column, name: str) -> Column:
    """A number from text; blank is NULL, anything else unreadable stops the job."""
    number = text.try_cast("double")
    complaint = F.raise_error(F.concat(F.lit(f"Column {name} holds a non-numeric value: "), text))
    return (
        F.when(text.isNull() | (text == ""), F.lit(None).cast("double"))
        .when(number.isNull(), complaint.cast("double"))
        .otherwise(number)
    )
