"""Ratios over counts; a zero denominator gives 0.0, also under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def share(part: Column, whole: Column) -> Column:
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole.cast("double"))


def precision(tp: Column, fp: Column) -> Column:
    return share(tp, tp + fp)


def recall(tp: Column, fn: Column) -> Column:
    return share(tp, tp + fn)


def f1(precision_value: Column, recall_value: Column) -> Column:
    return share(2.0 * precision_value * recall_value, precision_value + recall_value)
