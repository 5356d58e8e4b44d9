"""Chronological train / validation / test blocks."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwatch.operators.quantiles import approximate_quantiles, exact_quantiles
from ledgerwatch.spec import SplitFractions, TransactionSpec

TRAIN, VALIDATION, TEST = "train", "validation", "test"
BLOCKS = (TRAIN, VALIDATION, TEST)


class TimeCuts(NamedTuple):
    validation_from: float
    test_from: float


def time_cuts(
    df: DataFrame,
    spec: TransactionSpec,
    fractions: SplitFractions,
    error: float = 1e-4,
    exact: bool = False,
) -> TimeCuts:
    """The two times at which the next block begins (two numbers reach the driver)."""
    if exact:
        found = exact_quantiles(df, spec.time, fractions.quantiles).orderBy("share").collect()
        values = [row["value"] for row in found]
    else:
        values = approximate_quantiles(df, spec.time, fractions.quantiles, error)
    if len(values) < 2 or None in values or values[0] >= values[1]:
        raise ValueError(f"Times do not separate into three blocks; cut points were {values}.")
    return TimeCuts(float(values[0]), float(values[1]))


def with_block(df: DataFrame, spec: TransactionSpec, cuts: TimeCuts) -> DataFrame:
    """Name each row's block. A row exactly at a cut belongs to the later block."""
    at = F.col(spec.time)
    block = (
        F.when(at < F.lit(cuts.validation_from), TRAIN)
        .when(at < F.lit(cuts.test_from), VALIDATION)
        .when(at >= F.lit(cuts.test_from), TEST)
    )
    return df.withColumn("block", block).filter(F.col("block").isNotNull())


def time_range(df: DataFrame, spec: TransactionSpec, start: float | None, end: float | None) -> DataFrame:
    """Rows with start <= time < end; an open side is None."""
    if start is not None:
        df = df.filter(F.col(spec.time) >= F.lit(start))
    if end is not None:
        df = df.filter(F.col(spec.time) < F.lit(end))
    return df


def block_counts(blocks: DataFrame, label: str = "label") -> DataFrame:
    return blocks.groupBy("block", label).agg(F.count(F.lit(1)).alias("count"))


def check_blocks(counts: DataFrame, label: str = "label") -> dict[str, int]:
    """Rows per block; an empty block or one without both labels is an error.

    ``counts`` comes from :func:`block_counts` over rows labelled 0 or 1, so at most six
    rows reach the driver.
    """
    found = {
        (row["block"], int(row[label])): row["count"]
        for row in counts.filter(F.col(label).isin(0.0, 1.0)).collect()
    }
    rows = {block: found.get((block, 0), 0) + found.get((block, 1), 0) for block in BLOCKS}
    empty = [block for block in BLOCKS if rows[block] == 0]
    if empty:
        raise ValueError(f"The chronological split left blocks without rows: {', '.join(empty)}")
    one_sided = [b for b in BLOCKS if not (found.get((b, 0), 0) and found.get((b, 1), 0))]
    if one_sided:
        raise ValueError(f"Blocks without both labels: {', '.join(one_sided)}")
    return rows
