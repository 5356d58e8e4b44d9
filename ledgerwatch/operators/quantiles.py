"""Quantiles that name an actual value of the column."""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction
from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwatch.operators.ordered import ROWS_PER_RANGE, running_totals
from ledgerwatch.session import materialize


def approximate_quantiles(
    df: DataFrame, column: str, shares: Sequence[float], error: float = 1e-4
) -> list[float]:
    """Within ``error`` of the asked rank; one pass, a sketch of bounded size to the driver."""
    return df.approxQuantile(column, [float(share) for share in shares], error)


SKETCH_ERROR = 1e-4
WORTH_A_SKETCH = 200_000  # fewer rows are counted value by value at once


def _near_ranks(
    rows: DataFrame, column: str, ranks: Sequence[int], total: int
) -> tuple[Column, list[Column], list[int]] | None:
    """Which rows lie near the ranks; for each rank, what starts its span of values and how many
    of the other rows lie below that.

    The spans come from a sketch and are checked by counting. None where the sketch missed a
    rank (it leaves NaN out, which ranks last).
    """
    around = [rank / total + side * 2 * SKETCH_ERROR for rank in ranks for side in (-1, 1)]
    found = rows.approxQuantile(column, [min(1.0, max(0.0, share)) for share in around], SKETCH_ERROR)
    if not found:
        return None
    value, spans = F.col(column), list(zip(found[::2], found[1::2]))
    near = reduce(Column.__or__, [value.between(low, high) for low, high in spans])
    checks = [(value < low, value <= high, ~near & (value < low)) for low, high in spans]
    counts = rows.agg(*[F.count_if(each) for check in checks for each in check]).first()
    if not all(counts[3 * i] < rank <= counts[3 * i + 1] for i, rank in enumerate(ranks)):
        return None
    return near, [value >= low for low, _ in spans], list(counts[2::3])


def exact_quantiles(
    df: DataFrame,
    column: str,
    shares: Sequence[float],
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """The smallest value at or below which at least that share of the rows lies.

    Spark's own exact percentile keeps all distinct values of a group in one task. This
    counts per value first, then sums the counts along the order range by range. In a large
    table only values near the asked ranks are counted one by one: a sketch tells which these
    are, and the rows that lie below them are counted as a whole.
    """
    rows = df.filter(F.col(column).isNotNull())
    total = rows.count()
    # Whole-number ranks, so that no rounding of share * total moves a cut by one row.
    ranks = [max(1, ceil(Fraction(str(float(share))) * total)) for share in shares]
    found = _near_ranks(rows, column, ranks, total) if total >= WORTH_A_SKETCH else None
    near, from_low, below = found or (F.lit(True), [F.lit(True)] * len(ranks), [0] * len(ranks))
    counted = rows.filter(near).groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
    points = materialize(counted, "quantile-points")
    running = running_totals(points, column, ["rows"], rows_per_range=rows_per_range)
    reached = [
        F.min(F.when(from_low[i] & (F.col("cum_rows") + below[i] >= F.lit(rank)), F.col(column))).alias(f"q{i}")
        for i, rank in enumerate(ranks)
    ]
    pairs = [
        F.struct(F.lit(float(share)).alias("share"), F.col(f"q{i}").alias("value"))
        for i, share in enumerate(shares)
    ]
    return running.agg(*reached).select(F.inline(F.array(*pairs)))
