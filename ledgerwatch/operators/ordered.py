"""Running totals along a global order without a single-task window.

A window ordered over a whole table runs in one task. Here the rows, already one per
distinct order value, are cut into value ranges of about equal size; each range keeps a
window of its own, and the sums of the ranges before it are added as an offset.
"""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil, isfinite

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ROWS_PER_RANGE = 1_000_000
WORTH_A_RANGE = 50_000  # fewer rows are summed up sooner than a task starts
RANGE_COLUMN = "_range"


def _with_range(points: DataFrame, order: str, rows_per_range: int) -> DataFrame | None:
    """Number value ranges so that a higher number always means higher values. There are as
    many as the shuffle has partitions, fewer where they would be tiny, or more where they
    would hold too many rows. None where one range is enough: no offsets are to be joined."""
    parts, rows = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions")), points.count()
    ranges = max(ceil(rows / rows_per_range), min(parts, ceil(rows / WORTH_A_RANGE)))
    if ranges < 2:
        return None
    shares = [step / ranges for step in range(1, ranges)]
    cuts = sorted(set(points.approxQuantile(order, shares, 1.0 / (4 * ranges))))
    inner = [cut for cut in cuts if isfinite(cut)]
    if not inner:  # one value, or none
        return None
    edges = [float("-inf"), *inner, float("inf")]
    cutter = Bucketizer(splits=edges, inputCol=order, outputCol=RANGE_COLUMN, handleInvalid="keep")
    return cutter.transform(points)


def running_totals(
    points: DataFrame,
    order: str,
    measures: Sequence[str],
    by: Sequence[str] = (),
    descending: bool = False,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Add ``cum_<measure>``: the sum of the measure up to and including this row.

    ``points`` must be a stored table (it is read more than once) with one row per
    (``by``, ``order``) and no NULL in either. ``by`` groups may be as uneven as they
    like; the ranges, not the groups, decide how the work is spread.
    """
    direction = F.desc if descending else F.asc
    ranged = _with_range(points, order, rows_per_range)
    if ranged is None:
        alone = W.partitionBy(*by).orderBy(direction(order)).rowsBetween(W.unboundedPreceding, W.currentRow)
        sums = [F.sum(m).over(alone).alias(f"cum_{m}") for m in measures]
        return points.dropna(subset=list(by)).select("*", *sums) if by else points.select("*", *sums)
    keys = [*by, RANGE_COLUMN]
    inside = (
        W.partitionBy(*keys).orderBy(direction(order)).rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    within = {m: F.sum(m).over(inside) for m in measures}
    earlier = (
        W.partitionBy(*by).orderBy(direction(RANGE_COLUMN)).rowsBetween(W.unboundedPreceding, -1)
    )
    offsets = (
        ranged.groupBy(*keys)
        .agg(*[F.sum(m).alias(m) for m in measures])
        .select(
            *keys,
            *[F.coalesce(F.sum(m).over(earlier), F.lit(0)).alias(f"before_{m}") for m in measures],
        )
    )
    windowed = ranged.select("*", *[within[m].alias(f"within_{m}") for m in measures])
    return windowed.join(offsets, keys).select(
        *points.columns,
        *[(F.col(f"before_{m}") + F.col(f"within_{m}")).alias(f"cum_{m}") for m in measures],
    )
