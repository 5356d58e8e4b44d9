"""What was in force when a row happened: the latest of a list of versions up to its time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def with_version_in_force(
    rows: DataFrame,
    versions: DataFrame,
    time: str,
    since: str,
    columns: Sequence[str],
    bucket: str = "hour",
) -> DataFrame:
    """``rows`` with ``columns`` of the version whose ``since`` is the latest not after ``time``.

    Rows before the first version, or without a time, get NULLs; of versions with one ``since``
    the largest ``columns`` count. Names in ``columns`` must not be names in ``rows``.

    Rows meet versions by the bucket of their time, an ordinary equality join: a bucket's row
    lists the version in force when it begins and those that begin within it, and a row picks
    from that list. So every row meets one row, whatever the number of versions, and nothing of
    ``rows`` is shuffled while the buckets fit a broadcast, which Spark decides by their size;
    else it is a sort-merge join whose hot buckets Spark splits. The ordered window runs over
    one row per bucket and version, which grows with the span of time alone.
    """
    at = "_bucket"
    start = F.date_trunc(bucket, F.col(time))
    begins = F.struct(F.col(since).cast("timestamp").alias("since"), *[F.col(c) for c in columns])
    known = versions.filter(F.col(since).isNotNull()).select(
        F.date_trunc(bucket, F.col(since)).alias(at), begins.alias("version")
    )
    asked = rows.select(start.alias(at)).filter(F.col(at).isNotNull()).distinct()
    # A bucket's own versions, and the latest of all buckets before.
    own = known.groupBy(at).agg(F.collect_list("version").alias("own"), F.max("version").alias("last"))
    every = own.unionByName(asked, allowMissingColumns=True)
    every = every.groupBy(at).agg(F.max("own").alias("own"), F.max("last").alias("last"))
    before = F.max("last").over(W.orderBy(at).rowsBetween(W.unboundedPreceding, -1))
    none = F.array().cast(every.schema["own"].dataType)
    listed = F.concat(F.coalesce("own", none), F.coalesce(F.array_compact(F.array("before")), none))
    buckets = every.withColumn("before", before).select(F.col(at).alias(f"{at}_of"), listed.alias("_listed"))
    met = rows.withColumn(at, start).join(buckets, F.col(at) == F.col(f"{at}_of"), "left")
    moment = F.col(time).cast("timestamp")
    chosen = F.array_max(F.filter("_listed", lambda v: v["since"] <= moment))
    return met.withColumn("_version", chosen).select(
        *[F.col(f"`{c}`") for c in rows.columns], *[F.col("_version")[c].alias(c) for c in columns]
    )
