"""Zero-based row numbers along a global order, and slices of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerwatch.session import scratch_path

# A file's start is some hundred bytes; below this many files all starts fit a broadcast.
MOST_BROADCAST_FILES = 100_000


def with_row_index(df: DataFrame, order_by: Sequence[str], name: str = "row_index") -> DataFrame:
    """Number the rows 0, 1, 2, ... in ``order_by`` order.

    The rows are range-sorted into files once. A row's number is its place in its file
    plus the row counts of the files before it, so the only global window is over one row
    per file. Range sorting by a final unique column lets rows that are equal in
    ``order_by`` spread over files instead of filling one.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "row-index")
    tie = "_arrival"
    (
        df.withColumn(tie, F.monotonically_increasing_id())
        .orderBy(*order_by, tie)
        .drop(tie)
        .write.parquet(path)
    )
    stored = spark.read.schema(df.schema).parquet(path).select(
        "*",
        F.col("_metadata.file_name").alias("_file"),
        F.col("_metadata.row_index").alias("_place"),
    )
    # Files are named part-<task>-<uuid>-c<sequence>; tasks are numbered in sort order.
    task = F.regexp_extract("_file", r"^part-(\d+)-", 1).cast("long")
    sequence = F.regexp_extract("_file", r"[-.]c(\d+)\.", 1).cast("long")
    before = W.orderBy(task, sequence).rowsBetween(W.unboundedPreceding, -1)
    starts = (
        stored.groupBy("_file")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_file", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    )
    if len(stored.inputFiles()) <= MOST_BROADCAST_FILES:
        starts = F.broadcast(starts)
    return stored.join(starts, "_file").select(
        *df.columns, (F.col("_start") + F.col("_place")).alias(name)
    )


def row_slice(indexed: DataFrame, start: int = 0, most: int = 0, name: str = "row_index") -> DataFrame:
    """Skip the first ``start`` rows, then keep ``most`` (0: all the rest)."""
    kept = indexed.filter(F.col(name) >= start)
    return kept.filter(F.col(name) < start + most) if most > 0 else kept
