"""Replaying a stored data set as a paced stream of messages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwatch.operators.rowindex import row_slice, with_row_index
from ledgerwatch.sources.readers import TOPIC_SCHEMA
from ledgerwatch.spec import TransactionSpec
from ledgerwatch.streaming.events import encode_events


def replay_batches(
    rows: DataFrame,
    order_by: Sequence[str],
    batch_size: int,
    start_offset: int = 0,
    max_records: int = 0,
) -> DataFrame:
    """Rows from ``start_offset`` on, at most ``max_records`` (0: all), numbered into batches."""
    indexed = with_row_index(rows, order_by)
    kept = row_slice(indexed, start_offset, max_records)
    batch = F.expr(f"(row_index - {int(start_offset)}) div {int(batch_size)}")
    return kept.withColumn("replay_batch", batch)


def write_replay(
    batches: DataFrame,
    spec: TransactionSpec,
    path: str,
    topic: str,
    source_file: str,
    partitions: int = 3,
) -> None:
    """Store the numbered rows as topic messages, one file per batch.

    Messages are spread over topic partitions by key and keep their row number as offset.
    Batches are written side by side, so batches reach a reader whole but in no set order.
    """
    encoded = encode_events(
        batches, spec, source_file, carried=("row_index", "replay_batch")
    )
    (
        encoded.select(
            "key",
            "value",
            F.lit(topic).alias("topic"),
            F.pmod(F.xxhash64("key"), F.lit(partitions)).cast("int").alias("partition"),
            F.col("row_index").alias("offset"),
            "replay_batch",
        )
        .repartition("replay_batch")
        .write.partitionBy("replay_batch")
        .parquet(path)
    )


def replay_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """The stored messages as a stream; with one file per trigger, one batch per trigger.

    The pause between batches is the query's processing-time trigger.
    """
    return (
        spark.readStream.schema(TOPIC_SCHEMA)
        .option("maxFilesPerTrigger", files_per_trigger)
        .option("recursiveFileLookup", "true")
        .parquet(path)
    )
