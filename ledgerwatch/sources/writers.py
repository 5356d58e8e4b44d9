"""Batch and stream outputs that can be run again without duplicating rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


# Ids in hex are half of most rows; zstd halves them, the default codec leaves them as they are.
STORED_CODEC = "zstd"
# Of messages in files: an event's JSON text names every field and holds its id twice.
MESSAGE_CODECS = {"json": "gzip", "csv": "gzip", "parquet": STORED_CODEC, "orc": STORED_CODEC}


def append(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path, compression=STORED_CODEC)


def replace_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Overwrite only the partitions present in ``df``."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path, compression=STORED_CODEC)
    )


def leaf_folder(path: str, keys: Mapping[str, str | int]) -> str:
    return "/".join([path.rstrip("/"), *[f"{name}={value}" for name, value in keys.items()]])


def replace_leaf(df: DataFrame, path: str, keys: Mapping[str, str | int]) -> None:
    """Overwrite the one partition folder named by ``keys``.

    The keys are constants of the whole frame, so they name the folder instead of being
    columns. A failed and repeated write leaves exactly the last attempt.
    """
    df.drop(*keys).write.mode("overwrite").parquet(leaf_folder(path, keys), compression=STORED_CODEC)


def insert_into(df: DataFrame, table: str, overwrite: bool = False) -> None:
    """Write to a catalog table, columns matched by name.

    With ``overwrite`` and dynamic partition overwrite (set by ``build_session``) only
    the partitions present in ``df`` are replaced.
    """
    ordered = df.select(*df.sparkSession.table(table).columns)
    ordered.write.insertInto(table, overwrite=overwrite)


def as_messages(df: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """key / value rows for a topic; NULL fields are left out of the JSON text."""
    return df.select(
        F.col(key).cast("string").alias("key"),
        F.to_json(F.struct(*[F.col(name) for name in columns])).alias("value"),
    )


def write_messages(
    messages: DataFrame, sink_format: str, options: Mapping[str, str], mode: str = "append"
) -> None:
    """Send key / value rows to a topic, or to files of any format, compressed unless told how."""
    codec = MESSAGE_CODECS.get(sink_format.lower())
    chosen = {**({"compression": codec} if codec else {}), **options}
    messages.write.format(sink_format).options(**chosen).mode(mode).save()


def export_csv(df: DataFrame, path: str, single_file: bool = False) -> None:
    """CSV with a header line, replacing an earlier export.

    ``single_file`` is for small aggregates. It repartitions rather than coalesces, so
    that only the finished rows meet in one task and the aggregation before stays parallel.
    """
    out = df.repartition(1) if single_file else df
    out.write.mode("overwrite").option("header", True).csv(path)


def start_append(
    stream: DataFrame,
    target: str,
    checkpoint: str,
    partition_by: Sequence[str] = (),
    trigger: Mapping[str, object] | None = None,
    sink_format: str = "parquet",
    name: str | None = None,
) -> StreamingQuery:
    """Append a stream to a folder or catalog table, exactly once per checkpoint.

    ``target`` with a slash is a folder. Without a trigger the next micro-batch starts as
    soon as the last one is done.
    """
    writer = (
        stream.writeStream.format(sink_format)
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if trigger:
        writer = writer.trigger(**trigger)
    if name:
        writer = writer.queryName(name)
    return writer.start(target) if "/" in target else writer.toTable(target)
