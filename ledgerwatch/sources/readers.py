"""Batch and stream inputs. Formats are arguments: a topic is one more format."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ledgerwatch.operators.schema import require_columns
from ledgerwatch.spec import TransactionSpec

# The columns a topic source delivers, and a stored copy of a topic must hold.
TOPIC_SCHEMA = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("topic", T.StringType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
    ]
)


def topic_options(servers: str, topic: str, starting: str = "earliest") -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": starting}


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """A catalog table by name, or a parquet folder by path."""
    return spark.read.parquet(name) if "/" in name else spark.table(name)


def read_csv(spark: SparkSession, path: str, spec: TransactionSpec) -> DataFrame:
    """A headed CSV file as text columns, after its header is checked.

    Values stay text: the id of a row is taken from what the file says. No type
    inference, so the only early read is the header line.
    """
    rows = spark.read.option("header", True).csv(path)
    require_columns(rows.columns, spec)
    return rows


def read_stream(
    spark: SparkSession,
    source_format: str,
    options: Mapping[str, str] | None = None,
    schema: T.StructType | None = None,
    path: str | None = None,
) -> DataFrame:
    """A stream from any source format; file formats need ``schema`` and ``path``."""
    reader = spark.readStream.format(source_format).options(**dict(options or {}))
    if schema is not None:
        reader = reader.schema(schema)
    return reader.load(path) if path else reader.load()


def stream_table(
    spark: SparkSession, name: str, schema: T.StructType | None = None, files_per_trigger: int = 0
) -> DataFrame:
    """A table as a stream of its appended rows."""
    reader = spark.readStream
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if "/" not in name:
        return reader.table(name)
    return reader.schema(schema or spark.read.parquet(name).schema).parquet(name)
