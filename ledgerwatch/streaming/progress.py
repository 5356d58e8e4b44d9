"""How far a stream is: what each micro-batch held, as rows of a table."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

OBSERVED = "delivered"

PROGRESS_SCHEMA = T.StructType(
    [
        T.StructField("stream", T.StringType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("finished_at", T.TimestampType()),
        T.StructField("rows", T.LongType()),
        T.StructField("unparsed", T.LongType()),
        T.StructField("partitions", T.LongType()),
        T.StructField("first_offset", T.LongType()),
        T.StructField("last_offset", T.LongType()),
        T.StructField("newest_event", T.TimestampType()),
        T.StructField("lag_seconds", T.DoubleType()),
    ]
)


def observed(
    rows: DataFrame, partition: str, offset: str, newest: Column, ingested: Column, unparsed: Column
) -> DataFrame:
    """The rows as they are; each micro-batch's counts are taken while it runs, without a pass
    of their own. ``lag_seconds`` is how long the newest event took to arrive."""
    return rows.observe(
        OBSERVED,
        F.count(F.lit(1)).alias("rows"),
        F.count_if(unparsed).alias("unparsed"),
        F.approx_count_distinct(partition).alias("partitions"),
        F.min(offset).alias("first_offset"),
        F.max(offset).alias("last_offset"),
        F.unix_micros(F.max(newest)).alias("newest_micros"),
        F.unix_micros(F.max(ingested)).alias("ingested_micros"),
    )


class ProgressTable(StreamingQueryListener):
    """Appends a row per micro-batch of the streams named in ``streams`` to a folder.

    Listeners hear of a batch after it is committed. If the driver stops in between, the row of
    that batch is missing; a batch that is run again reports again. ``progress_of`` keeps the
    last report of a batch, and missing numbers show where one was lost.
    """

    def __init__(self, spark: SparkSession, path: str, streams: tuple[str, ...]):
        self._spark, self._path, self._streams = spark, path, streams

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        found = progress.observedMetrics.get(OBSERVED)
        if progress.name not in self._streams or found is None or not found["rows"]:
            return
        newest, ingested = found["newest_micros"], found["ingested_micros"]
        lag = (ingested - newest) / 1e6 if newest is not None and ingested is not None else None
        row = (
            progress.name,
            progress.batchId,
            datetime.fromisoformat(progress.timestamp.replace("Z", "+00:00")),
            found["rows"],
            found["unparsed"],
            found["partitions"],
            found["first_offset"],
            found["last_offset"],
            None if newest is None else datetime.fromtimestamp(newest / 1e6).astimezone(),
            lag,
        )
        one = self._spark.createDataFrame([row], PROGRESS_SCHEMA)
        one.coalesce(1).write.mode("append").parquet(self._path)


def progress_of(spark: SparkSession, path: str) -> DataFrame:
    """One row per stream and micro-batch: its last report."""
    reports = spark.read.schema(PROGRESS_SCHEMA).parquet(path)
    names = [n for n in PROGRESS_SCHEMA.fieldNames() if n not in ("stream", "batch_id")]
    last = reports.groupBy("stream", "batch_id").agg(F.max(F.struct(*names)).alias("last"))
    return last.select("stream", "batch_id", "last.*")
