"""Registered queries over streams with state, and over what streams report of themselves."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindings import views
from bindings.queries import ONCE, _shown, query
from bindings.views import EVENTS, wall_clock
from ledgerwatch.session import materialize, scratch_path
from ledgerwatch.sources.catalog import layer_tables, read_layer
from ledgerwatch.sources.readers import TOPIC_SCHEMA, read_stream
from ledgerwatch.streaming.events import start_bronze
from ledgerwatch.streaming.progress import ProgressTable, progress_of
from ledgerwatch.streaming.stateful import start_indicators

SLICES = 3
LATE = "2 hours"


def _by_time(rows: DataFrame, time: str) -> list[DataFrame]:
    """The rows in three slices that follow each other, as a stream would bring them."""
    low, high = rows.agg(F.min(time), F.max(time)).first()
    cuts = [low + (high - low) * k / SLICES for k in range(1, SLICES)]
    place = sum(((F.col(time) >= F.lit(c)).cast("int") for c in cuts), F.lit(0))
    return [rows.filter(place == k) for k in range(SLICES)]


@query
def stream_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly indicators of a stream of scores that is stopped and started again after each
    third of the month: the hours that are complete, two hours behind the newest score."""
    base = scratch_path(spark, "stream-kpis")
    scores = materialize(views.scores(spark, sf_dir), "scores")
    for part in _by_time(scores, "event_timestamp"):
        part.write.mode("append").parquet(f"{base}/scores")
        stream = read_stream(spark, "parquet", {}, scores.schema, f"{base}/scores")
        start_indicators(stream, EVENTS, "hour", LATE, f"{base}/checkpoint", f"{base}/hourly", ONCE).awaitTermination()
    table = layer_tables(EVENTS)["gold.fraud_kpis_hourly"]
    return _shown(read_layer(spark, table, f"{base}/hourly").select(*table.schema.fieldNames()))


@query
def stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of which every third is delivered again at once and every other one in a later
    micro-batch, after a restart: the raw layer holds each once."""
    base = scratch_path(spark, "stream-once")
    sent = materialize(views.messages(spark, sf_dir), "messages")
    first = sent.unionByName(sent.filter(F.col("offset") % 3 == 0))
    at = F.lit(views.INGESTED_AT).cast("timestamp")
    for part in (first, sent.filter(F.col("offset") % 2 == 0)):
        part.write.mode("append").parquet(f"{base}/topic")
        stream = read_stream(spark, "parquet", {}, TOPIC_SCHEMA, f"{base}/topic")
        started = start_bronze(
            stream, EVENTS, f"{base}/bronze", f"{base}/checkpoint", ONCE, once_within=LATE, ingested_at=at
        )
        started.awaitTermination()
    stored = read_layer(spark, layer_tables(EVENTS)["bronze.transactions_raw"], f"{base}/bronze")
    return wall_clock(stored.drop("ingestion_date"))


@query
def stream_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the micro-batches of a raw-layer stream report, beside what the layer then holds.
    Every fifth message is cut off, and the stream is started again in between."""
    base = scratch_path(spark, "stream-progress")
    sent = views.messages(spark, sf_dir)
    broken = F.when(F.col("offset") % 5 == 0, F.substring("value", 1, 20)).otherwise(F.col("value"))
    sent = materialize(sent.withColumn("value", broken), "messages")
    name = f"raw-{uuid.uuid4().hex}"
    listener = ProgressTable(spark, f"{base}/progress", (name,))
    spark.streams.addListener(listener)
    at = F.lit(views.INGESTED_AT).cast("timestamp")
    try:
        for rest in (0, 1):
            sent.filter(F.col("offset") % 2 == rest).write.mode("append").parquet(f"{base}/topic")
            stream = read_stream(spark, "parquet", {}, TOPIC_SCHEMA, f"{base}/topic")
            started = start_bronze(
                stream, EVENTS, f"{base}/bronze", f"{base}/checkpoint", ONCE, ingested_at=at, name=name
            )
            started.awaitTermination()
        spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty(60_000)
    finally:
        spark.streams.removeListener(listener)
    stored = read_layer(spark, layer_tables(EVENTS)["bronze.transactions_raw"], f"{base}/bronze")
    held = stored.agg(F.count(F.lit(1)).alias("stored_rows"), F.count_if(F.col("transaction_id").isNull()).alias("stored_empty"))
    reported = progress_of(spark, f"{base}/progress").agg(
        F.count(F.lit(1)).alias("batches"),
        F.sum("rows").alias("reported_rows"),
        F.sum("unparsed").alias("reported_unparsed"),
        F.max("partitions").alias("partitions"),
        F.min("first_offset").alias("first_offset"),
        F.max("last_offset").alias("last_offset"),
        F.max("newest_event").alias("newest_event"),
        F.min("lag_seconds").alias("least_lag"),
    )
    both = reported.unionByName(held, allowMissingColumns=True)
    return wall_clock(both.agg(*[F.max(name).alias(name) for name in both.columns]))
