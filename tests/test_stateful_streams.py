from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from ledgerwatch.operators.kpi import kpis
from ledgerwatch.sources.catalog import layer_tables, read_layer
from ledgerwatch.sources.readers import TOPIC_SCHEMA, read_stream
from ledgerwatch.spec import TransactionSpec
from ledgerwatch.streaming.events import start_bronze
from ledgerwatch.streaming.progress import ProgressTable, progress_of
from ledgerwatch.streaming.stateful import first_deliveries, start_indicators, windowed_kpis

ONCE = {"availableNow": True}
SPEC = TransactionSpec(features=("Time", "Amount"))
START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCORED = "event_timestamp timestamp, Amount double, prediction int, fraud_score double"


@pytest.fixture
def score_stream(spark, folder):
    """Adds scores (minutes after the start, score) to a source; a run takes all that is new."""
    base = folder("stream")

    def feed(rows, late="1 hour", grain="hour"):
        data = [(START + timedelta(minutes=m), 10.0, int(s >= 0.5), s) for m, s in rows]
        if data:
            spark.createDataFrame(data, SCORED).coalesce(1).write.mode("append").parquet(f"{base}/scores")
        stream = read_stream(spark, "parquet", {}, spark.read.schema(SCORED).parquet(f"{base}/scores").schema, f"{base}/scores")
        start_indicators(stream, SPEC, grain, late, f"{base}/check", f"{base}/out", ONCE).awaitTermination()
        name = {"hour": "gold.fraud_kpis_hourly", "day": "gold.fraud_kpis_daily"}[grain]
        table = layer_tables(SPEC)[name]
        out = read_layer(spark, table, f"{base}/out").orderBy(table.dated_by).collect()
        return [(int((r[0].replace(tzinfo=timezone.utc) - START).total_seconds() // 3600), r[1], r[2], round(r[5], 3)) for r in out]

    return feed


def test_hours_come_out_once_when_the_watermark_passes(score_stream):
    assert score_stream([(5, 0.2), (50, 0.9), (70, 0.4)]) == []
    # 130 minutes less an hour is past the end of hour 0; hour 1 is still open.
    assert score_stream([(130, 0.6), (55, 0.7)]) == [(0, 3, 2, 0.9)]
    # Hour 0 is gone: what still arrives for it is too late, and adds no second row.
    assert score_stream([(10, 0.99), (75, 0.8), (185, 0.1)]) == [(0, 3, 2, 0.9), (1, 2, 1, 0.8)]


def test_a_restart_without_new_rows_changes_nothing(score_stream):
    first = score_stream([(5, 0.2), (300, 0.3)])
    assert first == [(0, 1, 0, 0.2)] == score_stream([])


def test_days(score_stream):
    assert score_stream([(5, 0.6), (24 * 60 + 30, 0.1), (26 * 60, 0.2)], grain="day") == [(0, 1, 1, 0.6)]


def test_measures_equal_those_of_a_table(spark):
    rows = spark.range(5_000).select(
        (F.lit(START).cast("timestamp") + F.make_interval(mins=(F.col("id") * 7 % 4000).cast("int"))).alias("event_timestamp"),
        (F.col("id") % 97).cast("double").alias("Amount"),
        (F.col("id") % 5 == 0).cast("int").alias("prediction"),
        (F.xxhash64("id") % 1000 / 1000.0).alias("fraud_score"),
    )
    a, b = kpis(rows, "hour"), windowed_kpis(rows, "hour", "1 hour").select(*kpis(rows, "hour").columns)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    with pytest.raises(ValueError, match="Unknown grain"):
        windowed_kpis(rows, "week", "1 hour")


def test_deliveries_again_are_forgotten_after_their_time(spark, folder):
    base = folder("again")
    schema = "k string, at timestamp, n int"

    def feed(rows):
        data = [(k, START + timedelta(minutes=m), i) for i, (k, m) in enumerate(rows)]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(f"{base}/in")
        stream = first_deliveries(spark.readStream.schema(schema).parquet(f"{base}/in"), "k", "at", "1 hour")
        query = stream.writeStream.format("parquet").option("checkpointLocation", f"{base}/check").trigger(**ONCE).start(f"{base}/out")
        query.awaitTermination()
        state = [s.numRowsTotal for p in query.recentProgress for s in p.stateOperators]
        return sorted(r.k or "" for r in spark.read.schema(schema).parquet(f"{base}/out").collect()), state[-1]

    assert feed([("a", 0), ("a", 0), ("b", 1), (None, 2), (None, 2)]) == (["", "a", "b"], 3)
    assert feed([("a", 30), ("c", 40)])[0] == ["", "a", "b", "c"]
    # Three hours on every key is forgotten: state is bounded, and "a" counts as new.
    out, state = feed([("d", 240)])
    assert out == ["", "a", "b", "c", "d"] and state == 1
    assert feed([("a", 250)])[0] == ["", "a", "a", "b", "c", "d"]


def test_progress_rows_follow_micro_batches(spark, folder):
    base = folder("progress")
    listener = ProgressTable(spark, f"{base}/progress", ("told",))
    spark.streams.addListener(listener)
    sent = [
        [("k", '{"transaction_id": "a", "event_time": "2024-01-01T00:00:30Z"}', "t", 0, 5), ("k", "no", "t", 1, 9)],
        [("k", '{"transaction_id": "b", "event_time": "never"}', "t", 0, 6)],
    ]
    try:
        for name, batches in (("told", sent), ("untold", sent[:1])):
            for rows in batches:
                spark.createDataFrame(rows, TOPIC_SCHEMA).coalesce(1).write.mode("append").parquet(f"{base}/{name}")
                stream = read_stream(spark, "parquet", {}, TOPIC_SCHEMA, f"{base}/{name}")
                at = F.lit(START + timedelta(minutes=1)).cast("timestamp")
                start_bronze(stream, SPEC, f"{base}/out-{name}", f"{base}/check-{name}", ONCE, ingested_at=at, name=name).awaitTermination()
        spark._jsparkSession.sparkContext().listenerBus().waitUntilEmpty(60_000)
    finally:
        spark.streams.removeListener(listener)
    got = progress_of(spark, f"{base}/progress").orderBy("batch_id").collect()
    shown = [(r.stream, r.batch_id, r.rows, r.unparsed, r.partitions, r.first_offset, r.last_offset, r.lag_seconds) for r in got]
    assert shown == [("told", 0, 2, 1, 2, 5, 9, 30.0), ("told", 1, 1, 0, 1, 6, 6, None)]
    stored = read_layer(spark, layer_tables(SPEC)["bronze.transactions_raw"], f"{base}/out-told")
    assert stored.count() == sum(r.rows for r in got) and "_unparsed" not in stored.columns
    # A batch that is reported again counts once.
    again = spark.read.parquet(f"{base}/progress").collect()
    spark.createDataFrame(again, spark.read.parquet(f"{base}/progress").schema).write.mode("append").parquet(f"{base}/progress")
    assert progress_of(spark, f"{base}/progress").count() == 2
