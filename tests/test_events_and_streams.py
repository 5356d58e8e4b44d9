import json
import math

import pytest
from pyspark.sql import functions as F

from ledgerwatch import TransactionSpec
from ledgerwatch.plans.silver import extend_silver, feature_rows, rebuild_silver, silver_rows
from ledgerwatch.sources import readers, writers
from ledgerwatch.sources.catalog import layer_tables, read_layer
from ledgerwatch.streaming import events, replay

SPEC = TransactionSpec(features=("Time", "Amount"))
ONCE = {"availableNow": True}
EVENT = '{"Amount":2.5,"Class":1.0,"Time":1.0,"event_time":"2024-01-01T00:00:00+00:00","source_file":"f","transaction_id":"a"}'


def messages(spark, values):
    rows = [("k", v, "t", i % 3, i // 3) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, readers.TOPIC_SCHEMA)


def text_rows(spark, size=10):
    return spark.range(size).select(
        F.col("id").cast("string").alias("Time"),
        (F.col("id") * 1.5).cast("string").alias("Amount"),
        (F.col("id") % 2).cast("string").alias("Class"),
    )


def test_encoded_event(spark):
    rows = spark.createDataFrame([("1", "2.5", "", None)], "Time string, Amount string, Class string, transaction_id string")
    got = events.encode_events(rows, SPEC, "cards.csv").first()
    event = json.loads(got["value"])
    assert list(event) == sorted(event)
    assert (event["Time"], event["Amount"], event["Class"]) == (1.0, 2.5, None)
    assert event["transaction_id"] == got["key"] and len(got["key"]) == 64
    assert event["source_file"] == "cards.csv" and event["event_time"].endswith("+00:00")


def test_encoding_keeps_what_is_given(spark):
    rows = spark.createDataFrame(
        [("1", "2", "0", "mine", "2024-01-01T00:00:00+00:00")],
        "Time string, Amount string, Class string, transaction_id string, event_time string",
    )
    event = json.loads(events.encode_events(rows, SPEC, "f").first()["value"])
    assert (event["transaction_id"], event["event_time"]) == ("mine", "2024-01-01T00:00:00+00:00")


def test_encoding_stops_at_text_that_is_no_number(spark):
    rows = spark.createDataFrame([("1", "two", "0")], "Time string, Amount string, Class string")
    with pytest.raises(Exception, match="Amount holds a non-numeric value"):
        events.encode_events(rows, SPEC, "f").collect()


def test_parsing_good_bad_and_half_bad_messages(spark):
    half = EVENT.replace("2.5", '"zz"')
    parsed = events.parse_messages(messages(spark, [EVENT, "not json", half, None]), SPEC, keep_unparsed=True)
    good, bad, partial, nothing = parsed.collect()
    assert (good["transaction_id"], good["Amount"], good[events.REJECT_COLUMN]) == ("a", 2.5, None)
    assert (bad["transaction_id"], bad["Amount"], bad[events.REJECT_COLUMN]) == (None, None, "not json")
    assert (partial["transaction_id"], partial["Amount"], partial["Class"]) == ("a", None, 1.0)
    assert nothing["transaction_id"] is None
    assert len({row["raw_event_id"] for row in (good, bad, partial, nothing)}) == 4
    kept = events.unparsed(parsed).collect()
    assert {row["value"] for row in kept} == {"not json", half}


def test_parsed_columns_are_the_raw_table(spark):
    parsed = events.parse_messages(messages(spark, [EVENT]), SPEC)
    assert tuple(parsed.columns) == SPEC.bronze_columns
    table = layer_tables(SPEC)["bronze.transactions_raw"]
    assert table.laid_out(parsed).columns[-1] == "ingestion_date"


def bronze(spark, size=20, day="2024-02-01"):
    rows = text_rows(spark, size).withColumn(
        "event_time", F.concat(F.lit("2024-01-0"), (F.col("Time").cast("double") % 3 + 1).cast("int").cast("string"))
    )
    sent = events.encode_events(rows, SPEC, "f").select(
        "key", "value", F.lit("t").alias("topic"), F.lit(0).alias("partition"), F.hash("key").cast("long").alias("offset")
    )
    return events.parse_messages(sent, SPEC, F.lit(day).cast("timestamp"))


def test_rebuilding_the_typed_layer_adds_nothing(spark, folder):
    targets = (folder("clean"), folder("features"))
    for size in (20, 20, 30):
        rebuild_silver(bronze(spark, size), SPEC, *targets)
    tables = layer_tables(SPEC)
    clean = read_layer(spark, tables["silver.transactions_clean"], targets[0])
    features = read_layer(spark, tables["silver.transactions_features"], targets[1])
    assert clean.count() == features.count() == 30
    assert features.filter("size(feature_array) <> 2").count() == 0
    assert clean.filter("event_date <> to_date(event_timestamp)").count() == 0


def test_extending_the_typed_layer(spark, folder):
    targets = (folder("clean"), folder("features"))
    tables = layer_tables(SPEC)
    extend_silver(bronze(spark, 20), SPEC, *targets)
    both = bronze(spark, 20).unionByName(bronze(spark, 50, "2024-02-05").filter("Time >= 20"))
    for known in (both.filter("Time < 10 OR Time >= 30"), both, both):
        extend_silver(known, SPEC, *targets)
    for name, target in zip(("silver.transactions_clean", "silver.transactions_features"), targets):
        stored = read_layer(spark, tables[name], target)
        assert (stored.count(), stored.select("raw_event_id").distinct().count()) == (50, 50)


def test_typed_columns(spark):
    rows = silver_rows(bronze(spark), SPEC)
    assert tuple(rows.columns) == SPEC.silver_columns
    assert tuple(feature_rows(rows, SPEC).columns) == SPEC.feature_table_columns


def test_csv_header_check(spark, folder):
    good, bad = folder("good"), folder("bad")
    writers.export_csv(text_rows(spark), good)
    writers.export_csv(text_rows(spark).drop("Class"), bad)
    assert readers.read_csv(spark, good, SPEC).count() == 10
    with pytest.raises(ValueError, match="Class"):
        readers.read_csv(spark, bad, SPEC)


def test_topic_options():
    options = readers.topic_options("broker:9092", "transactions.raw")
    assert options["subscribe"] == "transactions.raw" and options["startingOffsets"] == "earliest"


def run_bronze(spark, source, target, checkpoint):
    stream = readers.read_stream(spark, "parquet", {"maxFilesPerTrigger": "1"}, readers.TOPIC_SCHEMA, source)
    query = events.start_bronze(stream, SPEC, target, checkpoint, ONCE)
    query.awaitTermination()
    return query


def test_stream_restart_adds_only_what_is_new(spark, folder):
    source, target, checkpoint = folder("topic"), folder("raw"), folder("checkpoint")
    table = layer_tables(SPEC)["bronze.transactions_raw"]

    def send(values):
        messages(spark, values).repartition(3).write.mode("append").parquet(source)

    send([EVENT, "junk", EVENT.replace('"a"', '"b"')])
    run_bronze(spark, source, target, checkpoint)
    run_bronze(spark, source, target, checkpoint)
    assert read_layer(spark, table, target).count() == 3
    send([EVENT.replace('"a"', '"c"')])
    run_bronze(spark, source, target, checkpoint)
    stored = read_layer(spark, table, target)
    assert stored.count() == 4
    assert stored.filter("transaction_id is null").count() == 1
    assert stored.filter("ingestion_date is null").count() == 0


def test_rejected_text_is_kept_beside_the_raw_rows(spark, folder):
    source, raw, rejects = folder("topic"), folder("raw"), folder("rejects")
    messages(spark, [EVENT, "junk", "[1"]).write.parquet(source)
    run_bronze(spark, source, raw, folder("checkpoint"))
    checkpoint = folder("checkpoint")
    for _ in range(2):
        stream = readers.read_stream(spark, "parquet", {}, readers.TOPIC_SCHEMA, source)
        events.start_rejects(stream, SPEC, rejects, checkpoint, ONCE).awaitTermination()
    kept = spark.read.parquet(rejects)
    assert sorted(r["value"] for r in kept.collect()) == ["[1", "junk"]
    stored = read_layer(spark, layer_tables(SPEC)["bronze.transactions_raw"], raw)
    assert stored.join(kept, "raw_event_id", "left_semi").count() == 2


def test_streaming_into_a_catalog_table(spark, folder):
    table = layer_tables(SPEC)["bronze.transactions_raw"]
    spark.sql("CREATE NAMESPACE IF NOT EXISTS streamed")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.stored_schema)
    spark.sql(f"CREATE TABLE streamed.raw ({columns}) USING parquet PARTITIONED BY (ingestion_date)")
    source, checkpoint = folder("topic"), folder("checkpoint")
    messages(spark, [EVENT, "junk"]).write.parquet(source)
    for _ in range(2):
        run_bronze(spark, source, "streamed.raw", checkpoint)
    assert read_layer(spark, table, "streamed.raw").count() == 2


def test_replay_from_an_offset(spark, folder):
    rows = text_rows(spark, 100).withColumn("Time", F.col("Time").cast("double"))
    batches = replay.replay_batches(rows, ["Time"], batch_size=20, start_offset=10, max_records=50)
    sizes = {r["replay_batch"]: r["count"] for r in batches.groupBy("replay_batch").count().collect()}
    assert sizes == {0: 20, 1: 20, 2: 10}
    path = folder("replay")
    replay.write_replay(batches, SPEC, path, "t", "f")
    target, checkpoint = folder("raw"), folder("checkpoint")
    query = events.start_bronze(replay.replay_stream(spark, path), SPEC, target, checkpoint, ONCE)
    query.awaitTermination()
    per_trigger = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    assert sorted(per_trigger) == [10, 20, 20]
    stored = read_layer(spark, layer_tables(SPEC)["bronze.transactions_raw"], target)
    assert sorted(r["Time"] for r in stored.collect()) == [float(t) for t in range(10, 60)]
    assert stored.agg(F.count_distinct("kafka_offset")).first()[0] == 50


def test_replay_keeps_every_number_exactly(spark, folder):
    rows = spark.range(50).select(
        F.col("id").cast("double").alias("Time"),
        (F.lit(math.pi) / (F.col("id") + 1) * 1e-7).alias("Amount"),
        F.lit(1.0).alias("Class"),
    )
    sent = events.encode_events(rows, SPEC, "f").select("key", "value", F.lit("t").alias("topic"), F.lit(0).alias("partition"), F.lit(0).cast("long").alias("offset"))
    back = events.parse_messages(sent, SPEC).select("Time", "Amount", "Class")
    assert back.exceptAll(rows).count() == 0


def test_a_table_as_a_stream(spark, folder):
    path, target, checkpoint = folder("table"), folder("copy"), folder("checkpoint")
    spark.range(9).repartition(3).write.parquet(path)
    stream = readers.stream_table(spark, path, files_per_trigger=1)
    writers.start_append(stream, target, checkpoint, trigger=ONCE).awaitTermination()
    assert readers.read_table(spark, target).count() == 9
