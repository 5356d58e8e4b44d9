from pathlib import Path

from pyspark.sql import functions as F

from bindings import queries
from bindings.views import EVENTS
from ledgerwatch import ExperimentSpec
from ledgerwatch.plans.training import fit_partitions
from ledgerwatch.sources.catalog import layer_tables


def test_each_query_builds_its_own_experiment(monkeypatch, spark):
    registries = []
    monkeypatch.setattr(queries.views, "silver", lambda spark, sf_dir: sf_dir)
    monkeypatch.setattr(queries, "run_experiment", lambda *given: registries.append(given[-1]))
    found = [queries._experiment(spark, "same")[1] for _ in range(2)]
    assert found == registries and len(set(found)) == 2


def test_changed_tables_give_changed_results(spark, folder):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    sf_dir = folder("tables")
    rows = []
    for given in (events, events.where("event_id % 2 = 0")):
        given.write.mode("overwrite").parquet(f"{sf_dir}/events.parquet")
        found = queries.experiment_row_balance(spark, sf_dir).first()
        rows.append(found.train_rows + found.validation_rows + found.test_rows)
    assert rows[0] == events.count() and rows[1] == events.where("event_id % 2 = 0").count()


def test_fit_partitions_do_not_follow_the_rows_for_ever():
    experiment = queries.SMALL_EXPERIMENT
    assert [fit_partitions(rows, experiment) for rows in (0, 1, 2_000, 60_000, 128_000)] == [1, 1, 1, 30, 64]
    assert [fit_partitions(rows, experiment) for rows in (3_600_000, 21_600_000, 50_000_000)] == [64, 64, 100]
    assert fit_partitions(50_000_000, ExperimentSpec(fit_rows_per_partition=2_000_000)) == 25


def test_scoring_both_ways_leaves_scores_and_messages_only(spark, folder, monkeypatch):
    """Raw, typed and training rows are gone when all is scored; messages in files are compressed."""
    base, sf_dir = folder("shared"), folder("tables")
    monkeypatch.setattr("ledgerwatch.session.shared_folder", lambda spark: base)
    kind = F.when(F.col("event_id") % 3 == 0, "error").otherwise("view")
    number = F.xxhash64("event_id") % 50
    spark.range(900).withColumnRenamed("id", "event_id").select(
        "event_id",
        F.timestamp_seconds(1704067200 + 60 * F.col("event_id")).cast("timestamp_ntz").alias("ts"),
        (F.col("event_id") % 40).alias("user_id"),
        kind.alias("event_type"),
        F.abs(number).cast("double").alias("value"),
        F.concat(F.lit('{"k": '), F.col("event_id") % 9, F.lit("}")).alias("props"),
    ).write.parquet(f"{sf_dir}/events.parquet")
    assert queries.batch_equals_stream(spark, sf_dir).first().differing_rows == 0
    left = {path.name.rsplit("-", 1)[0]: path for path in Path(base, "ledgerwatch").iterdir()}
    assert set(left) == {"models", "scores"}
    assert not Path(left["scores"], "typed").exists()
    sent = [path.name for path in Path(left["scores"], "scored-topic").rglob("part-*")]
    assert len(sent) >= 4 and all(name.endswith(".json.gz") for name in sent)
    text = "key string, value string, scoring_run string, scoring_batch_id int"
    steps = spark.read.schema(text).json(f"{left['scores']}/scored-topic")
    found = steps.groupBy("scoring_run").agg(F.count("value").alias("rows"), F.count_distinct("scoring_batch_id").alias("steps"))
    assert sorted(map(tuple, found.collect())) == [("batch", 900, 1), ("stream", 900, 3)]


def test_scored_ids_are_counted_as_bytes(spark, folder, monkeypatch):
    """Hex, other text, repeated and null ids; half of a hex id is shuffled."""
    base = folder("scored")
    ids = ["ab" * 32, "AB" * 32, "ab" * 32, "cd" * 32, "cd", "x", "x", None]
    table = layer_tables(EVENTS)["gold.fraud_scores"]
    rows = spark.createDataFrame([(i, 1.0, 0.5, run) for i in ids for run in ("batch", "stream")], "transaction_id string, prediction double, fraud_score double, scoring_run string")
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in table.stored_schema if f.name not in rows.columns]
    full = rows.select("*", *empty).withColumns({"prediction": F.lit(1), "scoring_batch_id": F.lit(0)})
    for name in ("scores", "alerts"):
        full.select(table.stored_schema.fieldNames()).write.partitionBy("scoring_run", "scoring_batch_id").parquet(f"{base}/{name}")
    for name in ("scored-topic", "alert-topic"):
        full.select(F.lit("k").alias("key"), "scoring_run").write.partitionBy("scoring_run").json(f"{base}/{name}")
    monkeypatch.setattr(queries, "_score_both_ways", lambda spark, sf_dir: base)
    found = queries.stream_score(spark, "any")
    assert sorted(map(tuple, found.collect())) == [(run, 8, 5, 0, 0, 8, 0) for run in ("batch", "stream")]
    assert "unhex" in found._jdf.queryExecution().optimizedPlan().toString()
