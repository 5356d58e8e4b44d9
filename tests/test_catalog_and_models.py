import random
from dataclasses import replace
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ledgerwatch import Candidate, ExperimentSpec, TransactionSpec
from ledgerwatch.functions.scores import margin_probability
from ledgerwatch.operators.classes import ClassWeights
from ledgerwatch.operators.ensemble import (
    DeployedModel,
    fit_ensemble,
    score_runs,
    training_layout,
    with_ensemble_score,
    with_feature_vector,
)
from ledgerwatch.operators.kpi import alerts
from ledgerwatch.operators.silver import with_class_weight
from ledgerwatch.plans.training import (
    fit_layout,
    fit_runs,
    prepare_blocks,
    run_experiment,
    write_experiment,
)
from ledgerwatch.session import shared_folder
from ledgerwatch.sources.catalog import create_tables, layer_tables, read_layer, save_layer
from ledgerwatch.sources.readers import stream_table
from ledgerwatch.sources.registry import ModelRecord, latest_model, register, versions
from ledgerwatch.streaming import scoring
from ledgerwatch.streaming.scoring import ScoreSinks, TopicSink, score_batch, start_scoring

CARD = TransactionSpec()
SPEC = TransactionSpec(features=("Time", "x", "Amount"))
ONCE = {"availableNow": True}
TINY = ExperimentSpec(
    candidates=(
        Candidate("small", forest_trees=4, forest_depth=3, boosting_rounds=3, boosting_depth=2),
        Candidate("smaller", forest_trees=2, forest_depth=2, boosting_rounds=2, boosting_depth=2),
    ),
    seeds=(1, 2),
    fit_rows_per_partition=500,
    parallel_fits=3,
)


@pytest.fixture(scope="module")
def typed(spark):
    """Rows whose class depends on x, so that a model can learn it."""
    rng = random.Random(0)
    rows = []
    for i in range(1500):
        x = rng.random()
        label = float(rng.random() < (0.9 if x > 0.8 else 0.05))
        stamp = datetime(2024, 1, 1) + timedelta(minutes=i)
        rows.append((f"id{i}", stamp, float(i), x, rng.random() * 100, label, f"raw{i}"))
    columns = "transaction_id string, event_timestamp timestamp, Time double, x double, Amount double, label double, raw_event_id string"
    return spark.createDataFrame(rows, columns).repartition(4)


@pytest.fixture(scope="module")
def experiment(typed, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("models"))
    return run_experiment(typed, SPEC, TINY, base, f"{base}/registry"), f"{base}/registry"


@pytest.fixture(scope="module")
def model(spark, experiment):
    return DeployedModel.from_registry(latest_model(versions(spark, experiment[1])))


def test_tables_are_created_once(spark):
    names = create_tables(spark, CARD)
    assert create_tables(spark, CARD) == names
    assert len(names) == 12
    for name, table in layer_tables(CARD).items():
        stored = spark.table(name)
        assert sorted(stored.columns) == sorted(table.stored_schema.fieldNames())
    assert len(layer_tables(CARD)["gold.experiment_metrics"].schema) == 20
    partitioned = {r["col_name"] for r in spark.sql("DESCRIBE silver.transactions_clean").collect()}
    assert "# Partition Information" in partitioned


def test_replacing_partitions_of_a_catalog_table(spark):
    create_tables(spark, CARD)
    table = layer_tables(CARD)["gold.fraud_kpis_hourly"]
    measures = [F.lit(1).cast(f.dataType).alias(f.name) for f in table.schema.fields[1:]]

    def hours(start, count):
        stamp = F.timestamp_seconds(F.lit(1704067200) + (F.col("id") + start) * 3600)
        return spark.range(count).select(stamp.alias("metric_window"), *measures)

    save_layer(hours(0, 48), table, overwrite=True)
    save_layer(hours(24, 10), table, overwrite=True)
    assert spark.table(table.name).count() == 34
    save_layer(hours(0, 1), table)
    assert spark.table(table.name).count() == 35
    with pytest.raises(ValueError, match="no partitions"):
        save_layer(hours(0, 1), layer_tables(CARD)["gold.data_quality_metrics"], overwrite=True)


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")


def test_registry(spark, folder):
    path = folder()
    common = dict(
        model_base_path="b",
        rf_model_path="r",
        gbt_model_path="g",
        threshold_policy="p",
        feature_columns=["x"],
        class_weights={"0": 1.0},
        experiment_id="e",
    )
    for day, threshold in ((2, 0.7), (3, 0.5), (1, 0.1)):
        stamp = datetime(2024, 1, day, tzinfo=timezone.utc)
        register(spark, path, ModelRecord(model_version=f"v{day}", threshold=threshold, training_timestamp=stamp, **common))
    newest = latest_model(versions(spark, path))
    assert (newest["model_version"], newest["threshold"]) == ("v3", 0.5)
    with pytest.raises(LookupError):
        latest_model(versions(spark, path).limit(0))


def test_experiment_rows(experiment):
    result, _ = experiment
    rows = result.metrics.collect()
    assert len(rows) == 6 and len(result.metrics.columns) == 20
    by_split = {name: [r for r in rows if r["split_name"] == name] for name in ("validation", "test")}
    assert (len(by_split["validation"]), len(by_split["test"])) == (4, 2)
    for row in rows:
        block = row["test_rows"] if row["split_name"] == "test" else row["validation_rows"]
        assert row["tp"] + row["fp"] + row["tn"] + row["fn"] == block
        assert row["train_rows"] + row["validation_rows"] + row["test_rows"] == 1500
    champion = {r["candidate_id"] for r in rows if r["selected_candidate"]}
    assert len(champion) == 1 and {r["candidate_id"] for r in by_split["test"]} == champion
    chosen = {(r["candidate_id"], r["seed"]): r["threshold"] for r in by_split["validation"]}
    assert all(chosen[(r["candidate_id"], r["seed"])] == r["threshold"] for r in by_split["test"])
    assert min(r["roc_auc"] for r in rows) > 0.6


def test_experiment_champion_has_the_best_mean_area(experiment):
    rows = [r for r in experiment[0].metrics.collect() if r["split_name"] == "validation"]
    means = {}
    for row in rows:
        means.setdefault(row["candidate_id"], []).append(row["auc_pr"])
    best = max(means, key=lambda c: sum(means[c]) / len(means[c]))
    assert experiment[0].record.candidate_id == best


def test_experiment_summary(experiment):
    rows = experiment[0].summary.collect()
    assert len(rows) == 3 * 6 and {r["runs"] for r in rows} == {2}
    assert {r["metric_name"] for r in rows} == {"precision", "recall", "f1", "auc_pr", "roc_auc", "threshold"}


def test_deployed_model_metrics(experiment):
    result, _ = experiment
    assert result.model_metrics.count() == 19 and len(result.model_metrics.columns) == 12
    assert len(result.long_model_metrics.columns) == 4
    record = result.record
    assert record.model_version.endswith("-deployment")
    assert sum(record.split_rows.values()) == 1500
    assert set(record.test_summary) == {"precision", "recall", "f1", "auc_pr", "roc_auc"}


def test_experiment_tables(spark, experiment):
    create_tables(spark, SPEC)
    write_experiment(experiment[0], SPEC)
    sizes = {
        "gold.experiment_metrics": 6,
        "gold.experiment_summary": 18,
        "gold.model_metrics": 19,
        "ml.model_metrics": experiment[0].long_model_metrics.count(),
    }
    assert {name: spark.table(name).count() for name in sizes} == sizes


def test_fits_do_not_depend_on_the_layout(spark, typed):
    models = []
    for frame in (typed, typed.repartition(9, "x"), typed.orderBy(F.desc("Time")).coalesce(1)):
        layout = training_layout(frame, 1.0, 3.0, SPEC, 4).persist()
        models.append(fit_ensemble(layout, TINY.candidates[0], 1, SPEC))
        layout.unpersist()
    forests = {m.forest.toDebugString.split("\n", 1)[1] for m in models}
    boosted = {m.boosted.toDebugString.split("\n", 1)[1] for m in models}
    assert len(forests) == len(boosted) == 1


def test_boosted_probability_is_that_of_its_margin(typed, model):
    scored = with_ensemble_score(typed, model.ensemble, SPEC)
    raw = model.ensemble.boosted.transform(with_feature_vector(typed, SPEC))
    margins = raw.select("transaction_id", margin_probability(F.col("rawPrediction")).alias("p"))
    joined = scored.join(margins, "transaction_id")
    assert joined.filter("abs(p - gbt_fraud_probability) > 1e-12").count() == 0
    assert joined.filter("abs(fraud_score - (rf_fraud_probability + gbt_fraud_probability) / 2) > 1e-12").count() == 0


def test_all_runs_score_in_one_pass(typed, folder):
    blocks = prepare_blocks(typed, SPEC, TINY)
    runs = fit_runs(blocks, SPEC, TINY, folder())
    validation = blocks.block("validation")
    together = score_runs(validation, runs, SPEC)
    assert together.count() == 4 * validation.count()
    run = runs[2]
    alone = with_ensemble_score(validation, run.ensemble, SPEC).select("label", "fraud_score")
    mine = together.filter((F.col("candidate_id") == run.candidate_id) & (F.col("seed") == run.seed))
    assert mine.select("label", "fraud_score").exceptAll(alone).count() == 0


def test_blocks_for_exact_trees_hold_no_ids(typed):
    """Repeated ids are resolved alike, and the blocks hold the same rows."""
    again = typed.unionByName(typed.filter("Time < 300").withColumns({"raw_event_id": F.lit("zzz"), "x": F.lit(9.0)}))
    exact = replace(TINY, exact_trees=True)
    blocks, plain = (prepare_blocks(again, SPEC, each) for each in (exact, TINY))
    assert blocks.row_counts == plain.row_counts and SPEC.id not in blocks.rows.columns
    names = ["block", "label", *SPEC.features]
    assert blocks.rows.select(names).exceptAll(plain.rows.select(names)).count() == 0


def test_exact_trees_over_summed_rows(typed):
    """Equal rows are fitted as one of their joint weight: the same trees as over all rows."""
    few = TransactionSpec(features=("x", "Amount"))
    rows = typed.withColumns({"x": F.round("x", 1), "Amount": F.round("Amount", -1) - 50})
    weights = ClassWeights(0.6, 2.9)
    exact = replace(TINY, exact_trees=True)
    layout, bins = fit_layout(rows, weights, few, exact, 1500)
    assert layout.count() < 300 and "Exchange" not in layout._jdf.queryExecution().toString()
    whole = training_layout(rows, *weights, few, 3)
    total = lambda df: df.agg(F.sum("class_weight")).first()[0]
    assert abs(total(layout) - total(whole)) < 1e-6
    mine, want = (fit_ensemble(each, Candidate("c", 1, 4, 3, 3), 1, few, bins) for each in (layout, whole))
    for one, other in ((mine.forest, want.forest), (mine.boosted, want.boosted)):
        found, wanted = ([line.strip() for line in m.toDebugString.split("\n") if "(feature" in line] for m in (one, other))
        assert found == wanted and len(found) > 5
    scores = lambda m: [r.fraud_score for r in with_ensemble_score(rows, m, few).orderBy("transaction_id").collect()]
    assert scores(mine) == pytest.approx(scores(want), abs=1e-12)


def test_null_features_are_scored(typed, model):
    holes = typed.withColumn("x", F.when(F.col("x") > 0.5, F.col("x")))
    scored = with_ensemble_score(holes, model.ensemble, SPEC)
    assert scored.filter("fraud_score between 0 and 1").count() == 1500


def sinks_in(folder):
    return ScoreSinks(
        scores=folder("scores"),
        alerts=folder("alerts"),
        scored_topic=TopicSink("json", folder=folder("scored")),
        alert_topic=TopicSink("parquet", folder=folder("warned")),
    )


def tables(spark, sinks):
    defined = layer_tables(SPEC)
    return (
        read_layer(spark, defined["gold.fraud_scores"], sinks.scores),
        read_layer(spark, defined["gold.fraud_alerts"], sinks.alerts),
    )


def test_batch_scoring_again_changes_nothing(spark, typed, model, folder):
    sinks = sinks_in(folder)
    for _ in range(2):
        score_batch(typed, model, SPEC, sinks)
    scored, raised = tables(spark, sinks)
    assert tuple(scored.columns[:12]) == SPEC.score_columns
    assert scored.count() == scored.select("transaction_id").distinct().count() == 1500
    assert raised.count() == alerts(scored).count() > 0
    assert raised.filter("prediction <> 1 or fraud_score < threshold_used").count() == 0
    assert scored.select("model_version", "threshold_used", "scored_at").distinct().count() == 1
    assert spark.read.json(sinks.scored_topic.folder).count() == 1500
    assert spark.read.parquet(sinks.alert_topic.folder).count() == raised.count()


def test_a_step_without_alerts_leaves_none_behind(spark, typed, model, folder):
    sinks = sinks_in(folder)
    score_batch(typed, model, SPEC, sinks, run="r")
    strict = DeployedModel(model.ensemble, 1.1, model.version)
    score_batch(typed, strict, SPEC, sinks, run="r")
    scored, raised = tables(spark, sinks)
    assert (scored.count(), raised.count()) == (1500, 0)


def test_scoring_into_catalog_tables(spark, typed, model):
    spark.sql("CREATE NAMESPACE IF NOT EXISTS gold")
    create_tables(spark, SPEC)
    sinks = ScoreSinks()
    for run in ("one", "two", "two"):
        score_batch(typed, model, SPEC, sinks, run=run)
    defined = layer_tables(SPEC)
    per_run = read_layer(spark, defined["gold.fraud_scores"]).groupBy("scoring_run").count().collect()
    assert {r["scoring_run"]: r["count"] for r in per_run} == {"one": 1500, "two": 1500}
    strict = DeployedModel(model.ensemble, 1.1, model.version)
    score_batch(typed, strict, SPEC, sinks, run="two")
    left = read_layer(spark, defined["gold.fraud_alerts"])
    assert left.filter("scoring_run = 'two'").count() == 0
    assert left.filter("scoring_run = 'one'").count() > 0


def test_scoring_nothing_is_an_error(typed, model, folder):
    with pytest.raises(ValueError, match="no typed rows"):
        score_batch(typed.limit(0), model, SPEC, sinks_in(folder))


def test_stream_equals_batch_and_survives_a_failed_batch(spark, typed, model, folder, monkeypatch):
    """The second batch fails after its scores were written; the restart repeats it."""
    source, checkpoint = folder("typed"), folder("checkpoint")
    typed.repartition(3).write.parquet(source)
    sinks = sinks_in(folder)
    score_batch(spark.read.parquet(source), model, SPEC, sinks, run="batch")

    sent = {"count": 0}
    original = TopicSink.send

    def failing(self, messages, run, batch_id):
        sent["count"] += 1
        if sent["count"] == 4:
            raise RuntimeError("the topic is away")
        original(self, messages, run, batch_id)

    monkeypatch.setattr(scoring.TopicSink, "send", failing)

    def start():
        stream = stream_table(spark, source, files_per_trigger=1)
        return start_scoring(stream, model, SPEC, sinks, checkpoint, "stream", ONCE)

    with pytest.raises(Exception, match="the topic is away"):
        start().awaitTermination()
    monkeypatch.setattr(scoring.TopicSink, "send", original)
    for _ in range(2):
        start().awaitTermination()

    scored, raised = tables(spark, sinks)
    columns = ("transaction_id", "label", "Amount", "fraud_score", "prediction")
    batch = scored.filter("scoring_run = 'batch'").select(*columns)
    stream = scored.filter("scoring_run = 'stream'").select(*columns)
    assert stream.count() == 1500
    assert batch.exceptAll(stream).count() == 0
    assert scored.filter("scoring_run = 'stream'").select("scoring_batch_id").distinct().count() == 3
    per_run = {r["scoring_run"]: r["count"] for r in raised.groupBy("scoring_run").count().collect()}
    assert per_run["batch"] == per_run["stream"]


def test_empty_micro_batches_are_skipped(typed, model, folder):
    write = scoring.micro_batch_writer(model, SPEC, ScoreSinks(folder(), folder()), "r")
    write(typed.limit(0), 0)


def test_training_layout_moves_plain_numbers(typed):
    """The same rows in the same places as vectors dealt by id, without ids and vectors on the way."""
    layout = training_layout(typed, 1.0, 3.0, SPEC, 4)
    vectors = with_feature_vector(with_class_weight(typed, 1.0, 3.0, SPEC), SPEC)
    dealt = vectors.repartition(4, "transaction_id").sortWithinPartitions("transaction_id")
    assert layout.columns == ["label", "class_weight", "features"]
    assert layout.rdd.glom().collect() == dealt.select(layout.columns).rdd.glom().collect()
    moved = layout._jdf.queryExecution().optimizedPlan().toString().split("RepartitionByExpression")[1]
    assert "UDF" not in moved


def test_messages_in_files_are_compressed_unless_told_how(spark, folder):
    messages = spark.createDataFrame([("a", '{"x":1}'), ("b", None)], "key string, value string")
    for kind, options, ending in (
        ("json", {}, ".json.gz"),
        ("json", {"compression": "none"}, ".json"),
        ("parquet", {}, ".zstd.parquet"),
    ):
        path = folder("sent")
        TopicSink(kind, options, path).send(messages, "r", 0)
        names = [file.name for file in Path(path).rglob("part-*")]
        assert names and all(name.endswith(ending) for name in names)
        back = spark.read.schema("key string, value string").format(kind).load(f"{path}/scoring_run=r")
        assert sorted(row.key for row in back.collect()) == ["a", "b"]
