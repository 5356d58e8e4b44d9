from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ledgerwatch import TransactionSpec
from ledgerwatch.operators import kpi, listings, quality
from ledgerwatch.plans import gold
from ledgerwatch.sources.catalog import layer_tables, read_layer

SPEC = TransactionSpec(features=("Time", "Amount"))
SCORES = (
    "transaction_id string, event_timestamp timestamp, Amount double, label double,"
    " fraud_score double, prediction int, model_version string, scored_at timestamp,"
    " raw_event_id string"
)


@pytest.fixture
def scores(spark):
    def at(hour, minute=0):
        return datetime(2024, 1, 1, hour, minute)

    rows = [
        ("a", at(1), 10.0, 0.0, 0.1, 0, "m1", at(5), "e1"),
        ("b", at(1, 30), 20.0, 1.0, 0.9, 1, "m1", at(5), "e2"),
        ("c", at(2), None, 1.0, 0.8, 1, "m1", at(5), "e3"),
        ("d", at(3), 40.0, 0.0, None, None, "m1", at(5), "e4"),
    ]
    return spark.createDataFrame(rows, SCORES)


def test_hourly_indicators(scores):
    rows = {r["metric_window"].hour: r for r in kpi.kpis(scores, "hour").collect()}
    first = rows[1]
    assert (first["total_transactions"], first["predicted_frauds"]) == (2, 1)
    assert (first["suspicious_amount"], first["predicted_fraud_rate"]) == (20.0, 0.5)
    assert (first["avg_fraud_score"], first["p95_fraud_score"]) == (0.5, 0.9)
    assert rows[2]["suspicious_amount"] is None
    assert rows[3]["predicted_fraud_rate"] is None and rows[3]["total_transactions"] == 1


def test_grain_must_be_known(scores):
    with pytest.raises(ValueError, match="week"):
        kpi.kpis(scores, "week")


def test_percentile_of_a_group_with_most_rows(spark):
    rows = spark.range(20_000).select(
        F.when(F.col("id") < 15_000, F.lit("2024-01-01 00:30:00"))
        .otherwise(F.lit("2024-01-01 05:00:00"))
        .cast("timestamp")
        .alias("event_timestamp"),
        F.lit(1.0).alias("Amount"),
        (F.col("id") % 1000 / 1000).alias("fraud_score"),
        F.lit(0).alias("prediction"),
    )
    for row in kpi.kpis(rows, "hour").collect():
        assert abs(row["p95_fraud_score"] - 0.949) <= 0.001


def test_current_scores_keeps_the_latest(scores):
    later = scores.withColumns(
        {"scored_at": F.col("scored_at") + F.expr("INTERVAL 1 HOUR"), "model_version": F.lit("m2")}
    ).filter("transaction_id = 'b'")
    both = scores.unionByName(later)
    kept = {r["transaction_id"]: r["model_version"] for r in kpi.current_scores(both).collect()}
    assert kept == {"a": "m1", "b": "m2", "c": "m1", "d": "m1"}
    assert kpi.current_scores(both, "m2").count() == 1
    assert kpi.current_scores(both).columns == scores.columns


def test_building_indicators_again_changes_nothing(scores, spark, folder):
    targets = {name: folder(grain) for grain, name in gold.INDICATOR_TABLES.items()}
    for _ in range(2):
        gold.build_indicators(scores, SPEC, targets)
    hourly = gold.indicators(spark, SPEC, "hour", targets["gold.fraud_kpis_hourly"])
    assert (hourly.count(), hourly.agg(F.sum("total_transactions")).first()[0]) == (3, 4)


def test_indicators_by_scoring_or_by_transaction(scores, spark, folder):
    twice = scores.unionByName(scores.withColumn("scored_at", F.col("scored_at") + F.expr("INTERVAL 1 DAY")))
    totals = []
    for latest_only in (True, False):
        targets = {name: folder(grain) for grain, name in gold.INDICATOR_TABLES.items()}
        gold.build_indicators(twice, SPEC, targets, latest_only=latest_only)
        daily = gold.indicators(spark, SPEC, "day", targets["gold.fraud_kpis_daily"])
        totals.append(daily.agg(F.sum("total_transactions")).first()[0])
    assert totals == [4, 8]


def test_repeat_transactions_count_each(scores, spark, folder):
    """Two delivered events with one content id are two transactions."""
    again = scores.withColumn("raw_event_id", F.concat(F.lit("again-"), "raw_event_id"))
    targets = {name: folder(grain) for grain, name in gold.INDICATOR_TABLES.items()}
    gold.build_indicators(scores.unionByName(again), SPEC, targets)
    daily = gold.indicators(spark, SPEC, "day", targets["gold.fraud_kpis_daily"])
    assert daily.agg(F.sum("total_transactions")).first()[0] == 8


def test_exports(scores, spark, folder):
    paths = gold.export_gold(scores, kpi.kpis(scores, "hour"), kpi.kpis(scores, "day"), folder())
    hourly = spark.read.option("header", True).csv(paths["fraud_kpis_hourly"])
    assert hourly.columns[0] == "metric_window" and hourly.count() == 3
    assert hourly.select(F.input_file_name()).distinct().count() == 1
    assert spark.read.option("header", True).csv(paths["fraud_scores"]).count() == 4


def test_riskiest_breaks_ties_by_time(scores):
    top = kpi.riskiest(kpi.kpis(scores, "hour").filter("predicted_fraud_rate is not null"), 1)
    assert top.first()["metric_window"].hour == 2


def test_null_counts_in_one_pass(scores):
    got = {r["metric_dimension"]: r["metric_value"] for r in quality.null_counts(scores).collect()}
    assert got["*"] == 4.0
    assert (got["Amount"], got["fraud_score"], got["label"]) == (1.0, 1.0, 0.0)


def test_quality_report_rows(spark):
    """Which metrics appear depends on the table's columns and on its layer."""
    raw = spark.createDataFrame(
        [("a", 1.0, 2.0, 1.0), ("a", 1.0, None, 0.0), (None, 1.0, 2.0, None), (None, 1.0, 2.0, None)],
        "transaction_id string, Time double, Amount double, Class double",
    )
    tables = {"raw": raw, "partial": raw.select("Time"), "raw2": raw.drop("Amount")}
    report = quality.quality_report(tables, SPEC, "now", ["raw", "raw2"]).collect()
    got = {(r["table_name"], r["metric_name"], r["metric_dimension"]): r["metric_value"] for r in report}
    assert got[("raw", "duplicate_transaction_id", "transaction_id")] == 2.0
    assert got[("raw", "class_distribution", "None")] == 2.0
    assert got[("raw", "class_distribution", "1.0")] == 1.0
    assert got[("raw", "schema_missing_required_columns", "none")] == 0.0
    assert got[("raw2", "schema_missing_required_columns", "Amount")] == 1.0
    assert [key[1:] for key in got if key[0] == "partial"] == [("row_count", "*"), ("null_count", "Time")]


def test_quality_of_an_empty_table(scores):
    got = quality.null_counts(scores.limit(0)).collect()
    assert {r["metric_value"] for r in got} == {0.0} and len(got) == 10


def test_published_report_size(spark):
    """39 + 42 + 43 + 12 columns give the published 151 rows."""
    card = TransactionSpec()
    tables = {}
    for name, table in layer_tables(card).items():
        if name.startswith(("bronze", "silver")) or name == "gold.fraud_scores":
            columns = [F.lit(None).cast(f.dataType).alias(f.name) for f in table.schema]
            # The published score table does not have the event key.
            own = [c for c, f in zip(columns, table.schema) if name != "gold.fraud_scores" or f.name != card.raw_id]
            rows = spark.range(2).select("id", *own)
            if "Class" in table.schema.fieldNames():
                rows = rows.withColumn("Class", F.col("id").cast("double"))
            tables[name] = rows.drop("id")
    report = quality.quality_report(tables, card, "now", ["bronze.transactions_raw"])
    assert report.count() == 151


def test_report_appends(scores, spark, folder):
    target = folder()
    for day in ("2024-01-01", "2024-01-02"):
        gold.write_quality({"gold.fraud_scores": scores}, SPEC, day, target=target)
    stored = read_layer(spark, layer_tables(SPEC)["gold.data_quality_metrics"], target)
    assert stored.count() == 2 * (1 + 9 + 1)
    listed = listings.quality_listing(stored)
    assert listed.first()["created_at"] == "2024-01-02"


def test_layer_counts(scores):
    got = listings.layer_counts({"bronze": scores, "gold_scores": scores.limit(0)}).collect()
    assert [(r["layer"], r["records"]) for r in got] == [("bronze", 4), ("gold_scores", 0)]
