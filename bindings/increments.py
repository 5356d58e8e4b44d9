"""Registered queries over what is kept up to date piece by piece: states, steps, progress."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindings import views
from bindings.queries import _rows_per_date, query, rounded
from bindings.views import EVENTS, wall_clock
from ledgerwatch.operators import kpi, quality, rollup
from ledgerwatch.operators.asof import with_version_in_force
from ledgerwatch.operators.quality_state import state_report, update_states
from ledgerwatch.plans.gold import export_gold
from ledgerwatch.plans.silver import advance_silver, rebuild_silver
from ledgerwatch.session import materialize, scratch_path
from ledgerwatch.sources.catalog import DATABASES, create_tables, layer_tables, read_layer, replace_step, save_layer
from ledgerwatch.sources.compaction import compact_steps, read_compacted
from ledgerwatch.sources.registry import ModelRecord, register, versions
from ledgerwatch.sources.writers import STORED_CODEC
from ledgerwatch.streaming.events import parse_messages
from ledgerwatch.streaming.replay import replay_batches

STAMP = "2024-02-01T00:00:00+00:00"


@query
def kpi_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days, weeks and the whole by model, from hourly states that were stored in two parts.

    The exact 95th percentile lies between the two edges that are shown."""
    scores = views.scores(spark, sf_dir).withColumn(
        "model_version", F.when(F.col("label") == 1, "second").otherwise("first")
    )
    path = f"{scratch_path(spark, 'rollup')}/hours"
    third = F.pmod(F.xxhash64("transaction_id"), F.lit(3)) == 0
    for part in (scores.filter(third), scores.filter(~third)):
        rollup.add_states(rollup.hourly_states(part), path)
    states = spark.read.parquet(path)
    spans = {"day": F.date_trunc("day", "hour"), "week": F.date_trunc("week", "hour"), "all": F.lit("2024-01-01").cast("timestamp")}
    found = None
    for name, period in spans.items():
        rows = rollup.with_measures(rollup.merged(states, ["model_version", period.alias("period")]))
        rows = rows.withColumn("span", F.lit(name))
        found = rows if found is None else found.unionByName(rows)
    amount = F.round("suspicious_amount", 6)
    return wall_clock(rounded(found.withColumn("suspicious_amount", amount), 12))


def _registered(spark: SparkSession) -> DataFrame:
    """Five versions of a model, registered over a month, one of them twice at one time."""
    path = scratch_path(spark, "versions")
    start = datetime(2024, 1, 3, 4, 30, tzinfo=timezone.utc)
    for k, (hours, threshold) in enumerate(((0, 0.5), (200, 0.45), (200, 0.4), (201, 0.35), (500, 0.3))):
        register(
            spark,
            path,
            ModelRecord(
                f"model-{k}", "", "", "", threshold, "best_f1", start + timedelta(hours=hours), list(EVENTS.features), {}, "asof"
            ),
        )
    return versions(spark, path)


@query
def model_in_force(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every event the model version that was in force, and its threshold."""
    events = views.scores(spark, sf_dir).select("transaction_id", "event_timestamp", "fraud_score")
    known = _registered(spark).select("model_version", F.col("threshold").alias("in_force"), "training_timestamp")
    found = with_version_in_force(events, known, "event_timestamp", "training_timestamp", ["model_version", "in_force"])
    return wall_clock(found.withColumn("alerted", F.col("fraud_score") >= F.col("in_force")).drop("fraud_score"))


@query
def silver_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed tables kept up to date over four runs, with events that come late to old
    dates: rows, ids and features per date, and how many dates each run had to open."""
    base = scratch_path(spark, "advance")
    targets = (f"{base}/clean", f"{base}/features", f"{base}/progress")
    # Events arrive an hour after they happen.
    at = F.try_to_timestamp(F.get_json_object("value", "$.event_time")) + F.expr("INTERVAL 1 HOUR")
    raw = materialize(parse_messages(views.messages(spark, sf_dir), EVENTS, ingested_at=at), "raw", codec=STORED_CODEC)
    early = F.col(EVENTS.ingested_at) < F.lit("2024-01-15").cast("timestamp")
    late = F.col("kafka_offset") % 10 == 0
    table = layer_tables(EVENTS)["bronze.transactions_raw"]
    opened = []
    for part in (raw.filter(early & ~late), raw.filter(~early & ~late), raw.filter(late), raw.limit(0)):
        save_layer(part, table, target=f"{base}/raw")
        stored = read_layer(spark, table, f"{base}/raw")
        opened.append(len(advance_silver(stored, EVENTS, *targets)))
    features = read_layer(spark, layer_tables(EVENTS)["silver.transactions_features"], targets[1])
    shown = _rows_per_date(features).drop("weight")
    return shown.withColumns({f"opened_{k}": F.lit(n).cast("long") for k, n in enumerate(opened, start=1)})


@query
def quality_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality report from states of three appends, the last one with rows late to old dates."""
    base = scratch_path(spark, "quality-states")
    rows = views.transactions(spark, sf_dir).withColumns(
        {"day": F.to_date("ts"), "user_id": F.when(F.col("event_id") % 7 != 0, F.col("user_id"))}
    ).drop("ts")
    rows = materialize(rows, "rows")
    early, late = F.col("day") < F.lit("2024-01-15").cast("date"), F.col("event_id") % 10 == 0
    for part in (rows.filter(early & ~late), rows.filter(~early & ~late), rows.filter(late)):
        part.write.mode("append").partitionBy("day").parquet(f"{base}/table")
        update_states(spark.read.parquet(f"{base}/table"), "events", "day", f"{base}/states", "transaction_id", "Class")
    report = state_report(spark, f"{base}/states", "events", STAMP)
    return report.filter("metric_name != 'distinct_transaction_id'")


@query
def compacted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of two runs of six steps, compacted, one step written again with other scores,
    compacted again: rows of each step, and what their scores add up to."""
    base = f"{scratch_path(spark, 'compaction')}/scores"
    table = layer_tables(EVENTS)["gold.fraud_scores"]
    scores = materialize(views.scores(spark, sf_dir).withColumn("scored_at", F.col("event_timestamp")), "scores", codec=STORED_CODEC)
    batch = F.conv(F.substring("transaction_id", 1, 6), 16, 10).cast("long") % 6
    step = lambda k: scores.filter(batch == k)
    for run in ("first", "second"):
        for k in range(6):
            replace_step(step(k), table, {"scoring_run": run, "scoring_batch_id": k}, base)
    compact_steps(spark, table, base, keep=1)
    again = step(2).withColumn("fraud_score", F.col("fraud_score") / 2)
    replace_step(again, table, {"scoring_run": "first", "scoring_batch_id": 2}, base)
    compact_steps(spark, table, base, keep=0)
    rows = read_compacted(spark, table, base).groupBy("scoring_run", "scoring_batch_id")
    return rounded(rows.agg(F.count(F.lit(1)).alias("stored_rows"), F.sum("fraud_score").alias("score_sum")), 6)


@query
def catalog_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables made by DDL in a catalog, raw rows inserted, the typed tables written twice by
    partition; what they then hold per date. The databases are dropped again."""
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    prefix = f"lw_{uuid.uuid4().hex}_"
    tables = layer_tables(EVENTS)
    name = lambda key: prefix + key
    try:
        create_tables(spark, EVENTS, database_prefix=prefix)
        create_tables(spark, EVENTS, database_prefix=prefix)  # what exists stays
        save_layer(views.parsed_messages(spark, sf_dir), tables["bronze.transactions_raw"], target=name("bronze.transactions_raw"))
        raw = read_layer(spark, tables["bronze.transactions_raw"], name("bronze.transactions_raw"))
        targets = (name("silver.transactions_clean"), name("silver.transactions_features"))
        for _ in range(2):
            rebuild_silver(raw, EVENTS, *targets)
        for key, table in tables.items():
            stored = [(f.name, f.dataType) for f in spark.table(name(key)).schema]
            if stored != [(f.name, f.dataType) for f in table.stored_schema]:
                raise ValueError(f"{key} has other columns in the catalog: {stored}")
        return materialize(_rows_per_date(read_layer(spark, tables["silver.transactions_features"], targets[1])), "catalog-rows")
    finally:
        for database in DATABASES:
            spark.sql(f"DROP DATABASE IF EXISTS {prefix}{database} CASCADE")


@query
def csv_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All three dashboard exports read back: rows, and sums of what they hold."""
    scored = views.scores(spark, sf_dir)
    paths = export_gold(scored, kpi.kpis(scored, "hour"), kpi.kpis(scored, "day"), scratch_path(spark, "exports"))
    found = None
    for name, (alerts, measure) in {
        "fraud_scores": ("prediction", "fraud_score"),
        "fraud_kpis_hourly": ("predicted_frauds", "p95_fraud_score"),
        "fraud_kpis_daily": ("predicted_frauds", "p95_fraud_score"),
    }.items():
        rows = spark.read.option("header", True).csv(paths[name])
        part = rows.agg(
            F.count(F.lit(1)).alias("exported_rows"),
            F.sum(F.col(alerts).cast("long")).alias("alerts"),
            F.sum(F.col(measure).cast("double")).alias("measure"),
        ).withColumn("export", F.lit(name))
        found = part if found is None else found.unionByName(part)
    return rounded(found, 6)


@query
def replay_first_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 500 events by time after the first 100, as a replay with a limit takes them."""
    rows = replay_batches(
        views.transactions(spark, sf_dir), ["Time", "event_id"], batch_size=200, start_offset=100, max_records=500
    )
    return rows.select("event_id", "row_index", "replay_batch")


@query
def arrival_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events stamped with the clock as they are parsed: all within the run's own time."""
    before = datetime.now(timezone.utc)
    parsed = materialize(parse_messages(views.messages(spark, sf_dir), EVENTS), "stamped")
    after = datetime.now(timezone.utc)
    stamp = F.col(EVENTS.ingested_at)
    return parsed.agg(
        F.count(F.lit(1)).alias("stamped"),
        F.count_if(stamp.isNull() | (stamp < F.lit(before)) | (stamp > F.lit(after))).alias("outside"),
        F.count_distinct(stamp).alias("clocks"),
    )


@query
def quality_of_increments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of the same rows as ``quality_increments``, read whole."""
    rows = views.transactions(spark, sf_dir).withColumn("user_id", F.when(F.col("event_id") % 7 != 0, F.col("user_id"))).drop("ts")
    report = quality.quality_report({"events": rows}, EVENTS, STAMP)
    return report.filter("metric_name != 'duplicate_transaction_id'")
