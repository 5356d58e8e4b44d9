"""Registered queries: (spark, sf_dir) -> DataFrame, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindings import views
from bindings.views import EVENTS, THRESHOLD, wall_clock
from ledgerwatch.functions.identity import content_id, packed_id, raw_event_key
from ledgerwatch.functions.rates import f1, precision, recall
from ledgerwatch.operators import classes, duplicates, kpi, listings, quality, summary
from ledgerwatch.operators.curves import areas_under_curves
from ledgerwatch.operators.ensemble import DeployedModel, with_ensemble_score
from ledgerwatch.operators.evaluation import (
    confusion_at_own_threshold,
    confusion_sweep,
    threshold_metrics,
    with_rates,
)
from ledgerwatch.operators.quantiles import exact_quantiles
from ledgerwatch.operators.selection import (
    champion,
    choose_threshold,
    latest,
    mark_selected,
    median_threshold,
)
from ledgerwatch.operators.silver import clean, with_feature_array, with_transaction_id
from ledgerwatch.operators.split import block_counts, time_cuts, time_range, with_block
from ledgerwatch.plans.gold import INDICATOR_TABLES, build_indicators, export_gold, indicators
from ledgerwatch.plans.silver import extend_silver, feature_rows, rebuild_silver, silver_rows
from ledgerwatch.plans.training import ExperimentResult, run_experiment
from ledgerwatch.session import materialize, scratch_path, scratch_work
from ledgerwatch.sources.catalog import layer_tables, read_layer, save_layer
from ledgerwatch.sources.readers import TOPIC_SCHEMA, read_csv, read_stream, stream_table
from ledgerwatch.sources.registry import latest_model, versions
from ledgerwatch.sources.writers import STORED_CODEC, as_messages, export_csv
from ledgerwatch.spec import (
    BEST_F1,
    DEFAULT_THRESHOLDS,
    Candidate,
    ExperimentSpec,
    SplitFractions,
    ThresholdPolicy,
    TransactionSpec,
)
from ledgerwatch.streaming.events import encode_events, parse_messages, start_bronze, start_rejects, unparsed
from ledgerwatch.streaming.replay import replay_batches, replay_stream, write_replay
from ledgerwatch.streaming.scoring import ScoreSinks, TopicSink, score_batch, start_scoring

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ONCE = {"availableNow": True}
RUN = ("candidate_id", "candidate_position", "run_id", "seed")


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles rounded: the order of a floating-point sum differs between engines."""
    return df.select(
        *[
            F.round(name, digits).alias(name) if kind == "double" else F.col(name)
            for name, kind in df.dtypes
        ]
    )


# --- identifiers, parsing, typed rows ---------------------------------------------------


@query
def txn_id_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.transactions(spark, sf_dir).select("event_id", "transaction_id")


@query
def txn_id_from_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids derived from values as given, a NULL among them."""
    people = views.table(spark, sf_dir, "customer")
    blank = F.when(F.col("c_nationkey") % 5 != 0, F.col("c_mktsegment"))
    return people.select(
        "c_custkey", content_id([F.col("c_custkey"), blank, F.col("c_name")]).alias("transaction_id")
    )


@query
def raw_event_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrived = views.messages(spark, sf_dir)
    key = raw_event_key(F.col("key"), F.col("partition"), F.col("offset"))
    return arrived.select("key", "partition", "offset", key.alias("raw_event_id"))


@query
def event_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON text, read back field by field."""
    text = views.messages(spark, sf_dir)
    fields = {
        name: F.get_json_object("value", f"$.{name}").try_cast("double") for name in EVENTS.required
    }
    return text.select(
        F.col("key").alias("transaction_id"),
        F.get_json_object("value", "$.source_file").alias("source_file"),
        F.array_join(F.json_object_keys("value"), ",").alias("field_names"),
        *[column.alias(name) for name, column in fields.items()],
    )


@query
def bronze_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wall_clock(views.parsed_messages(spark, sf_dir))


@query
def bronze_unparsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Free text delivered as events: every row arrives empty, its text is kept aside."""
    texts = views.table(spark, sf_dir, "documents").select(
        F.col("text").alias("value"),
        F.lit("notes").alias("topic"),
        F.lit(0).alias("partition"),
        F.col("doc_id").alias("offset"),
    )
    parsed = parse_messages(texts, EVENTS, keep_unparsed=True)
    return unparsed(parsed).select(
        F.col("kafka_offset").alias("doc_id"), F.sha2("value", 256).alias("text_hash")
    )


@query
def silver_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wall_clock(rounded(views.silver(spark, sf_dir)))


@query
def silver_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that are no numbers, labels outside {0, 1}, times that do not parse."""
    lines = views.table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.concat(F.lit("no time "), "l_returnflag").alias("event_time"),
        F.col("l_linestatus").alias("Time"),
        F.col("l_quantity").cast("string").alias("Amount"),
        (F.col("l_linenumber") - 1).cast("string").alias("Class"),
        F.col("l_shipdate").cast("timestamp").alias("arrived"),
        F.sha2(F.col("l_orderkey").cast("string"), 256).alias("transaction_id"),
    )
    spec = TransactionSpec(features=("Time", "Amount"))
    kept = clean(lines, spec, F.col("arrived"))
    columns = ("l_orderkey", "transaction_id", "event_timestamp", "Time", "Amount", "label")
    return wall_clock(kept.select(*columns))


@query
def silver_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed table built twice holds every row once."""
    base = scratch_path(spark, "rebuild")
    targets = (f"{base}/clean", f"{base}/features")
    raw = views.bronze(spark, sf_dir)
    for _ in range(2):
        rebuild_silver(raw, EVENTS, *targets)
    stored = read_layer(spark, layer_tables(EVENTS)["silver.transactions_features"], targets[1])
    return _rows_per_date(stored)


@query
def silver_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The typed tables, stored in part, extended twice, the last time with nothing new."""
    base = scratch_path(spark, "extend")
    targets = (f"{base}/clean", f"{base}/features")
    raw = views.bronze(spark, sf_dir)
    tables = layer_tables(EVENTS)
    # What an earlier, broken run left: a slice out of the middle is missing in one table, more
    # in the other.
    rows = silver_rows(raw, EVENTS)
    third = F.pmod(F.col("kafka_offset"), F.lit(3))
    save_layer(rows.filter(third != 1), tables["silver.transactions_clean"], target=targets[0])
    save_layer(
        feature_rows(rows.filter(third == 2), EVENTS), tables["silver.transactions_features"], target=targets[1]
    )
    for _ in range(2):
        extend_silver(raw, EVENTS, *targets)
    return _rows_per_date(read_layer(spark, tables["silver.transactions_features"], targets[1]))


def _rows_per_date(features: DataFrame) -> DataFrame:
    per_date = features.groupBy("event_date").agg(
        F.count(F.lit(1)).alias("stored_rows"),
        F.count_distinct("raw_event_id").alias("events"),
        F.sum(F.size("feature_array")).alias("feature_values"),
        F.sum("class_weight").alias("weight"),
    )
    return rounded(per_date.withColumn("event_date", F.col("event_date").cast("string")), 6)


@query
def class_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = classes.class_counts(views.scores(spark, sf_dir))
    return counted.withColumnRenamed("count", "transactions")


@query
def class_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(
        classes.weights_from_counts(classes.class_counts(views.scores(spark, sf_dir)))
    )


@query
def feature_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_feature_array(views.transactions(spark, sf_dir), EVENTS)
    return rows.select("transaction_id", F.posexplode("feature_array").alias("position", "feature"))


# --- scores, indicators, listings -------------------------------------------------------


def _shown(rows: DataFrame) -> DataFrame:
    """Indicators for comparison: amounts to six places, the other doubles to twelve."""
    amount = F.round("suspicious_amount", 6)
    return wall_clock(rounded(rows.withColumn("suspicious_amount", amount), 12))


def _indicators(scores: DataFrame, grain: str) -> DataFrame:
    return _shown(kpi.kpis(scores, grain))


@query
def kpi_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indicators(views.scores(spark, sf_dir), "hour")


@query
def kpi_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indicators(views.scores(spark, sf_dir), "day")


@query
def kpi_daily_order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _indicators(views.order_lines(spark, sf_dir), "day")


@query
def kpi_repeat_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest scores of events of which many share a transaction id: every event counts."""
    lines = views.order_lines(spark, sf_dir).withColumns(
        {
            "scored_at": F.lit(views.SCORED_AT).cast("timestamp"),
            "model_version": F.lit("stand-in"),
            # Keys of order lines repeat in the small tables; with their values they do not.
            "raw_event_id": content_id(
                [F.col(c) for c in ("raw_event_id", "event_timestamp", "Amount", "l_quantity", "fraud_score")]
            ),
        }
    )
    return _indicators(kpi.current_scores(lines), "day")


@query
def kpi_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    hourly = kpi.kpis(views.scores(spark, sf_dir), "hour")
    return _shown(kpi.newest_first(hourly))


@query
def kpi_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicator tables built twice from scores that were themselves stored twice."""
    base = scratch_path(spark, "indicators")
    targets = {name: f"{base}/{name}" for name in INDICATOR_TABLES.values()}
    once = views.scores(spark, sf_dir)
    earlier = once.withColumn("scored_at", F.col("scored_at") - F.expr("INTERVAL 1 HOUR"))
    twice = once.unionByName(earlier.withColumn("fraud_score", F.col("fraud_score") / 2))
    for _ in range(2):
        build_indicators(twice, EVENTS, targets)
    return _shown(indicators(spark, EVENTS, "day", targets["gold.fraud_kpis_daily"]))


@query
def current_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two scorings by two model versions; the later one counts."""
    first = views.scores(spark, sf_dir)
    later = first.withColumns(
        {
            "scored_at": F.col("scored_at") + F.expr("INTERVAL 1 DAY"),
            "model_version": F.lit("second"),
            "fraud_score": F.col("fraud_score") / 2,
        }
    ).filter(F.col("label") == 1)
    kept = kpi.current_scores(first.unionByName(later))
    return wall_clock(kept.select("transaction_id", "model_version", "fraud_score", "scored_at"))


@query
def score_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kpi.score_histogram(views.scores(spark, sf_dir))


@query
def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wall_clock(kpi.alerts(views.scores(spark, sf_dir)))


@query
def top_risk_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    hourly = kpi.kpis(views.scores(spark, sf_dir), "hour")
    top = kpi.riskiest(hourly, 10).select("metric_window", "predicted_frauds", "predicted_fraud_rate")
    return wall_clock(rounded(top))


@query
def layer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = views.bronze(spark, sf_dir)
    return listings.layer_counts(
        {
            "bronze": raw,
            "silver_clean": clean(raw, EVENTS),
            "gold_scores": views.scores(spark, sf_dir),
        }
    )


@query
def json_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = views.scores(spark, sf_dir)
    sent = as_messages(scored, EVENTS.id, EVENTS.score_columns)
    fields = {
        "Amount": "double",
        "label": "double",
        "fraud_score": "double",
        "prediction": "int",
        "model_version": "string",
    }
    return sent.select(
        "key",
        *[F.get_json_object("value", f"$.{n}").try_cast(kind).alias(n) for n, kind in fields.items()],
    )


@query
def json_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alert messages picked by the JSON text they were sent with."""
    sent = as_messages(views.scores(spark, sf_dir), EVENTS.id, EVENTS.score_columns)
    raised = sent.filter(F.get_json_object("value", "$.prediction") == "1")
    return raised.select(F.col("key").alias("transaction_id"))


# --- data quality -----------------------------------------------------------------------


@query
def null_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A profile of all given tables."""
    parts = [
        quality.null_counts(views.table(spark, sf_dir, name)).withColumn("table_name", F.lit(name))
        for name in views.TABLES
    ]
    combined = parts[0]
    for part in parts[1:]:
        combined = combined.unionByName(part)
    return combined


@query
def duplicate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.repeated_id_count(views.table(spark, sf_dir, "lineitem"), "l_orderkey")


@query
def conflicting_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.conflicting_label_count(views.order_lines(spark, sf_dir), "transaction_id")


@query
def class_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = views.table(spark, sf_dir, "documents").select("doc_id")
    labels = views.table(spark, sf_dir, "labels").select("doc_id", "quality")
    joined = marked.join(labels, "doc_id", "left").select(F.col("quality").alias("Class"))
    return quality.class_distribution(joined, "Class")


@query
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four layers, the raw one with every third label missing."""
    raw = views.bronze(spark, sf_dir).withColumn(
        "Class", F.when(F.col("kafka_partition") != 2, F.col("Class"))
    )
    typed = materialize(silver_rows(raw, EVENTS), "typed")
    tables = {
        "bronze.transactions_raw": raw,
        "silver.transactions_clean": typed,
        "silver.transactions_features": with_feature_array(typed, EVENTS),
        "gold.fraud_scores": views.scores(spark, sf_dir),
    }
    return quality.quality_report(tables, EVENTS, "2024-02-01T00:00:00+00:00", ["bronze.transactions_raw"])


@query
def quality_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = quality.quality_report(
        {"gold.fraud_scores": views.scores(spark, sf_dir)}, EVENTS, "2024-02-01T00:00:00+00:00"
    )
    return listings.quality_listing(report)


# --- one row per id, chronological blocks -----------------------------------------------


@query
def keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ("transaction_id", "l_orderkey", "l_linenumber", "label", "raw_event_id")
    lines = views.order_lines(spark, sf_dir)
    return duplicates.keep_first(lines, "transaction_id", ["raw_event_id"], columns)


@query
def derived_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids for rows of which only some bring one."""
    orders = views.table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderstatus") == "F", F.col("o_orderkey").cast("string")).alias("transaction_id"),
        F.col("o_custkey").cast("string").alias("customer"),
        F.col("o_orderpriority").alias("priority"),
    )
    spec = TransactionSpec(features=("customer", "priority"))
    given = with_transaction_id(orders, spec)
    return given.select("o_orderkey", (F.length("transaction_id") == 64).alias("derived"), "transaction_id")


@query
def id_rules_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same text rows as events of a stream and as rows of a file: their ids are equal."""
    spec = TransactionSpec(features=("amount", "customer"), amount="amount", label_source="flag")
    rows = views.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey"),
        F.format_string("%.2f", "o_totalprice").alias("amount"),
        F.col("o_custkey").cast("string").alias("customer"),
        F.lit("0").alias("flag"),
        F.lit("2024-01-01").alias("event_time"),
    )
    sent = encode_events(rows, spec, "orders", carried=("o_orderkey",))
    read = with_transaction_id(rows, spec).select("o_orderkey", "transaction_id")
    both = sent.join(read, "o_orderkey")
    return both.agg(
        F.count(F.lit(1)).alias("compared"),
        F.count_if(~F.col("key").eqNullSafe(F.col("transaction_id"))).alias("differing"),
    )


SMALL_RANGES = 1_000


@query
def exact_cut_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.transactions(spark, sf_dir)
    return exact_quantiles(rows, "Time", SplitFractions().quantiles, rows_per_range=SMALL_RANGES)


@query
def temporal_split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.silver(spark, sf_dir)
    columns = (EVENTS.id, EVENTS.label, EVENTS.time)
    single = duplicates.keep_first(rows, EVENTS.id, [EVENTS.raw_id], columns)
    single = materialize(single, "single-rows")
    cuts = time_cuts(single, EVENTS, SplitFractions(), exact=True)
    return block_counts(with_block(single, EVENTS, cuts))


@query
def split_order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks over the larger table by quantity, a column of only fifty values."""
    lines = views.order_lines(spark, sf_dir).withColumn("Time", F.col("l_quantity"))
    cuts = time_cuts(lines, EVENTS, SplitFractions(), exact=True)
    return block_counts(with_block(lines, EVENTS, cuts))


@query
def time_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = 86_400.0
    return time_range(views.transactions(spark, sf_dir), EVENTS, 10 * day, 20 * day).select(
        "event_id", "Time"
    )


# --- thresholds, curves, runs -----------------------------------------------------------


@query
def confusion_at_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confusion_sweep(views.scores(spark, sf_dir), [THRESHOLD]).drop("position")


@query
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(threshold_metrics(views.scores(spark, sf_dir), DEFAULT_THRESHOLDS))


@query
def threshold_sweep_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = views.run_scores(spark, sf_dir)
    return rounded(threshold_metrics(runs, DEFAULT_THRESHOLDS, by=RUN))


@query
def threshold_sweep_order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(threshold_metrics(views.order_lines(spark, sf_dir), DEFAULT_THRESHOLDS))


def _choices(spark: SparkSession, sf_dir: str, policy: ThresholdPolicy) -> DataFrame:
    sweep = threshold_metrics(views.run_scores(spark, sf_dir), DEFAULT_THRESHOLDS, by=RUN)
    return rounded(choose_threshold(sweep, policy, by=RUN))


@query
def choose_threshold_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A floor that some runs reach and others do not."""
    return _choices(spark, sf_dir, ThresholdPolicy(min_precision=0.2175))


@query
def choose_threshold_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default floor, which this data never reaches: best f1 instead."""
    return _choices(spark, sf_dir, ThresholdPolicy())


@query
def choose_threshold_best_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _choices(spark, sf_dir, ThresholdPolicy(BEST_F1))


@query
def roc_auc_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas = areas_under_curves(views.scores(spark, sf_dir), rows_per_range=SMALL_RANGES)
    return rounded(areas.select("roc_auc"))


@query
def pr_auc_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    areas = areas_under_curves(views.scores(spark, sf_dir), rows_per_range=SMALL_RANGES)
    return rounded(areas.select("auc_pr"))


@query
def auc_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(areas_under_curves(views.run_scores(spark, sf_dir), by=RUN))


@query
def auc_order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(areas_under_curves(views.order_lines(spark, sf_dir)))


def _deterministic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen threshold and areas of every run: what an experiment knows before the test."""
    scored = views.run_scores(spark, sf_dir)
    sweep = threshold_metrics(scored, DEFAULT_THRESHOLDS, by=RUN)
    chosen = choose_threshold(sweep, ThresholdPolicy(), by=RUN)
    return chosen.join(areas_under_curves(scored, by=RUN), list(RUN))


@query
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _deterministic_runs(spark, sf_dir)
    return rounded(summary.run_summary(runs, ("candidate_id",)))


@query
def champion_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(champion(_deterministic_runs(spark, sf_dir)))


@query
def selected_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _deterministic_runs(spark, sf_dir)
    best = champion(runs).first()["candidate_id"]
    return mark_selected(runs, best).select("candidate_id", "run_id", "selected_candidate")


@query
def median_of_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(median_threshold(_deterministic_runs(spark, sf_dir)))


@query
def confusion_at_own(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run on the last fifth of the month, at the threshold chosen on the days before."""
    scored = views.run_scores(spark, sf_dir)
    cut = 24 * 86_400.0
    sweep = threshold_metrics(scored.filter(F.col("Time") < cut), DEFAULT_THRESHOLDS, by=RUN)
    chosen = choose_threshold(sweep, ThresholdPolicy(), by=RUN)
    later = scored.filter(F.col("Time") >= cut)
    return rounded(with_rates(confusion_at_own_threshold(later, chosen, RUN)))


@query
def rates_per_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision, recall and f1 per hour; many hours lack a positive or an alert."""
    hours = views.scores(spark, sf_dir).groupBy(
        F.date_trunc("hour", "event_timestamp").alias("metric_window")
    )
    hit, true = F.col("prediction") == 1, F.col("label") == 1
    counted = hours.agg(
        F.count_if(hit & true).alias("tp"),
        F.count_if(hit & ~true).alias("fp"),
        F.count_if(~hit & true).alias("fn"),
    )
    rated = counted.withColumns(
        {"precision": precision(F.col("tp"), F.col("fp")), "recall": recall(F.col("tp"), F.col("fn"))}
    )
    return wall_clock(rounded(rated.withColumn("f1_score", f1(F.col("precision"), F.col("recall")))))


def _model_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = views.run_scores(spark, sf_dir)
    sweep = threshold_metrics(scored, DEFAULT_THRESHOLDS, by=RUN)
    areas = areas_under_curves(scored, by=RUN)
    return sweep.join(areas, list(RUN)).select(
        F.concat_ws("-", "candidate_id", F.col("seed").cast("string")).alias("model_version"),
        "threshold",
        "precision",
        "recall",
        "f1_score",
        "tp",
        "fp",
        "tn",
        "fn",
        "auc_pr",
        "roc_auc",
        F.lit("2024-02-01T00:00:00+00:00").alias("created_at"),
    )


@query
def model_metrics_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.model_metrics_listing(rounded(_model_metrics(spark, sf_dir)))


@query
def model_metrics_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {name: name for name in ("precision", "recall", "f1_score", "auc_pr", "roc_auc")}
    keep = ("model_version", "threshold", "created_at")
    return rounded(summary.long_metrics(_model_metrics(spark, sf_dir), keep, names))


@query
def newest_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The one latest row of a table, as the registry looks up its latest model."""
    return wall_clock(
        latest(
            views.scores(spark, sf_dir).select("event_timestamp", "transaction_id", "Amount"),
            ["event_timestamp", "transaction_id"],
        )
    )


# --- files and streams ------------------------------------------------------------------


@query
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions written as CSV, read back as text with a header check, and cleaned."""
    folder = scratch_path(spark, "csv")
    export_csv(views.transactions(spark, sf_dir).drop("ts"), folder)
    rows = clean(read_csv(spark, folder, EVENTS), EVENTS)
    return rows.select(F.col("event_id").cast("long").alias("event_id"), *EVENTS.features, "label")


@query
def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three dashboard exports, hourly indicators read back."""
    scored = views.scores(spark, sf_dir)
    paths = export_gold(
        scored, kpi.kpis(scored, "hour"), kpi.kpis(scored, "day"), scratch_path(spark, "exports")
    )
    kinds = (
        "metric_window timestamp, total_transactions long, predicted_frauds long,"
        " suspicious_amount double, avg_fraud_score double, p95_fraud_score double,"
        " predicted_fraud_rate double"
    )
    back = spark.read.schema(kinds).option("header", True).csv(paths["fraud_kpis_hourly"])
    return _shown(back)


@query
def replay_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in time order from row 100 on, in batches of 250."""
    batches = replay_batches(
        views.transactions(spark, sf_dir), ["Time", "event_id"], batch_size=250, start_offset=100
    )
    return batches.groupBy("replay_batch").agg(
        F.count(F.lit(1)).alias("batch_rows"),
        F.min("row_index").alias("first_row"),
        F.sum("event_id").alias("event_ids"),
    )


@query
def stream_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole table replayed into the raw layer, one stored batch per micro-batch."""
    base = scratch_path(spark, "replay")
    rows = views.transactions(spark, sf_dir)
    size = max(1, -(-rows.count() // 5))
    batches = replay_batches(rows, ["Time", "event_id"], batch_size=size)
    write_replay(batches, EVENTS, f"{base}/topic", views.TOPIC, "events.parquet")
    stream = replay_stream(spark, f"{base}/topic")
    started = start_bronze(stream, EVENTS, f"{base}/bronze", f"{base}/checkpoint", ONCE)
    started.awaitTermination()
    stored = read_layer(spark, layer_tables(EVENTS)["bronze.transactions_raw"], f"{base}/bronze")
    return stored.select("transaction_id", "event_time", *EVENTS.required, "kafka_offset", "source_file")


def _stored_messages(spark: SparkSession, sf_dir: str, base: str) -> str:
    path = f"{base}/messages"
    views.messages(spark, sf_dir).repartition(4, "key").write.parquet(path)
    return path


@query
def stream_bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages streamed into the raw layer, stopped and started again from the checkpoint."""
    base = scratch_path(spark, "stream-bronze")
    source = _stored_messages(spark, sf_dir, base)
    for _ in range(2):
        stream = read_stream(spark, "parquet", {"maxFilesPerTrigger": "1"}, TOPIC_SCHEMA, source)
        start_bronze(stream, EVENTS, f"{base}/bronze", f"{base}/checkpoint", ONCE).awaitTermination()
    stored = read_layer(spark, layer_tables(EVENTS)["bronze.transactions_raw"], f"{base}/bronze")
    return stored.drop("ingestion_timestamp", "ingestion_date")


@query
def stream_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of which some are cut off: the text of those, read back from their table."""
    base = scratch_path(spark, "stream-rejects")
    sent = views.messages(spark, sf_dir)
    broken = F.expr("substring(value, 1, 20)")
    cut = sent.withColumn("value", F.when(F.col("offset") % 5 == 0, broken).otherwise(F.col("value")))
    cut.write.parquet(f"{base}/topic")
    stream = read_stream(spark, "parquet", {}, TOPIC_SCHEMA, f"{base}/topic")
    start_rejects(stream, EVENTS, f"{base}/rejects", f"{base}/checkpoint", ONCE).awaitTermination()
    kept = spark.read.parquet(f"{base}/rejects")
    return kept.select("kafka_topic", "kafka_partition", "kafka_offset", "value")


# --- models -----------------------------------------------------------------------------

SMALL_EXPERIMENT = ExperimentSpec(
    candidates=(
        Candidate("compact", forest_trees=5, forest_depth=3, boosting_rounds=3, boosting_depth=2),
        Candidate("extended", forest_trees=8, forest_depth=4, boosting_rounds=4, boosting_depth=3),
    ),
    seeds=(42, 52),
    exact_cuts=True,
    fit_rows_per_partition=2_000,
    parallel_fits=4,
)


def _experiment(spark: SparkSession, sf_dir: str) -> tuple[ExperimentResult, str]:
    """One small experiment over the tables as they are now, and its registry."""
    return _experiment_over(views.silver(spark, sf_dir), scratch_path(spark, "models"))


def _experiment_over(typed: DataFrame, base: str) -> tuple[ExperimentResult, str]:
    registry = f"{base}/registry"
    return run_experiment(typed, EVENTS, SMALL_EXPERIMENT, base, registry), registry


def _deployed(spark: SparkSession, sf_dir: str) -> DeployedModel:
    _, registry = _experiment(spark, sf_dir)
    return DeployedModel.from_registry(latest_model(versions(spark, registry)))


@query
def experiment_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _experiment(spark, sf_dir)[0].metrics


@query
def experiment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.summary_listing(_experiment(spark, sf_dir)[0].summary)


@query
def test_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.test_run_listing(_experiment(spark, sf_dir)[0].metrics)


@query
def deployed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings.model_metrics_listing(_experiment(spark, sf_dir)[0].model_metrics)


@query
def model_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, registry = _experiment(spark, sf_dir)
    return versions(spark, registry).select(
        "model_version", "threshold", "threshold_policy", "candidate_id", "experiment_id"
    )


@query
def experiment_row_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What holds for any models: matrices add up to their block, rates lie in [0, 1]."""
    metrics = _experiment(spark, sf_dir)[0].metrics
    block = F.when(F.col("split_name") == "test", F.col("test_rows")).otherwise(
        F.col("validation_rows")
    )
    rates = ("precision", "recall", "f1_score", "auc_pr", "roc_auc")
    inside = F.forall(F.array(*rates), lambda rate: (rate >= 0) & (rate <= 1))
    return metrics.groupBy("split_name").agg(
        F.count(F.lit(1)).alias("runs"),
        F.count_if(F.expr("tp + fp + tn + fn") != block).alias("unbalanced"),
        F.count_if(~inside).alias("outside"),
        F.max("train_rows").alias("train_rows"),
        F.max("validation_rows").alias("validation_rows"),
        F.max("test_rows").alias("test_rows"),
    )


@query
def ensemble_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = _deployed(spark, sf_dir)
    scored = with_ensemble_score(views.silver(spark, sf_dir), model.ensemble, EVENTS)
    return wall_clock(
        scored.select(
            "transaction_id",
            "event_timestamp",
            "label",
            "rf_fraud_probability",
            "gbt_fraud_probability",
            "fraud_score",
        )
    )


def _in_parts(rows: DataFrame, parts: int) -> DataFrame:
    """Rows in so many parts; they are shuffled only where they have fewer."""
    if rows.rdd.getNumPartitions() < parts:
        return rows.repartition(parts, "transaction_id")
    return rows.coalesce(parts)


def _score_both_ways(spark: SparkSession, sf_dir: str) -> str:
    """Score the typed table as a batch and as a stream into the same tables.

    The typed table is stored once, for the experiment and for both ways. Raw rows go when it
    is there, the experiment's rows when its model is loaded, and typed rows when all are scored.
    """
    base, models = scratch_path(spark, "scores"), scratch_path(spark, "models")
    with scratch_work() as source:
        typed = scratch_path(spark, "typed")
    with scratch_work() as raw:
        rows = _in_parts(views.silver(spark, sf_dir), 3)
        rows.write.parquet(typed, compression=STORED_CODEC)
    raw.remove(spark)
    with scratch_work() as fits:
        _, registry = _experiment_over(spark.read.parquet(typed), models)
        model = DeployedModel.from_registry(latest_model(versions(spark, registry)))
    fits.remove(spark)
    sinks = ScoreSinks(
        scores=f"{base}/scores",
        alerts=f"{base}/alerts",
        scored_topic=TopicSink("json", folder=f"{base}/scored-topic"),
        alert_topic=TopicSink("json", folder=f"{base}/alert-topic"),
    )
    score_batch(spark.read.parquet(typed), model, EVENTS, sinks, run="batch")
    for _ in range(2):
        stream = stream_table(spark, typed, files_per_trigger=1)
        start_scoring(stream, model, EVENTS, sinks, f"{base}/checkpoint", "stream", ONCE).awaitTermination()
    source.remove(spark)
    return base


@query
def stream_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per scoring run: rows, ids, alerts stored, messages sent. Batch and stream agree."""
    base = _score_both_ways(spark, sf_dir)
    tables = layer_tables(EVENTS)
    scored = read_layer(spark, tables["gold.fraud_scores"], f"{base}/scores")
    raised = read_layer(spark, tables["gold.fraud_alerts"], f"{base}/alerts")
    text = "key string, value string, scoring_run string, scoring_batch_id int"
    sent = spark.read.schema(text).json(f"{base}/scored-topic")
    warned = spark.read.schema(text).json(f"{base}/alert-topic")
    per_run = scored.groupBy("scoring_run").agg(
        F.count(F.lit(1)).alias("scored_rows"),
        F.count_distinct(packed_id(F.col("transaction_id"))).alias("scored_ids"),
        F.count_if(~F.col("fraud_score").between(0.0, 1.0)).alias("outside"),
        F.sum("prediction").alias("alerts_expected"),
    )
    counts = [
        frame.groupBy("scoring_run").agg(F.count(F.lit(1)).alias(name))
        for frame, name in ((raised, "alerts_stored"), (sent, "sent"), (warned, "warned"))
    ]
    for counted in counts:
        per_run = per_run.join(counted, "scoring_run", "left")
    stored = F.coalesce(F.col("alerts_stored"), F.lit(0))
    return per_run.select(
        "scoring_run",
        "scored_rows",
        "scored_ids",
        "outside",
        (F.col("alerts_expected") - stored).alias("alerts_missing"),
        "sent",
        (stored - F.coalesce(F.col("warned"), F.lit(0))).alias("warnings_missing"),
    )


@query
def batch_equals_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same row scored as a batch and as a stream has the same scores."""
    base = _score_both_ways(spark, sf_dir)
    scored = read_layer(spark, layer_tables(EVENTS)["gold.fraud_scores"], f"{base}/scores")
    same_id = packed_id(F.col("transaction_id")).alias("transaction_id")
    columns = (same_id, "fraud_score", "prediction", "label", "Amount")
    batch = scored.filter(F.col("scoring_run") == "batch").select(*columns)
    stream = scored.filter(F.col("scoring_run") == "stream").select(*columns)
    differing = batch.exceptAll(stream).agg(F.count(F.lit(1)).alias("differing_rows"))
    return differing
