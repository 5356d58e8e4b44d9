"""The given tables as transactions, messages, layers and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwatch.functions.identity import content_id, raw_event_key
from ledgerwatch.functions.scores import decide, ensemble
from ledgerwatch.plans.silver import silver_rows
from ledgerwatch.session import materialize
from ledgerwatch.sources.writers import STORED_CODEC
from ledgerwatch.spec import TransactionSpec
from ledgerwatch.streaming.events import encode_events, parse_messages

EVENTS = TransactionSpec(features=("Time", "user_id", "k", "Amount"))
# Features of few values, over which a tree can try every split.
COARSE = TransactionSpec(features=("hour", "weekday", "k", "band"), amount="band")
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()
THRESHOLD = 0.4
EPOCH_MICROS = 1704067200000000
TOPIC = "transactions.raw"
INGESTED_AT = "2024-02-01 00:00:00"
SCORED_AT = "2024-02-01 06:00:00"

# The deterministic runs: candidate, its place, run, seed, weight of the amount part.
RUNS = tuple(
    (candidate, place, run, seed, round(base + 0.05 * run, 2))
    for candidate, place, base in (("compact", 0, 0.1), ("extended", 1, 0.4))
    for run, seed in enumerate((42, 52, 62, 72, 82), start=1)
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wall_clock(df: DataFrame) -> DataFrame:
    """Timestamps without zone, as the comparing engine shows them."""
    return df.select(
        *[
            F.col(name).cast("timestamp_ntz").alias(name) if kind == "timestamp" else F.col(name)
            for name, kind in df.dtypes
        ]
    )


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as input rows: given id, ISO event time, numeric features, class."""
    events = table(spark, sf_dir, "events")
    at = F.col("ts").cast("timestamp")
    return events.select(
        "event_id",
        "ts",
        content_id([F.col("event_id"), F.col("user_id"), F.col("event_type")]).alias("transaction_id"),
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx").alias("event_time"),
        ((F.unix_micros(at) - F.lit(EPOCH_MICROS)) / F.lit(1e6)).alias("Time"),
        F.col("user_id").cast("double").alias("user_id"),
        F.get_json_object("props", "$.k").cast("double").alias("k"),
        F.col("value").alias("Amount"),
        (F.col("event_type") == "error").cast("double").alias("Class"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transactions as they would arrive on a three-partition topic."""
    rows = transactions(spark, sf_dir)
    encoded = encode_events(rows, EVENTS, "events.parquet", carried=("event_id",))
    return encoded.select(
        "key",
        "value",
        F.lit(TOPIC).alias("topic"),
        (F.col("event_id") % 3).cast("int").alias("partition"),
        F.floor(F.col("event_id") / 3).cast("long").alias("offset"),
    )


def parsed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.lit(INGESTED_AT).cast("timestamp")
    return parse_messages(messages(spark, sf_dir), EVENTS, ingested_at=at)


def bronze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parsed messages as a stored table, as the later layers find them."""
    return materialize(parsed_messages(spark, sf_dir), "bronze", codec=STORED_CODEC)


def silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return silver_rows(bronze(spark, sf_dir), EVENTS)


def _parts(rows: DataFrame) -> DataFrame:
    amount_part = F.least(F.col("Amount"), F.lit(500.0)) / F.lit(500.0)
    return rows.withColumns({"a": amount_part, "b": F.col("k") / F.lit(100.0)})


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deterministic stand-in for model scores, in the layout of the score table."""
    rows = _parts(transactions(spark, sf_dir))
    score = ensemble(F.col("a"), F.col("b"))
    return rows.select(
        "transaction_id",
        F.col("ts").cast("timestamp").alias("event_timestamp"),
        "Amount",
        F.col("Class").alias("label"),
        F.col("a").alias("rf_fraud_probability"),
        F.col("b").alias("gbt_fraud_probability"),
        score.alias("fraud_score"),
        decide(score, THRESHOLD).alias("prediction"),
        F.lit(THRESHOLD).alias("threshold_used"),
        F.lit("stand-in").alias("model_version"),
        F.lit(SCORED_AT).cast("timestamp").alias("scored_at"),
        F.lit(0).alias("scoring_batch_id"),
        raw_event_key(
            F.col("transaction_id"), F.col("event_id") % 3, F.floor(F.col("event_id") / 3)
        ).alias("raw_event_id"),
    )


def run_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label and score of every transaction under ten deterministic runs."""
    rows = _parts(transactions(spark, sf_dir))
    runs = [
        F.struct(
            F.lit(candidate).alias("candidate_id"),
            F.lit(place).alias("candidate_position"),
            F.lit(run).alias("run_id"),
            F.lit(seed).alias("seed"),
            (F.lit(weight) * F.col("a") + (F.lit(1.0) - F.lit(weight)) * F.col("b")).alias(
                "fraud_score"
            ),
        )
        for candidate, place, run, seed, weight in RUNS
    ]
    return rows.select(F.col("Class").alias("label"), "Time", F.inline(F.array(*runs)))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as scored transactions: the larger input, with repeated ids."""
    lines = table(spark, sf_dir, "lineitem")
    keys = [F.col(name) for name in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]
    score = ensemble(F.col("l_discount") * 10.0, F.col("l_quantity") / 50.0)
    return lines.select(
        content_id([F.col("l_orderkey")]).alias("transaction_id"),
        content_id(keys).alias("raw_event_id"),
        F.col("l_shipdate").cast("timestamp").alias("event_timestamp"),
        F.col("l_extendedprice").alias("Amount"),
        (F.col("l_returnflag") == "R").cast("double").alias("label"),
        score.alias("fraud_score"),
        decide(score, THRESHOLD).alias("prediction"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "l_quantity",
    )


def coarse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled transactions with features of few values each."""
    rows = transactions(spark, sf_dir)
    return rows.select(
        "event_id",
        "transaction_id",
        raw_event_key(
            F.col("transaction_id"), F.col("event_id") % 3, F.floor(F.col("event_id") / 3)
        ).alias("raw_event_id"),
        F.col("Class").alias("label"),
        "Time",
        F.hour("ts").cast("double").alias("hour"),
        (F.dayofweek("ts") - 1).cast("double").alias("weekday"),
        "k",
        F.floor(F.col("Amount") / 25.0).cast("double").alias("band"),
    )
