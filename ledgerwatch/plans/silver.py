"""Raw layer to typed layer."""

from __future__ import annotations

from datetime import date
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwatch.functions.lenient import to_double
from ledgerwatch.operators.classes import ClassWeights, balanced_weights, checked_weights
from ledgerwatch.operators.silver import clean, with_class_weight, with_feature_array
from ledgerwatch.session import materialize
from ledgerwatch.sources.catalog import layer_tables, read_layer, save_layer
from ledgerwatch.sources.writers import STORED_CODEC, replace_partitions
from ledgerwatch.spec import TransactionSpec


def silver_rows(
    bronze: DataFrame,
    spec: TransactionSpec,
    weights: ClassWeights | None = None,
    fallback_time: Column | None = None,
) -> DataFrame:
    """Clean rows with balanced class weights over all of them, in the typed-layer order."""
    instead = F.col(spec.ingested_at) if fallback_time is None else fallback_time
    cleaned = clean(bronze, spec, instead)
    weights = weights or balanced_weights(cleaned, spec.label)
    weighted = with_class_weight(cleaned, weights.legit, weights.positive, spec)
    return weighted.select(*spec.silver_columns)


def feature_rows(silver: DataFrame, spec: TransactionSpec) -> DataFrame:
    return with_feature_array(silver, spec).select(*spec.feature_table_columns)


def rebuild_silver(
    bronze: DataFrame, spec: TransactionSpec, clean_target: str, features_target: str
) -> None:
    """Recompute both typed tables from all raw rows; touched dates are replaced, not added to.
    The feature table follows from the stored clean one, so raw rows are cleaned once.

    Event times that do not parse fall back to the stored ingestion time, so that a row
    lands in the same date on every run.
    """
    clean_table, feature_table = (
        layer_tables(spec)[name]
        for name in ("silver.transactions_clean", "silver.transactions_features")
    )
    save_layer(silver_rows(bronze, spec), clean_table, overwrite=True, target=clean_target)
    stored = read_layer(bronze.sparkSession, clean_table, clean_target)
    save_layer(feature_rows(stored, spec), feature_table, overwrite=True, target=features_target)


def _progress(rows: DataFrame, spec: TransactionSpec) -> DataFrame:
    """Per ingestion date how many events there are, and a sum that tells which."""
    marks = F.sum(F.xxhash64(spec.raw_id).cast("decimal(38,0)"))
    date = F.to_date(spec.ingested_at).alias("progress_date")
    return rows.groupBy(date).agg(F.count(F.lit(1)).alias("events"), marks.alias("marks"))


def extend_silver(
    bronze: DataFrame, spec: TransactionSpec, clean_target: str, features_target: str
) -> None:
    """Append only raw events that are not in the typed tables yet.

    Use this where the typed table is read as a stream: nothing stored is rewritten. How far a
    table is follows from the table itself: ingestion dates of which it has the same events as
    the raw layer are complete, and only the other dates are cleaned and compared event by
    event. An event that arrives late, or that a failed run left out, makes its date differ
    again, so nothing is passed over. Class weights are taken over all raw rows, which reads the
    label column only.
    """
    spark = bronze.sparkSession
    tables = layer_tables(spec)
    valid = clean(bronze, spec, F.col(spec.ingested_at))
    weights = balanced_weights(valid, spec.label)
    wanted = materialize(_progress(valid.dropDuplicates([spec.raw_id]), spec), "progress")
    for name, shape, target in (
        ("silver.transactions_clean", lambda rows: rows, clean_target),
        ("silver.transactions_features", lambda rows: feature_rows(rows, spec), features_target),
    ):
        stored = read_layer(spark, tables[name], target, missing_is_empty=True)
        same = ["progress_date", "events", "marks"]
        there = _progress(stored, spec)
        matched = [wanted[c].eqNullSafe(there[c]) for c in same]
        late = wanted.join(there, reduce(Column.__and__, matched), "left_anti")
        late = materialize(late.select("progress_date"), "open-dates")

        def of_late(rows: DataFrame) -> DataFrame:
            date = F.to_date(rows[spec.ingested_at])
            return rows.join(late, date.eqNullSafe(late["progress_date"]), "left_semi")

        fresh = shape(silver_rows(of_late(bronze), spec, weights)).dropDuplicates([spec.raw_id])
        missing = fresh.join(of_late(stored).select(spec.raw_id), spec.raw_id, "left_anti")
        save_layer(missing, tables[name], target=target)


PROGRESS_SCHEMA = "arrived_rows long, label double, count long, ingestion_date date"


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """How many raw rows of each ingestion date are in the typed tables, and their labels."""
    try:
        return spark.read.schema(PROGRESS_SCHEMA).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], PROGRESS_SCHEMA)


def open_dates(bronze: DataFrame, progress: DataFrame) -> list[date | None]:
    """Ingestion dates of which the raw table has another number of rows than is typed.

    The raw table is partitioned by that date and nothing but the partition is asked for, so
    this takes file footers, one row per date on the driver, and no column.
    """
    arrived = bronze.groupBy("ingestion_date").agg(F.count(F.lit(1)).alias("now_rows"))
    known = progress.groupBy("ingestion_date").agg(F.max("arrived_rows").alias("arrived_rows"))
    same = arrived["ingestion_date"].eqNullSafe(known["ingestion_date"])
    found = arrived.join(known, same & (F.col("now_rows") == F.col("arrived_rows")), "left_anti")
    return sorted((r["ingestion_date"] for r in found.collect()), key=lambda d: (d is not None, d))


def dates_only(rows: DataFrame, column: str, dates: list[date | None]) -> DataFrame:
    """The partitions of some dates; the others are not read."""
    wanted = F.col(column).isin([d for d in dates if d is not None])
    return rows.filter(wanted | F.col(column).isNull() if None in dates else wanted)


def advance_silver(
    bronze: DataFrame, spec: TransactionSpec, clean_target: str, features_target: str, progress: str
) -> list[date | None]:
    """Append the raw events that are new since the last run; returns the dates that were open.

    ``bronze`` is the raw table with its partition column; ``progress`` a folder of this
    function's own with a row per ingestion date and label. Only open dates are read, cleaned
    and compared with the typed rows of the event dates that they touch; an event that comes
    late to an old ingestion date opens that date again. Class weights are those of all rows so
    far, from the stored label counts.

    Progress is stored last: a run that stops before is repeated and adds only what is missing.
    A raw date that is rewritten with as many rows as before is not noticed; ``extend_silver``
    compares events and finds it.
    """
    spark = bronze.sparkSession
    tables = layer_tables(spec)
    state = read_progress(spark, progress)
    dates = open_dates(bronze, state)
    if not dates:
        return []
    arrived = dates_only(bronze, "ingestion_date", dates)
    valid = clean(arrived, spec, F.col(spec.ingested_at))
    day = F.to_date(spec.ingested_at)
    labels = valid.groupBy(day.alias("ingestion_date"), spec.label).agg(F.count(F.lit(1)).alias("count"))
    now = arrived.groupBy("ingestion_date").agg(F.count(F.lit(1)).alias("arrived_rows"))
    # A date without a valid row has a row without a label.
    both = now.join(labels.withColumnRenamed("ingestion_date", "_date"), F.col("ingestion_date").eqNullSafe(F.col("_date")), "left")
    fresh_state = materialize(
        both.select("arrived_rows", F.col(spec.label).cast("double").alias("label"), F.coalesce("count", F.lit(0)).cast("long").alias("count"), "ingestion_date"),
        "label-counts",
    )
    closed = state.join(fresh_state.select("ingestion_date").distinct(), state["ingestion_date"].eqNullSafe(fresh_state["ingestion_date"]), "left_anti")
    counts = closed.unionByName(fresh_state).filter("label is not null").groupBy("label").agg(F.sum("count").alias("count"))
    weights = checked_weights(counts, "label")

    targets = {
        "_in_clean": ("silver.transactions_clean", lambda rows: rows, clean_target),
        "_in_features": ("silver.transactions_features", lambda rows: feature_rows(rows, spec), features_target),
    }
    touched = [r[0] for r in valid.select(F.to_date(spec.timestamp)).distinct().collect()]

    def stored_ids(own: str) -> DataFrame:
        name, _, target = targets[own]
        stored = dates_only(read_layer(spark, tables[name], target, missing_is_empty=True), "event_date", touched)
        return stored.select(spec.raw_id, *[F.lit(mark == own).alias(mark) for mark in targets])

    known = reduce(DataFrame.unionByName, map(stored_ids, targets)).groupBy(spec.raw_id)
    known = known.agg(*[F.max(mark).alias(mark) for mark in targets])
    # Rows meet by id once, as raw columns, for both tables; what is missing meets once by date.
    labelled = to_double(F.col(spec.label_source)).isin(0.0, 1.0)
    single = arrived.filter(labelled).drop("ingestion_date").dropDuplicates([spec.raw_id])
    typed = silver_rows(single, spec, weights).withColumn("event_date", F.to_date(spec.timestamp))
    marked = typed.join(known, spec.raw_id, "left").fillna(False, subset=list(targets))
    fresh = marked.filter(~reduce(Column.__and__, map(F.col, targets))).hint("rebalance", F.col("event_date"))
    fresh = materialize(fresh, "fresh-rows", codec=STORED_CODEC)
    for mark, (name, shape, target) in targets.items():
        missing = fresh.filter(~F.col(mark)).drop("event_date", *targets)
        save_layer(shape(missing), tables[name], target=target, rebalance=False)
    replace_partitions(fresh_state.repartition(1), progress, ["ingestion_date"])
    return dates
