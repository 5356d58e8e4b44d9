"""Layer tables: their schemas, partition columns, and their creation in a catalog."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerwatch.sources.writers import (
    append,
    insert_into,
    leaf_folder,
    replace_leaf,
    replace_partitions,
)
from ledgerwatch.spec import PROVENANCE_COLUMNS, TransactionSpec

TEXT, NUMBER, WHOLE, COUNT = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType()
TIME, FLAG = T.TimestampType(), T.BooleanType()

DATABASES = ("bronze", "silver", "gold", "ml")


@dataclass(frozen=True)
class LayerTable:
    """A table's columns and how it is partitioned: by a date derived from the time column
    ``dated_by``, or by columns the rows carry."""

    name: str
    schema: T.StructType
    dated_by: str | None = None
    date_column: str | None = None
    run_columns: tuple[T.StructField, ...] = ()

    @property
    def partition_fields(self) -> tuple[T.StructField, ...]:
        if self.date_column:
            return (T.StructField(self.date_column, T.DateType()),)
        return self.run_columns

    @property
    def partition_by(self) -> tuple[str, ...]:
        return tuple(field.name for field in self.partition_fields)

    @property
    def stored_schema(self) -> T.StructType:
        """Columns as stored: partition columns last."""
        body = [field for field in self.schema if field.name not in self.partition_by]
        return T.StructType([*body, *self.partition_fields])

    def laid_out(self, df: DataFrame) -> DataFrame:
        """Exactly the stored columns, in their types and order."""
        if self.date_column:
            df = df.withColumn(self.date_column, F.to_date(self.dated_by))
        return df.select(
            *[F.col(field.name).cast(field.dataType).alias(field.name) for field in self.stored_schema]
        )


# Columns and types of all layer tables, below.
def _struct(*groups: tuple[T.DataType, tuple[str, ...]]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for kind, names in groups for name in names])


def _event_types(spec: TransactionSpec) -> dict[str, T.DataType]:
    topic, partition, offset = PROVENANCE_COLUMNS
    special = {
        spec.timestamp: TIME,
        spec.label: NUMBER,
        spec.weight: NUMBER,
        spec.ingested_at: TIME,
        spec.raw_id: TEXT,
        topic: TEXT,
        partition: WHOLE,
        offset: COUNT,
        "feature_array": T.ArrayType(NUMBER),
    }
    return {**{field.name: field.dataType for field in spec.event_schema}, **special}


def _event_table(spec: TransactionSpec, columns: tuple[str, ...]) -> T.StructType:
    types = _event_types(spec)
    return T.StructType([T.StructField(name, types[name]) for name in columns])


def score_schema(spec: TransactionSpec) -> T.StructType:
    return _struct(
        (TEXT, (spec.id,)),
        (TIME, (spec.timestamp,)),
        (NUMBER, (spec.amount, spec.label)),
        (NUMBER, ("rf_fraud_probability", "gbt_fraud_probability", "fraud_score")),
        (WHOLE, ("prediction",)),
        (NUMBER, ("threshold_used",)),
        (TEXT, ("model_version",)),
        (TIME, ("scored_at",)),
        (WHOLE, ("scoring_batch_id",)),
        # Which delivered event was scored: transactions with equal content share their id.
        (TEXT, (spec.raw_id,)),
    )


def indicator_schema(time_column: str) -> T.StructType:
    return _struct(
        (TIME, (time_column,)),
        (COUNT, ("total_transactions", "predicted_frauds")),
        (NUMBER, ("suspicious_amount", "avg_fraud_score", "p95_fraud_score")),
        (NUMBER, ("predicted_fraud_rate",)),
    )


# A scoring run and its batch number name the partition one scoring step writes. Batch
# numbers restart with every new stream, hence the run; repeating a step replaces its
# partition and nothing else.
SCORING_KEYS = (T.StructField("scoring_run", TEXT), T.StructField("scoring_batch_id", WHOLE))

QUALITY_SCHEMA = _struct(
    (TEXT, ("table_name", "metric_name", "metric_dimension")),
    (NUMBER, ("metric_value",)),
    (TEXT, ("created_at",)),
)
MATRIX = (COUNT, ("tp", "fp", "tn", "fn"))
MODEL_METRICS_SCHEMA = _struct(
    (TEXT, ("model_version",)),
    (NUMBER, ("threshold", "precision", "recall", "f1_score")),
    MATRIX,
    (NUMBER, ("auc_pr", "roc_auc")),
    (TEXT, ("created_at",)),
)
LONG_MODEL_METRICS_SCHEMA = _struct(
    (TEXT, ("model_version", "metric_name")), (NUMBER, ("metric_value",)), (TEXT, ("created_at",))
)
EXPERIMENT_METRICS_SCHEMA = _struct(
    (TEXT, ("experiment_id", "candidate_id")),
    (WHOLE, ("run_id", "seed")),
    (TEXT, ("split_name",)),
    (NUMBER, ("threshold", "precision", "recall", "f1_score", "auc_pr", "roc_auc")),
    MATRIX,
    (COUNT, ("train_rows", "validation_rows", "test_rows")),
    (FLAG, ("selected_candidate",)),
    (TEXT, ("created_at",)),
)
EXPERIMENT_SUMMARY_SCHEMA = _struct(
    (TEXT, ("experiment_id", "candidate_id", "metric_name", "split_name")),
    (NUMBER, ("mean_value", "sample_stdev")),
    (WHOLE, ("runs",)),
    (FLAG, ("selected_candidate",)),
    (TEXT, ("created_at",)),
)


def layer_tables(spec: TransactionSpec) -> dict[str, LayerTable]:
    tables = (
        LayerTable(
            "bronze.transactions_raw",
            _event_table(spec, spec.bronze_columns),
            spec.ingested_at,
            "ingestion_date",
        ),
        LayerTable(
            "silver.transactions_clean",
            _event_table(spec, spec.silver_columns),
            spec.timestamp,
            "event_date",
        ),
        LayerTable(
            "silver.transactions_features",
            _event_table(spec, spec.feature_table_columns),
            spec.timestamp,
            "event_date",
        ),
        LayerTable("gold.fraud_scores", score_schema(spec), run_columns=SCORING_KEYS),
        LayerTable("gold.fraud_alerts", score_schema(spec), run_columns=SCORING_KEYS),
        LayerTable(
            "gold.fraud_kpis_hourly",
            indicator_schema("metric_window"),
            "metric_window",
            "metric_day",
        ),
        LayerTable(
            "gold.fraud_kpis_daily", indicator_schema("metric_date"), "metric_date", "metric_day"
        ),
        LayerTable("gold.data_quality_metrics", QUALITY_SCHEMA),
        LayerTable("gold.model_metrics", MODEL_METRICS_SCHEMA),
        LayerTable("gold.experiment_metrics", EXPERIMENT_METRICS_SCHEMA),
        LayerTable("gold.experiment_summary", EXPERIMENT_SUMMARY_SCHEMA),
        LayerTable("ml.model_metrics", LONG_MODEL_METRICS_SCHEMA),
    )
    return {table.name: table for table in tables}


def create_tables(
    spark: SparkSession,
    spec: TransactionSpec,
    table_format: str = "parquet",
    catalog: str = "",
    database_prefix: str = "",
) -> list[str]:
    """Create the databases and tables that do not exist yet; returns the table names.

    ``database_prefix`` goes before every database, for several sets of tables in a catalog.
    """
    prefix = (f"{catalog}." if catalog else "") + database_prefix
    for database in DATABASES:
        spark.sql(f"CREATE NAMESPACE IF NOT EXISTS {prefix}{database}")
    created = []
    for table in layer_tables(spec).values():
        columns = ", ".join(
            f"`{field.name}` {field.dataType.simpleString()}" for field in table.stored_schema
        )
        keys = ", ".join(f"`{name}`" for name in table.partition_by)
        partitioned = f" PARTITIONED BY ({keys})" if keys else ""
        name = f"{prefix}{table.name}"
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING {table_format}{partitioned}")
        created.append(name)
    return created


def save_layer(
    df: DataFrame,
    table: LayerTable,
    overwrite: bool = False,
    target: str | None = None,
    rebalance: bool = True,
) -> None:
    """Append to a layer table, or with ``overwrite`` replace the partitions present in ``df``.

    ``target`` is a folder (anything with a slash) or a catalog name; default: the table's
    own name. Replacing in a catalog table relies on dynamic partition overwrite, which
    ``build_session`` sets.

    ``rebalance`` gathers the rows of a partition before writing, so that a thousand tasks
    do not each leave a small file in every date; adaptive execution splits a date that
    holds most rows over many tasks. Turn it off where the rows already arrive by date.
    """
    target = target or table.name
    if overwrite and not table.partition_by:
        raise ValueError(f"{table.name} has no partitions; overwriting would replace all of it.")
    rows = table.laid_out(df)
    if rebalance and table.partition_by:
        rows = rows.hint("rebalance", *[F.col(name) for name in table.partition_by])
    if "/" in target:
        if overwrite:
            replace_partitions(rows, target, table.partition_by)
        else:
            append(rows, target, table.partition_by)
        return
    spark = df.sparkSession
    if overwrite and spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() != "dynamic":
        raise ValueError("Set spark.sql.sources.partitionOverwriteMode=dynamic to replace partitions.")
    insert_into(rows, target, overwrite)


def replace_step(
    df: DataFrame, table: LayerTable, keys: dict[str, str | int], target: str | None = None
) -> None:
    """Replace the single partition named by ``keys``, also when ``df`` has no rows."""
    target = target or table.name
    rows = table.laid_out(df.withColumns({name: F.lit(value) for name, value in keys.items()}))
    if "/" in target:
        replace_leaf(rows, target, keys)
        return
    partition = ", ".join(f"`{name}` = :{name}" for name in keys)
    columns = ", ".join(f"`{name}`" for name in rows.columns if name not in keys)
    df.sparkSession.sql(
        f"INSERT OVERWRITE TABLE {target} PARTITION ({partition}) SELECT {columns} FROM {{rows}}",
        args=dict(keys),
        rows=rows,
    )


def read_layer(
    spark: SparkSession,
    table: LayerTable,
    source: str | None = None,
    missing_is_empty: bool = False,
) -> DataFrame:
    """A layer table by catalog name or folder, with its declared column order.

    With ``missing_is_empty`` a folder nothing was written to yet reads as no rows.
    """
    source = source or table.name
    try:
        rows = (
            spark.read.schema(table.stored_schema).parquet(source)
            if "/" in source
            else spark.table(source)
        )
    except AnalysisException as error:
        if not (missing_is_empty and error.getCondition() == "PATH_NOT_FOUND"):
            raise
        rows = spark.createDataFrame([], table.stored_schema)
    return _declared_order(rows, table)


def read_step(
    spark: SparkSession, table: LayerTable, keys: dict[str, str | int], source: str | None = None
) -> DataFrame:
    """The rows of one step's partition. In a folder only that partition is listed, so the
    cost does not grow with the number of steps already stored."""
    source = source or table.name
    if "/" not in source:
        matches = [F.col(name) == value for name, value in keys.items()]
        return read_layer(spark, table, source).filter(reduce(Column.__and__, matches))
    reader = spark.read.schema(table.stored_schema).option("basePath", source)
    return _declared_order(reader.parquet(leaf_folder(source, keys)), table)


def _declared_order(rows: DataFrame, table: LayerTable) -> DataFrame:
    extra = [name for name in table.partition_by if name not in table.schema.fieldNames()]
    return rows.select(*table.schema.fieldNames(), *extra)
