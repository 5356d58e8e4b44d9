"""Deployed models as rows of a table: append a version, look up the latest."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import types as T

from ledgerwatch.operators.selection import latest

_NUMBERS = T.MapType(T.StringType(), T.DoubleType())
_ROWS = T.MapType(T.StringType(), T.LongType())

REGISTRY_SCHEMA = T.StructType(
    [
        T.StructField("model_version", T.StringType(), False),
        T.StructField("model_base_path", T.StringType()),
        T.StructField("rf_model_path", T.StringType()),
        T.StructField("gbt_model_path", T.StringType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("threshold_policy", T.StringType()),
        T.StructField("training_timestamp", T.TimestampType()),
        T.StructField("feature_columns", T.ArrayType(T.StringType())),
        T.StructField("class_weights", _NUMBERS),
        T.StructField("experiment_id", T.StringType()),
        T.StructField("protocol", T.StringType()),
        T.StructField("time_cut_points", _NUMBERS),
        T.StructField("split_rows", _ROWS),
        T.StructField("candidate_id", T.StringType()),
        T.StructField("seeds", T.ArrayType(T.LongType())),
        T.StructField("test_summary", _NUMBERS),
    ]
)


@dataclass(frozen=True)
class ModelRecord:
    model_version: str
    model_base_path: str
    rf_model_path: str
    gbt_model_path: str
    threshold: float
    threshold_policy: str
    training_timestamp: object
    feature_columns: list[str]
    class_weights: dict[str, float]
    experiment_id: str
    protocol: str = ""
    time_cut_points: dict[str, float] = field(default_factory=dict)
    split_rows: dict[str, int] = field(default_factory=dict)
    candidate_id: str = ""
    seeds: list[int] = field(default_factory=list)
    test_summary: dict[str, float] = field(default_factory=dict)


def register(spark: SparkSession, path: str, record: ModelRecord) -> None:
    rows = spark.createDataFrame([asdict(record)], REGISTRY_SCHEMA)
    rows.coalesce(1).write.mode("append").parquet(path)


def versions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REGISTRY_SCHEMA).parquet(path)


def latest_model(registry: DataFrame) -> Row:
    """The newest version's row; an empty registry is an error."""
    found = latest(registry, ["training_timestamp", "model_version"]).first()
    if found is None:
        raise LookupError("No model is registered yet; run the training plan first.")
    return found
