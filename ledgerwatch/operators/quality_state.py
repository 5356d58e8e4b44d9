"""Data-quality reports from stored parts: a report over all of a table reads what is new only.

Every part of a table (a partition value) has rows of the report's own metrics, which add up
over parts, and a sketch of its ids, which unites. Duplicate ids do not add up: an id may recur
in another part. So the state tells how many distinct ids there are about, and rows less that is
how many rows repeat an id.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwatch.sources.writers import replace_partitions

STATE_SCHEMA = "metric_name string, metric_dimension string, metric_value double, ids binary, table_name string, part string"
# log2 of the sketch's registers: a standard error of 1.04 / sqrt(2 ** 14), 0.8 %.
REGISTERS = 14
DISTINCT = "distinct_transaction_id"


def part_states(df: DataFrame, part: str, id_col: str | None = None, class_col: str | None = None) -> DataFrame:
    """Long rows for each value of ``part``, from one pass: row and null counts of every column,
    rows per class, and a sketch of the ids."""
    columns = [c for c in df.columns if c != part]
    keys = [F.col(part).cast("string").alias("part")]
    if class_col:
        shown = F.when(F.col(class_col).isNull(), "None").otherwise(F.col(class_col).cast("string"))
        keys.append(shown.alias("class"))
    nulls = [F.count_if(F.col(f"`{c}`").isNull()).alias(f"nulls_{i}") for i, c in enumerate(columns)]
    sketch = F.hll_sketch_agg(F.col(id_col).cast("string"), REGISTERS) if id_col else F.lit(None).cast("binary")
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), *nulls, sketch.alias("ids"))

    def row(name: str, dimension, value, ids=None):
        return F.struct(
            F.lit(name).alias("metric_name"),
            dimension.cast("string").alias("metric_dimension"),
            value.cast("double").alias("metric_value"),
            (F.lit(None).cast("binary") if ids is None else ids).alias("ids"),
        )

    rows = [row("row_count", F.lit("*"), F.col("rows"))]
    rows += [row("null_count", F.lit(c), F.col(f"nulls_{i}")) for i, c in enumerate(columns)]
    if class_col:
        rows.append(row("class_distribution", F.col("class"), F.col("rows")))
    if id_col:
        rows.append(row(DISTINCT, F.lit(id_col), F.lit(0), F.col("ids")))
    long = counted.select("part", F.inline(F.array(*rows)))
    return _added(long, ["part"])


def _added(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts added, sketches united."""
    grouped = rows.groupBy(*keys, "metric_name", "metric_dimension")
    return grouped.agg(F.sum("metric_value").alias("metric_value"), F.hll_union_agg("ids").alias("ids"))


def read_states(spark: SparkSession, path: str, table_name: str) -> DataFrame:
    try:
        stored = spark.read.schema(STATE_SCHEMA).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        stored = spark.createDataFrame([], STATE_SCHEMA)
    return stored.filter(F.col("table_name") == table_name)


def update_states(
    df: DataFrame, table_name: str, part: str, path: str, id_col: str | None = None, class_col: str | None = None
) -> list:
    """Read the parts of ``df`` whose number of rows changed, and store their states; returns them.

    ``df`` is partitioned by ``part``, so row counts come from file footers. States lie in a
    folder per table and part; those of other parts stay as they are, also of parts that the
    table has no more. A part rewritten with as many rows is not noticed.
    """
    spark = df.sparkSession
    counts = df.groupBy(part).agg(F.count(F.lit(1)).cast("double").alias("rows"))
    now = counts.select(F.col(part).cast("string").alias("part"), F.col(part).alias("value"), "rows")
    known = read_states(spark, path, table_name).filter("metric_name = 'row_count'")
    known = known.select(F.col("part").alias("known_part"), "metric_value")
    same = F.col("part").eqNullSafe(F.col("known_part"))
    differ = now.join(known, same, "left").filter("metric_value is null or rows != metric_value")
    changed = [r["value"] for r in differ.collect()]  # a row per part
    if changed:
        wanted = F.col(part).isin([v for v in changed if v is not None])
        fresh = df.filter(wanted | F.col(part).isNull() if None in changed else wanted)
        rows = part_states(fresh, part, id_col, class_col).withColumn("table_name", F.lit(table_name))
        rows = rows.select("metric_name", "metric_dimension", "metric_value", "ids", "table_name", "part")
        replace_partitions(rows.repartition("part"), path, ["table_name", "part"])
    return changed


def state_report(spark: SparkSession, path: str, table_name: str, created_at: str) -> DataFrame:
    """The report of a table from its stored states."""
    whole = _added(read_states(spark, path, table_name), [])
    # Uniting no sketches gives an empty one: only the ids' metric has any.
    estimate = F.when(F.col("metric_name") == DISTINCT, F.hll_sketch_estimate("ids").cast("double"))
    return whole.select(
        F.lit(table_name).alias("table_name"),
        "metric_name",
        "metric_dimension",
        F.coalesce(estimate, "metric_value").alias("metric_value"),
        F.lit(created_at).alias("created_at"),
    )
