"""Few large files instead of a folder per scoring step.

Scoring steps write folders ``scoring_run=../scoring_batch_id=..`` (live steps), so that a
repeated step replaces exactly its own rows. Compaction copies older live steps into one folder
per day beside them and then takes the live folders away.

* Rows keep the run and batch of their step. Where a step is both live and compacted, the live
  folder counts: a step that is repeated after it was compacted replaces its rows as before, and
  the next compaction takes the new ones over.
* A compaction first writes the days it changes as new folders, then a list of all valid day
  folders (the newest list counts; its file appears as a whole), and only then removes what it
  replaced. Stopped anywhere in between, a reader sees the same rows as before, and the next run
  finishes the removal.

One compaction may run at a time; streams may go on writing steps meanwhile, since the newest
``keep`` steps of each run are left alone.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Callable
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerwatch.sources.catalog import LayerTable, read_layer
from ledgerwatch.sources.writers import STORED_CODEC

DAY = "compacted_day"
LIST_SCHEMA = "day date, folder string, version long"


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """The newest list of valid day folders."""
    try:
        lists = spark.read.schema(LIST_SCHEMA).parquet(f"{path}-compacted/lists")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], LIST_SCHEMA)
    newest = F.max("version").over(W.partitionBy(F.lit(0)))  # a row per day and list
    return lists.withColumn("_newest", newest).filter("version = _newest and folder is not null").drop("_newest")


def _compacted(spark: SparkSession, table: LayerTable, path: str, folders: list[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], table.stored_schema)
    return spark.read.schema(table.stored_schema).parquet(*[f"{path}-compacted/{f}" for f in folders])


def _without(rows: DataFrame, steps: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``steps`` come from a list of the driver, so they are broadcast: rows stay where they are
    instead of meeting by step."""
    return rows.join(F.broadcast(steps.select(*keys)), list(keys), "left_anti")


def read_compacted(spark: SparkSession, table: LayerTable, path: str) -> DataFrame:
    """All rows of a step table: live steps, and compacted ones that are not live."""
    live = read_layer(spark, table, path, missing_is_empty=True).select(*table.stored_schema.fieldNames())
    folders = [r["folder"] for r in _listed(spark, path).collect()]  # one per day
    if not folders:
        return live
    steps = spark.createDataFrame(_live_steps(spark, table, path), T.StructType(list(table.run_columns)))
    return live.unionByName(_without(_compacted(spark, table, path, folders), steps, table.partition_by))


def _remove(spark: SparkSession, folder: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def _folders(spark: SparkSession, pattern: str) -> list[str]:
    target = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = target.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(target)
    return [str(f.getPath().toString()) for f in found or [] if f.isDirectory()]


def _live_steps(spark: SparkSession, table: LayerTable, path: str) -> list[tuple[str, int]]:
    """(run, batch) of the live folders, those of steps without rows among them."""
    run, batch = table.partition_by
    found = []
    for folder in _folders(spark, f"{path}/{run}=*/{batch}=*"):
        first, second = (unquote(part.split("=", 1)[1]) for part in folder.split("/")[-2:])
        found.append((first, int(second)))
    return found


def compact_steps(
    spark: SparkSession,
    table: LayerTable,
    path: str,
    day_of: str = "scored_at",
    keep: int = 2,
    after_write: Callable[[], None] | None = None,
    after_list: Callable[[], None] | None = None,
) -> int:
    """Compact all live steps but the newest ``keep`` of each run; returns how many.

    Only days that these steps' rows belong to are written anew. ``after_write`` and
    ``after_list`` are called at the two points where a stop leaves work for the next run.
    """
    run, batch = table.partition_by
    live = read_layer(spark, table, path, missing_is_empty=True).select(*table.stored_schema.fieldNames())
    steps = sorted(_live_steps(spark, table, path), reverse=True)
    place = Counter()
    old = [step for step in steps if (place.update([step[0]]) or place[step[0]]) > keep]
    if not old:
        return 0
    chosen = spark.createDataFrame(old, T.StructType(list(table.run_columns)))
    taken = live.join(F.broadcast(chosen), [run, batch], "left_semi").withColumn(DAY, F.to_date(day_of))
    # Days of the steps' rows, and days that hold earlier rows of the same steps.
    valid = {r["day"]: (r["version"], r["folder"]) for r in _listed(spark, path).collect()}
    version = max([v for v, _ in valid.values()], default=0) + 1
    before = _compacted(spark, table, path, [f for _, f in valid.values()]).withColumn(DAY, F.to_date(day_of))
    again = before.join(F.broadcast(chosen), [run, batch], "left_semi").select(DAY)
    days = {r[0] for r in taken.select(DAY).union(again).distinct().collect()}
    stays = before.filter(F.col(DAY).isin([d for d in days if d is not None]) | (F.col(DAY).isNull() if None in days else F.lit(False)))
    names = table.stored_schema.fieldNames()
    rows = taken.select(*names, DAY).unionByName(_without(stays, chosen, (run, batch)).select(*names, DAY))
    name = f"days/{uuid.uuid4().hex}"
    rows.repartition(DAY).write.partitionBy(DAY).parquet(f"{path}-compacted/{name}", compression=STORED_CODEC)
    if after_write:
        after_write()

    def folder(day) -> str:
        return f"{name}/{DAY}={day if day is not None else '__HIVE_DEFAULT_PARTITION__'}"

    written = {r[0] for r in spark.read.parquet(f"{path}-compacted/{name}").select(F.col(DAY).cast("date")).distinct().collect()}
    now = {d: f for d, (_, f) in valid.items() if d not in days} | {d: folder(d) for d in days if d in written}
    listing = [(d, f, version) for d, f in now.items()] or [(None, None, version)]
    lists = f"{path}-compacted/lists"
    spark.createDataFrame(listing, LIST_SCHEMA).coalesce(1).write.mode("append").partitionBy("version").parquet(lists)
    if after_list:
        after_list()
    for step in old:
        _remove(spark, f"{path}/{run}={step[0]}/{batch}={step[1]}")
    # Day folders and lists that count no more, those of stopped runs among them.
    for kind, valid_names in (("days/*", set(now.values())), ("lists", {f"lists/version={version}"})):
        for found in _folders(spark, f"{path}-compacted/{kind}/*"):
            name_in_list = "/".join(found.split("/")[-3 if kind == "days/*" else -2 :])
            if "=" in name_in_list and name_in_list not in valid_names:
                _remove(spark, found)
    return len(old)
