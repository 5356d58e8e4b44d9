"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

# Only settings the results depend on, or that every deployment wants. Cluster sizing
# (executors, memory, shuffle partitions) belongs to spark-submit and is not set here.
SESSION_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A percentile over more groups than this per task falls back to sorting all rows; the
    # default of 128 is less than the hours of a week.
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "65536",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
    # Recording the Python call site of every expression doubles the time it takes to
    # build a plan over many columns. Turn it on when looking for the line of an error.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app_name: str, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    for key, value in {**SESSION_SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, named by ``spark.checkpoint.dir``.

    A local session without that setting gets a temporary folder; a cluster session
    without it is an error, since a machine-local folder would lose data there.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("Set spark.checkpoint.dir to a folder shared by all executors.")
    folder = tempfile.mkdtemp(prefix="ledgerwatch-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


@dataclass
class Scratch:
    """The intermediate results of one piece of work, to be removed together when it is done."""

    name: str = field(default_factory=lambda: f"work-{uuid.uuid4().hex}")
    tables: list[str] = field(default_factory=list)

    def folder(self, spark: SparkSession) -> str:
        return f"{shared_folder(spark)}/ledgerwatch/{self.name}"

    def holds(self, df: DataFrame) -> bool:
        """Whether ``df`` reads any of them."""
        return any(f"/{self.name}/" in path for path in df.inputFiles())

    def remove(self, spark: SparkSession) -> None:
        for table in self.tables:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        target = spark._jvm.org.apache.hadoop.fs.Path(self.folder(spark))
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


_scratch: ContextVar[Scratch | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch_work() -> Iterator[Scratch]:
    """Paths and tables that are made inside belong to one piece of work."""
    work = Scratch()
    token = _scratch.set(work)
    try:
        yield work
    finally:
        _scratch.reset(token)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder."""
    work = _scratch.get()
    base = work.folder(spark) if work else f"{shared_folder(spark)}/ledgerwatch"
    return f"{base}/{label}-{uuid.uuid4().hex}"


def scratch_table(label: str) -> str:
    """A fresh name for a catalog table over a scratch path."""
    name, work = f"{label}_{uuid.uuid4().hex}", _scratch.get()
    if work:
        work.tables.append(name)
    return name


def materialize(
    df: DataFrame, label: str, partition_by: tuple[str, ...] = (), codec: str | None = None
) -> DataFrame:
    """Write a reused intermediate result to the shared folder and read it back.

    Lineage ends at the written files, so a lost executor costs a re-read, and later
    reads are column-pruned and carry sizes the optimizer can plan joins with.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)
