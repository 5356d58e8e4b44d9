"""One row per id, and counts of ids that occur more than once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwatch.session import materialize
from ledgerwatch.sources.writers import STORED_CODEC

BROADCAST_HASHES = 500_000


def keep_first(
    df: DataFrame, key: str, order_by: Sequence[str], columns: Sequence[str] | None = None
) -> DataFrame:
    """The row with the smallest ``order_by`` for each key; remaining ties go by the row itself.

    A minimum over a struct combines on the map side, so a key held by a third of all
    rows sends one row per task over the network. Name only the ``columns`` you need:
    the others are pruned at the scan.
    """
    wanted = list(columns or df.columns)
    rest = [name for name in wanted if name not in (key, *order_by)]
    row = F.struct(*order_by, *rest)
    kept = df.groupBy(key).agg(F.min(row).alias("kept"))
    return kept.select(*[F.col(key) if name == key else F.col(f"kept.`{name}`") for name in wanted])


def keep_first_numbers(
    df: DataFrame, key: str, order_by: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """:func:`keep_first` as a stored table of numbers, for keys most of which occur once.

    Rows are counted per 64-bit hash of their key, with the smallest value of each column. These
    are numbers that a hash aggregate updates in place; the texts of ``key`` and ``order_by`` are
    neither sorted nor shuffled. Where a hash has one row, the smallest values are that row. Only
    rows whose hash has more, by one key or by several, go through :func:`keep_first`.
    """
    keyed = df.withColumn("_hash", F.xxhash64(key))
    counted = keyed.groupBy("_hash").agg(
        F.count(F.lit(1)).alias("_rows"), *[F.min(name).alias(name) for name in columns]
    )
    repeated = F.when(F.col("_rows") > 1, F.col("_hash")).alias("_repeated")
    stored = materialize(counted.select(repeated, *columns), "rows-by-key")
    single = stored.filter(F.col("_repeated").isNull()).select(*columns)
    hashes = materialize(stored.select(F.col("_repeated").alias("_hash")).filter("_hash is not null"), "repeated-keys")
    if hashes.isEmpty():
        return single
    chosen = keep_first(keyed.join(hashes, "_hash", "left_semi"), key, order_by, columns)
    return single.unionByName(materialize(chosen, "chosen-rows"))


def keep_first_stored(
    df: DataFrame, key: str, order_by: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """:func:`keep_first` as a stored table, for keys most of which occur once.

    Rows are counted per 64-bit hash of their key, so that only hashes are shuffled. A row whose
    hash occurs once is stored as it is; the others, by one key or by several, go through
    :func:`keep_first`. Hashes that occur more often are broadcast after they were counted; where
    they are too many for that, all rows go through :func:`keep_first`.
    """
    keyed = df.withColumn("_hash", F.xxhash64(key))
    counted = keyed.groupBy("_hash").agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > 1)
    hashes = materialize(counted.select("_hash"), "repeated-keys")
    repeated = hashes.count()
    if repeated > BROADCAST_HASHES:
        kept = keep_first(df, key, order_by, columns)
    elif repeated:
        few = F.broadcast(hashes)
        single = keyed.join(few, "_hash", "left_anti").select(*columns)
        chosen = keep_first(keyed.join(few, "_hash", "left_semi"), key, order_by, columns)
        kept = single.unionByName(chosen)
    else:
        kept = df.select(*columns)
    return materialize(kept, "training-rows", codec=STORED_CODEC)


def repeated_ids(df: DataFrame, key: str) -> DataFrame:
    """Ids with more than one row and their row counts; NULL counts as an id."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)


def repeated_id_count(df: DataFrame, key: str) -> DataFrame:
    return repeated_ids(df, key).agg(F.count(F.lit(1)).alias("duplicate_ids"))


def conflicting_label_count(df: DataFrame, key: str, label: str = "label") -> DataFrame:
    """How many ids carry both labels: the rows a one-per-id rule decides between."""
    per_id = df.groupBy(key).agg(F.min(label).alias("low"), F.max(label).alias("high"))
    return per_id.filter(F.col("low") < F.col("high")).agg(
        F.count(F.lit(1)).alias("conflicting_ids")
    )
