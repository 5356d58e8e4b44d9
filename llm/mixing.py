"""Mix sources to target weights: hash-threshold histograms.

Every row has a 60-bit hash of its id and text. A source whose target is r times its size takes
``floor(r)`` copies of all its rows, and one more of the rows whose hash lies up to a
threshold. The threshold comes from histograms: sizes are summed by source and by the hash's
leading bits, the running sum finds the bucket in which the budget runs out, and the next
histogram refines only that bucket of each source, with the next bits, until it holds one hash.
A row is then taken or left by comparing its hash: nothing is sorted, and the same rows are
chosen whatever the partitions. For a larger budget the threshold is larger, so mixes nest.

What travels is one row per source and bucket and task, so a source with a third of all rows is
a few thousand sums like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from llm.rows import parts_of, stored, unwrapped, wrapped
from llm.text import WORD

HASH_BITS = 60
STEP_BITS = 12


def word_count(text: str) -> Column:
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")


def row_hash(id_col: str, text_col: str) -> Column:
    """The leading 60 bits of the md5 of id and text. Rows that agree in both are taken alike."""
    name = F.concat(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(" "), F.coalesce(F.col(text_col), F.lit(""))
    )
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, 15), 16, 10).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """Add ``place``: the source's place from 0 in code point order, null last. Ranges are
    numbered each for itself and shifted by the rows of the ranges before them."""
    parts = parts_of(sources.sparkSession)
    dealt = sources.repartitionByRange(parts, F.col("source").isNull(), "source")
    dealt = stored(dealt.withColumn("range", F.spark_partition_id()), "sources")
    inside = F.row_number().over(W.partitionBy("range").orderBy(F.col("source").asc_nulls_last()))
    ahead = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    sizes = dealt.groupBy("range").agg(F.count("*").alias("n"))
    sizes = sizes.select("range", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    place = F.col("before") + F.col("inside") - 1
    return dealt.withColumn("inside", inside).join(sizes, "range").select("source", "source_size", place.alias("place"))


def targets(sources: DataFrame, weights: Sequence[int], share: tuple[int, int], cap: int) -> DataFrame:
    """Add ``target``: shares of ``share`` (numerator, denominator) of all sizes by weight, none
    above ``cap`` times its source's size; what that cuts off goes to the others by weight.

    A round caps every source above its limit and shares the rest anew. Only sums and counts
    reach the driver, and every round caps a source or is the last.
    """
    top, below = share
    w = F.get(F.array(*[F.lit(int(x)) for x in weights]), (F.col("place") % len(weights)).cast("int"))
    weighted = stored(sources.withColumn("weight", w.cast("long")), "weighted")
    total = weighted.agg(F.sum("source_size")).first()[0] or 0
    # A source is capped once weight * budget >= cap * size * open weight: whole numbers only.
    budget, open_weight, capped = top * total, 0, -1
    need = F.col("source_size").cast("decimal(38,0)") * below * cap
    full = F.lit(False)
    while True:
        row = weighted.agg(
            F.sum(F.when(full, 1).otherwise(0)).alias("n"),
            F.sum(F.when(full, F.col("source_size")).otherwise(0)).alias("held"),
            F.sum(F.when(full, 0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if (row["n"] or 0) == capped or not row["open"]:
            open_weight = row["open"] or 0
            budget = top * total - below * cap * (row["held"] or 0)
            break
        capped, open_weight = row["n"], row["open"]
        budget = top * total - below * cap * row["held"]
        full = need * open_weight < F.col("weight").cast("decimal(38,0)") * budget
    limit = F.col("source_size").cast("double") * cap
    shared = F.col("weight") * F.lit(float(budget)) / F.lit(float(below * max(1, open_weight)))
    return weighted.withColumn("target", F.when(full, limit).otherwise(shared))


def thresholds(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """source, source_size, target, copies and upto: all rows are taken ``copies`` times, those
    with a hash of at most ``upto`` once more. ``rows`` (source, size, h) is a stored table.

    The sum up to the threshold is as near to the budget as whole rows allow, the smaller one if
    two are as near.
    """
    size = F.col("source_size")
    copies = F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long")
    state = sources.select("source", "source_size", "target", copies.alias("copies"))
    # Taken for certain so far, and the leading bits of the bucket that is still open.
    state = state.select(
        "*", (F.col("target") - F.col("copies") * size).alias("left"), F.lit(0).cast("long").alias("prefix"),
        (F.col("target") > F.col("copies") * size).alias("open"), F.lit(-1).cast("long").alias("upto"),
    )
    state = stored(state, "budgets")
    for shift in range(HASH_BITS - STEP_BITS, -1, -STEP_BITS):
        wide = shift + STEP_BITS
        open_now = state.where("open").select(F.col("source").alias("s"), "prefix", "left")
        inside = (F.shiftright("h", wide) == F.col("prefix")) if wide < HASH_BITS else F.lit(True)
        met = rows.join(open_now, rows["source"].eqNullSafe(F.col("s")) & inside)
        bucket = F.shiftright("h", shift).alias("bucket")
        sums = met.groupBy("s", bucket).agg(F.sum("size").alias("size"), F.first("left").alias("left"))
        # At most 2^STEP_BITS buckets a source.
        along = W.partitionBy("s").orderBy("bucket").rowsBetween(W.unboundedPreceding, W.currentRow)
        sums = sums.withColumn("total", F.sum("size").over(along))
        whole = F.col("total") <= F.col("left")
        crossing = F.struct("bucket", (F.col("total") - F.col("size")).alias("ahead"), "size")
        found = sums.groupBy(F.col("s").alias("found_source")).agg(
            F.min(F.when(~whole, crossing)).alias("cross"), F.max(F.when(whole, F.col("bucket"))).alias("last")
        )
        joined = state.join(found, F.col("open") & state["source"].eqNullSafe(F.col("found_source")), "left")
        hit = F.col("cross").isNotNull()
        rest = F.col("left") - F.coalesce(F.col("cross.ahead"), F.lit(0))
        # The whole buckets before the crossing one are taken; the crossing one is refined.
        taken_upto = F.greatest(
            F.col("upto"), F.shiftleft(F.coalesce(F.col("last"), F.lit(-1)) + 1, shift) - 1
        )
        upto = F.when(F.col("open") & F.col("last").isNotNull(), taken_upto).otherwise(F.col("upto"))
        if shift == 0:  # one hash is left: take it if that comes nearer
            nearer = hit & (F.col("cross.size") - rest < rest)
            upto = F.when(nearer, F.col("cross.bucket")).otherwise(upto)
        state = joined.select(
            "source", "source_size", "target", "copies", F.when(hit, rest).otherwise(F.col("left")).alias("left"),
            F.when(hit, F.col("cross.bucket")).otherwise(F.col("prefix")).alias("prefix"),
            (F.col("open") & hit).alias("open"), upto.alias("upto"),
        )
        state = stored(state, "thresholds")
    return state.select("source", "source_size", "target", "copies", "upto")


def plan_mix(
    docs: DataFrame, weights: Sequence[int] = (3, 1, 2), share: tuple[int, int] = (3, 2), cap: int = 2,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """The stored sizes and hashes of all rows, and the thresholds of all sources."""
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text_col).alias("size"),
        row_hash(id_col, text_col).alias("h"),
    )
    rows = stored(rows, "sizes")
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    return rows, thresholds(rows, targets(ranked(sources), weights, share, cap))


def mix_sizes(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, copies.

    A null text has size 0; a null source is a source of its own, behind the others. A document
    is taken whole, ``copies`` times. Rows that repeat id and text are taken alike. Sources
    without words have target 0. An empty table gives no rows. Other columns are not read.
    """
    rows, limits = plan_mix(docs, **options)
    limits = limits.withColumnRenamed("source", "s").withColumnRenamed("copies", "whole")
    joined = rows.join(limits, rows["source"].eqNullSafe(F.col("s")))
    copies = F.col("whole") + F.when(F.col("h") <= F.col("upto"), 1).otherwise(0)
    taken = (F.col("size") * copies).cast("long")
    return joined.select("doc_id", "size", "source_size", "target", taken.alias("taken"), copies.alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed documents, with the columns of ``docs``: each row as often as the mix takes it."""
    names = {"id_col": id_col, "text_col": text_col, "source_col": source_col}
    _, limits = plan_mix(docs, **names, **options)
    limits = limits.select(F.col("source").alias("name"), F.col("copies").alias("whole"), "upto")
    key, source = row_hash(f"doc.`{id_col}`", "text"), F.col(f"doc.`{source_col}`")
    joined = wrapped(docs, text_col).withColumn("h", key).join(limits, source.eqNullSafe(F.col("name")))
    copies = (F.col("whole") + F.when(F.col("h") <= F.col("upto"), 1).otherwise(0)).cast("int")
    return unwrapped(joined.withColumn("copy", F.explode(F.array_repeat(F.lit(1), copies))), docs, text_col)
