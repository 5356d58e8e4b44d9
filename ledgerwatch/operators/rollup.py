"""Indicator states that add up: days, weeks and models from stored hours, without the scores.

A state holds, for each period and group, what adds up: counts, sums, and how many scores fall
into each of ``bins`` equal parts of [0, 1]. Any states of disjoint scores may be put together by
adding, in any order and as often as wanted, and the result is the state of all their scores:
nothing is estimated on the way. A quantile read from a state is a bin, [low, high), and the
exact quantile of the scores lies in it: the error of either edge is below 1 / bins, at any level.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerwatch.functions.rates import share
from ledgerwatch.sources.writers import replace_partitions

BINS = 4096
BELOW, ABOVE = -1, -2  # bins of scores under 0 and over 1; NaN counts as over 1

SUMS = ("total_transactions", "predicted_frauds", "suspicious_amount", "score_sum", "scored")
_BIN = T.StructType([T.StructField("bin", T.IntegerType()), T.StructField("n", T.LongType())])


def score_bin(score: Column, bins: int = BINS) -> Column:
    """The part of [0, 1] that a score lies in: 0 .. bins - 1, a score of 1 in the last."""
    inside = F.least(F.floor(score * bins), F.lit(bins - 1)).cast("int")
    return F.when(score.isNull(), F.lit(None).cast("int")).when(score < 0, BELOW).when((score > 1) | F.isnan(score), ABOVE).otherwise(inside)


def hourly_states(
    scores: DataFrame,
    by: Sequence[str] = ("model_version",),
    timestamp: str = "event_timestamp",
    amount: str = "Amount",
    bins: int = BINS,
) -> DataFrame:
    """One state per hour and group.

    Scores are counted by hour, group and bin inside the tasks; what is shuffled is one row per
    task for each of these, however many scores an hour has.
    """
    alerted = F.col("prediction") == 1
    score = F.col("fraud_score")
    counted = scores.groupBy(
        F.date_trunc("hour", timestamp).alias("hour"), *by, score_bin(score, bins).alias("bin")
    ).agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.coalesce(F.sum("prediction"), F.lit(0)).cast("long").alias("predicted_frauds"),
        F.sum(F.when(alerted, F.col(amount)).otherwise(0.0)).alias("suspicious_amount"),
        F.coalesce(F.sum(score), F.lit(0.0)).alias("score_sum"),
        F.count(score).alias("scored"),
    )
    return _gathered(counted, ["hour", *by], "total_transactions")


def _gathered(counted: DataFrame, keys: Sequence[str], rows: str) -> DataFrame:
    """States from rows per key and bin; a NULL score is in no bin."""
    cell = F.when(F.col("bin").isNotNull(), F.struct(F.col("bin"), F.col(rows).alias("n")))
    sums = [F.sum(name).alias(name) for name in SUMS]
    return counted.groupBy(*keys).agg(*sums, F.sort_array(F.collect_list(cell)).alias("histogram"))


def merged(states: DataFrame, keys: Sequence[str | Column]) -> DataFrame:
    """States of coarser ``keys``, or of states that share theirs.

    Takes the states' size to add, not the scores': a state has at most as many cells as bins.
    """
    named = [F.col(k) if isinstance(k, str) else k for k in keys]
    sums = states.groupBy(*named).agg(*[F.sum(name).alias(name) for name in SUMS])
    names = [c for c in sums.columns if c not in SUMS]
    cells = states.select(*named, F.inline("histogram")).groupBy(*names, "bin").agg(F.sum("n").alias("n"))
    bins = cells.groupBy(*names).agg(F.sort_array(F.collect_list(F.struct("bin", "n"))).alias("histogram"))
    # Where all scores are NULL a group has no cells.
    both = sums.join(bins, reduce(Column.__and__, [sums[n].eqNullSafe(bins[n]) for n in names]), "left")
    empty = F.array().cast(T.ArrayType(_BIN))
    return both.select(*[sums[c] for c in sums.columns], F.coalesce("histogram", empty).alias("histogram"))


def quantile_bin(histogram: Column, level: float) -> Column:
    """The bin of the smallest score that at least ``level`` of all scores do not exceed."""
    # Order of score: below 0, the bins, above 1.
    ordered = F.array_sort(F.transform(histogram, lambda c: F.struct(F.when(c["bin"] == ABOVE, 2**30).otherwise(c["bin"]).alias("at"), c["n"].alias("n"))))
    total = F.aggregate(histogram, F.lit(0).cast("long"), lambda s, c: s + c["n"])
    start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("int").alias("bin"))

    def step(state: Column, cell: Column) -> Column:
        seen = state["seen"] + cell["n"]
        reached = state["bin"].isNull() & (seen >= F.ceil(total * level))
        return F.struct(seen.alias("seen"), F.when(reached, cell["at"]).otherwise(state["bin"]).alias("bin"))

    return F.aggregate(ordered, start, step)["bin"]


def with_measures(states: DataFrame, level: float = 0.95, bins: int = BINS) -> DataFrame:
    """States with what dashboards show: mean score, alert rate, and the quantile's bin as
    ``quantile_low`` and ``quantile_high`` (NULL towards a side where scores lie beyond [0, 1])."""
    at = quantile_bin(F.col("histogram"), level)
    found = states.withColumn("_at", at)
    inside = (F.col("_at") >= 0) & (F.col("_at") < bins)
    low = F.when(inside, F.col("_at") / bins).when(F.col("_at") >= bins, 1.0)
    high = F.when(inside, (F.col("_at") + 1) / bins).when(F.col("_at") < 0, 0.0)
    rate = share(F.col("predicted_frauds"), F.col("total_transactions"))
    mean = F.when(F.col("scored") > 0, F.col("score_sum") / F.col("scored"))
    return found.withColumns(
        {"quantile_low": low, "quantile_high": high, "avg_fraud_score": mean, "predicted_fraud_rate": rate}
    ).drop("_at", "histogram", "score_sum", "scored")


def save_states(states: DataFrame, path: str) -> None:
    """Store hourly states by day. Days present in ``states`` are replaced, others stay as they
    are, so recomputing one day rewrites that day alone."""
    rows = states.withColumn("day", F.to_date("hour"))
    replace_partitions(rows.repartition("day"), path, ["day"])


def add_states(states: DataFrame, path: str) -> None:
    """Store states of further scores of hours that may be there already: they add up on reading."""
    rows = states.withColumn("day", F.to_date("hour"))
    rows.repartition("day").write.mode("append").partitionBy("day").parquet(path)
