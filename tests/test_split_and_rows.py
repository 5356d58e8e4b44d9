import random

import pytest
from pyspark.sql import functions as F

from ledgerwatch import SplitFractions, TransactionSpec
from ledgerwatch.operators import rowindex, split

SPEC = TransactionSpec(features=("Time", "Amount"))


def timed(spark, times, label=lambda i: float(i % 2)):
    rows = [(f"id{i}", float(t), label(i)) for i, t in enumerate(times)]
    return spark.createDataFrame(rows, "transaction_id string, Time double, label double")


@pytest.mark.parametrize("exact", [True, False])
def test_blocks_are_disjoint_and_cover(spark, exact):
    rng = random.Random(3)
    frame = timed(spark, [rng.randint(0, 300) for _ in range(1000)])
    cuts = split.time_cuts(frame, SPEC, SplitFractions(), exact=exact)
    blocks = split.with_block(frame, SPEC, cuts)
    assert blocks.count() == 1000
    ends = {
        row["block"]: (row["low"], row["high"])
        for row in blocks.groupBy("block").agg(F.min("Time").alias("low"), F.max("Time").alias("high")).collect()
    }
    assert ends["train"][1] < cuts.validation_from == ends["validation"][0]
    assert ends["validation"][1] < cuts.test_from == ends["test"][0]
    counted = split.check_blocks(split.block_counts(blocks))
    assert sum(counted.values()) == 1000


def test_a_tie_at_a_cut_goes_to_the_later_block(spark):
    frame = timed(spark, [1, 2, 3, 3, 3, 4, 5])
    blocks = split.with_block(frame, SPEC, split.TimeCuts(3.0, 4.0))
    counted = {r["block"]: r["count"] for r in blocks.groupBy("block").count().collect()}
    assert counted == {"train": 2, "validation": 3, "test": 2}


def test_missing_times_belong_to_no_block(spark):
    frame = timed(spark, [1, 2]).withColumn("Time", F.when(F.col("Time") > 1, F.col("Time")))
    assert split.with_block(frame, SPEC, split.TimeCuts(1.5, 3.0)).count() == 1


def test_one_time_only_cannot_be_split(spark):
    with pytest.raises(ValueError, match="cut points"):
        split.time_cuts(timed(spark, [7] * 20), SPEC, SplitFractions())


def test_no_rows_cannot_be_split(spark):
    for exact in (True, False):
        with pytest.raises(ValueError):
            split.time_cuts(timed(spark, [1]).limit(0), SPEC, SplitFractions(), exact=exact)


def test_each_block_needs_both_labels(spark):
    frame = timed(spark, range(100), label=lambda i: float(i % 2) if i < 80 else 0.0)
    blocks = split.with_block(frame, SPEC, split.TimeCuts(60.0, 80.0))
    with pytest.raises(ValueError, match="both labels: test"):
        split.check_blocks(split.block_counts(blocks))


def test_an_empty_block_is_an_error(spark):
    blocks = split.with_block(timed(spark, range(10)), SPEC, split.TimeCuts(5.0, 50.0))
    with pytest.raises(ValueError, match="without rows: test"):
        split.check_blocks(split.block_counts(blocks))


def test_time_range_is_half_open(spark):
    frame = timed(spark, range(10))
    assert split.time_range(frame, SPEC, 2.0, 5.0).count() == 3
    assert split.time_range(frame, SPEC, None, 5.0).count() == 5
    assert split.time_range(frame, SPEC, 5.0, None).count() == 5


def test_row_numbers_follow_the_order(spark):
    rng = random.Random(8)
    order = list(range(2000))
    rng.shuffle(order)
    frame = spark.createDataFrame([(float(v), v) for v in order], "Time double, n long").repartition(5)
    indexed = rowindex.with_row_index(frame, ["Time"])
    assert indexed.filter("row_index <> n").count() == 0


def test_row_numbers_of_equal_rows_spread_over_files(spark, folder, monkeypatch):
    """Two thirds of the rows are the same; they still get distinct numbers from many files."""
    path = folder()
    monkeypatch.setattr(rowindex, "scratch_path", lambda *_: path)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        time = F.when(F.col("id") < 20_000, 1.0).otherwise(F.col("id").cast("double"))
        indexed = rowindex.with_row_index(spark.range(30_000).select(time.alias("Time")), ["Time"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    numbers = indexed.agg(F.count_distinct("row_index"), F.min("row_index"), F.max("row_index")).first()
    assert tuple(numbers) == (30_000, 0, 29_999)
    per_file = spark.read.parquet(path).filter("Time = 1").groupBy(F.input_file_name()).count()
    assert per_file.count() > 1 and per_file.agg(F.max("count")).first()[0] < 15_000


def test_row_slices(spark):
    indexed = spark.range(100).withColumnRenamed("id", "row_index")
    assert rowindex.row_slice(indexed, 10, 5).count() == 5
    assert rowindex.row_slice(indexed, 90, 0).count() == 10
    assert rowindex.row_slice(indexed, 95, 50).count() == 5
