import pytest
from pyspark.sql import functions as F

from ledgerwatch import TransactionSpec
from ledgerwatch.operators import classes, duplicates, schema, silver
from ledgerwatch.operators.summary import run_summary

CARD = TransactionSpec()
SMALL = TransactionSpec(features=("Time", "Amount"))
COLUMNS = "transaction_id string, event_time string, Time string, Amount string, Class string, n int"


@pytest.fixture(scope="module")
def cleaned(spark):
    rows = [
        ("given", "2024-01-01T00:00:00+00:00", "1", "2.5", "0", 1),
        (None, "garbage", "1", None, "1", 2),
        (None, None, None, "1", "1.0", 3),
        ("x", None, "zz", "NaN", "0", 4),
        ("dropped", None, "1", "1", "2", 5),
        ("dropped too", None, "1", "1", None, 6),
        ("and this", None, "1", "1", "no label", 7),
    ]
    frame = spark.createDataFrame(rows, COLUMNS)
    fallback = F.lit("2024-03-01 00:00:00").cast("timestamp")
    return {row["n"]: row for row in silver.clean(frame, SMALL, fallback).collect()}


def test_card_features():
    assert (len(CARD.features), CARD.features[0], CARD.features[-1]) == (30, "Time", "Amount")


def test_missing_columns_keep_their_order():
    missing = schema.missing_columns(["Time", "Amount", "Class"], CARD)
    assert "V1" in missing and "Class" not in missing
    assert missing == [f"V{i}" for i in range(1, 29)]


def test_required_columns_raise():
    with pytest.raises(ValueError, match="V1, V2"):
        schema.require_columns(["Time", "Amount"], CARD)


def test_layer_widths():
    assert len(CARD.bronze_columns) == 39
    assert len(CARD.silver_columns) == 42
    assert len(CARD.feature_table_columns) == 43
    assert len(CARD.score_columns) == 12


def test_clean_keeps_only_known_labels(cleaned):
    assert sorted(cleaned) == [1, 2, 3, 4]


def test_clean_fills_what_is_no_number(cleaned):
    assert (cleaned[1]["Time"], cleaned[1]["Amount"]) == (1.0, 2.5)
    assert cleaned[2]["Amount"] == 0.0
    assert (cleaned[4]["Time"], cleaned[4]["Amount"]) == (0.0, 0.0)


def test_clean_derives_ids_before_filling(cleaned):
    assert cleaned[1]["transaction_id"] == "given"
    assert len(cleaned[2]["transaction_id"]) == 64
    assert cleaned[2]["transaction_id"] != cleaned[3]["transaction_id"]


def test_clean_times(cleaned):
    assert cleaned[1]["event_timestamp"].month == 1
    assert cleaned[2]["event_timestamp"].month == 3
    assert cleaned[3]["event_timestamp"].month == 3


def test_clean_without_an_id_column(spark):
    rows = spark.createDataFrame([("t", "1", "2", "1")], "event_time string, Time string, Amount string, Class string")
    row = silver.clean(rows, SMALL).first()
    assert len(row["transaction_id"]) == 64


def test_clean_defaults_to_the_clock(spark):
    rows = spark.createDataFrame([("a", "never", "1", "2", "1", 1)], COLUMNS)
    assert silver.clean(rows, SMALL).filter("event_timestamp >= current_date()").count() == 1


def test_balanced_weights(spark):
    labels = spark.range(1000).select(F.when(F.col("id") < 10, 1.0).otherwise(0.0).alias("label"))
    weights = classes.balanced_weights(labels)
    assert weights.positive == 50.0
    assert round(weights.legit, 6) == round(1000 / 1980, 6)


def test_weights_need_both_classes(spark):
    one_class = spark.range(100).select(F.lit(0.0).alias("label"))
    with pytest.raises(ValueError):
        classes.balanced_weights(one_class)
    with pytest.raises(ValueError):
        classes.balanced_weights(one_class.limit(0))


def test_class_weight_of_an_unknown_label(spark):
    rows = spark.createDataFrame([(0.0,), (1.0,), (None,)], "label double")
    got = [row["class_weight"] for row in silver.with_class_weight(rows, 0.5, 50.0, CARD).collect()]
    assert got == [0.5, 50.0, 0.5]


def test_feature_array(spark):
    rows = spark.createDataFrame([(1.0, 2.0)], "Time double, Amount double")
    assert silver.with_feature_array(rows, SMALL).first()["feature_array"] == [1.0, 2.0]


def test_keep_first_is_deterministic_under_skew(spark):
    """One id holds most rows; the survivor does not depend on the layout."""
    rows = spark.range(3000).select(
        F.when(F.col("id") < 2000, "hot").otherwise(F.col("id").cast("string")).alias("k"),
        F.sha2(F.col("id").cast("string"), 256).alias("raw"),
        F.col("id").alias("n"),
    )
    results = [
        sorted(map(tuple, duplicates.keep_first(frame, "k", ["raw"]).collect()))
        for frame in (rows, rows.repartition(7, "raw"), rows.orderBy(F.desc("n")))
    ]
    assert results[0] == results[1] == results[2]
    assert len(results[0]) == 1001


def test_keep_first_treats_null_as_one_key(spark):
    rows = spark.createDataFrame([(None, "b", 1), (None, "a", 2), ("x", "c", 3)], "k string, raw string, n int")
    kept = {row["k"]: row["n"] for row in duplicates.keep_first(rows, "k", ["raw"]).collect()}
    assert kept == {None: 2, "x": 3}


@pytest.mark.parametrize("collide", [False, True])
def test_keep_first_of_numbers_keeps_the_same_rows(spark, monkeypatch, collide):
    """Single, repeated and null keys, null and NaN values, one hot key, equal hashes of several keys."""
    if collide:
        monkeypatch.setattr(duplicates.F, "xxhash64", lambda key: F.coalesce(F.length(key), F.lit(0)))
    key = F.when(F.col("id") < 600, "hot").when(F.col("id") % 50 != 0, (F.col("id") - F.col("id") % 3 % 2).cast("string"))
    rows = spark.range(2000).select(
        key.alias("k"),
        F.sha2((F.col("id") % 1990).cast("string"), 256).alias("raw"),
        F.when(F.col("id") % 7 != 0, F.col("id") * 1.0).alias("n"),
        F.when(F.col("id") % 5 == 0, float("nan")).otherwise(1.0).alias("x"),
    )
    text = lambda df: sorted(map(str, df.collect()))
    want = text(duplicates.keep_first(rows, "k", ["raw"], ["n", "x"]))
    assert text(duplicates.keep_first_numbers(rows, "k", ["raw"], ["n", "x"])) == want
    alone = rows.filter("try_cast(k AS double) = n AND n % 3 = 2")
    assert text(duplicates.keep_first_numbers(alone, "k", ["raw"], ["n", "x"])) == text(alone.select("n", "x"))


def test_repeated_and_conflicting_ids(spark):
    rows = spark.createDataFrame(
        [("a", 0.0), ("a", 1.0), ("b", 0.0), ("b", 0.0), ("c", 1.0), (None, 0.0), (None, 0.0)],
        "k string, label double",
    )
    assert duplicates.repeated_id_count(rows, "k").first()[0] == 3
    assert duplicates.conflicting_label_count(rows, "k").first()[0] == 1


def test_summary_mean_and_sample_stdev(spark):
    runs = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "v double").withColumn("g", F.lit("x"))
    row = run_summary(runs, ("g",), {"v": "v"}).first()
    assert (row["mean_value"], round(row["sample_stdev"], 6), row["runs"]) == (2.0, 1.0, 3)
    single = run_summary(runs.limit(1), ("g",), {"v": "v"}).first()
    assert (single["sample_stdev"], single["runs"]) == (0.0, 1)
    assert run_summary(runs.limit(0), ("g",), {"v": "v"}).count() == 0


@pytest.mark.parametrize("collide, limit", [(False, 1_000), (True, 1_000), (False, 0)])
def test_keep_first_stored_keeps_the_same_rows(spark, monkeypatch, collide, limit):
    """Single, repeated and null keys, one hot key, equal hashes of several keys, too many to broadcast."""
    if collide:
        monkeypatch.setattr(duplicates.F, "xxhash64", lambda key: F.coalesce(F.length(key), F.lit(0)))
    monkeypatch.setattr(duplicates, "BROADCAST_HASHES", limit)
    key = F.when(F.col("id") < 600, "hot").when(F.col("id") % 50 != 0, (F.col("id") - F.col("id") % 3 % 2).cast("string"))
    rows = spark.range(2000).select(
        key.alias("k"),
        F.sha2((F.col("id") % 1990).cast("string"), 256).alias("raw"),
        F.when(F.col("id") % 7 != 0, F.col("id") * 1.0).alias("n"),
        F.when(F.col("id") % 5 == 0, float("nan")).otherwise(1.0).alias("x"),
    )
    text = lambda df: sorted(map(str, df.collect()))
    names = ["k", "n", "x"]
    want = text(duplicates.keep_first(rows, "k", ["raw"], names))
    assert text(duplicates.keep_first_stored(rows, "k", ["raw"], names)) == want
    alone = rows.filter("try_cast(k AS double) = n AND n % 3 = 2")
    assert text(duplicates.keep_first_stored(alone, "k", ["raw"], names)) == text(alone.select(names))
