import math

import pytest
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerwatch.functions import identity, lenient, rates, scores


@pytest.mark.parametrize("tp, fp, expected", [(8, 2, 0.8), (0, 0, 0.0)])
def test_precision(value, tp, fp, expected):
    assert value(rates.precision(F.lit(tp), F.lit(fp))) == expected


@pytest.mark.parametrize("tp, fn, expected", [(9, 1, 0.9), (0, 0, 0.0)])
def test_recall(value, tp, fn, expected):
    assert value(rates.recall(F.lit(tp), F.lit(fn))) == expected


@pytest.mark.parametrize("p, r, expected", [(0.8, 0.5, 0.615385), (0.0, 0.0, 0.0)])
def test_f1(value, p, r, expected):
    assert round(value(rates.f1(F.lit(p), F.lit(r))), 6) == expected


def test_content_id_is_stable_and_sensitive(value):
    def key(*parts):
        return value(identity.content_id([F.lit(part) for part in parts]))

    assert key(1, 2, "A") == key(1, 2, "A")
    assert key(1, 2, "A") != key(1, 2, "B")
    assert len(key(1, 2, "A")) == 64


def test_content_id_keeps_the_place_of_null(value):
    missing = F.lit(None).cast("string")
    first = value(identity.content_id([missing, F.lit("x")]))
    second = value(identity.content_id([F.lit("x"), missing]))
    assert len({first, second, value(identity.content_id([F.lit("x")]))}) == 3


def test_raw_event_key_separates_partitions(value):
    none = F.lit(None).cast("string")
    keys = {value(identity.raw_event_key(none, F.lit(p), F.lit(7))) for p in (0, 1, 2)}
    assert len(keys) == 3


@pytest.mark.parametrize(
    "text, expected", [("1.5", 1.5), ("zz", 0.0), (None, 0.0), ("NaN", 0.0), ("", 0.0)]
)
def test_filled_double(value, text, expected):
    assert value(lenient.filled_double(F.lit(text).cast("string"))) == expected


def test_unreadable_time_falls_back(value):
    fallback = F.lit("2024-01-01 00:00:00").cast("timestamp")
    good = value(lenient.to_timestamp_or(F.lit("2024-05-01T10:00:00+00:00"), fallback))
    bad = value(lenient.to_timestamp_or(F.lit("garbage"), fallback))
    assert (good.month, bad.month) == (5, 1)


def test_strict_double(value):
    assert value(lenient.strict_double(F.lit("2.5"), "x")) == 2.5
    assert value(lenient.strict_double(F.lit(""), "x")) is None
    with pytest.raises(Exception, match="non-numeric"):
        value(lenient.strict_double(F.lit("abc"), "x"))


def test_vector_functions_and_null_vectors(spark):
    schema = T.StructType([T.StructField("v", VectorUDT())])
    rows = spark.createDataFrame([(Vectors.dense(0.3, 0.7),), (None,)], schema)
    got = rows.select(
        scores.vector_item(F.col("v")).alias("item"),
        scores.margin_probability(F.col("v")).alias("probability"),
    ).collect()
    assert got[0]["item"] == 0.7 and got[1]["item"] == 0.0
    assert math.isclose(got[0]["probability"], 1 / (1 + math.exp(-1.4)))
    assert got[1]["probability"] == 0.0


@pytest.mark.parametrize(
    "score, expected", [(0.4, 1), (0.39999, 0), (float("nan"), 1), (None, None)]
)
def test_decision_is_inclusive(value, score, expected):
    assert value(scores.decide(F.lit(score).cast("double"), 0.4)) == expected


@pytest.mark.parametrize(
    "score, bucket", [(-0.1, 0), (0.0, 1), (0.05, 1), (0.1, 2), (0.999, 10), (1.0, 11)]
)
def test_score_bucket(value, score, bucket):
    assert value(scores.score_bucket(F.lit(score))) == bucket


def test_ensemble_is_the_mean(value):
    assert value(scores.ensemble(F.lit(0.2), F.lit(0.6))) == 0.4


def test_packed_ids_stay_different(spark):
    texts = ["ab", "AB", "abc", "ab\n", "", "00", "0", "\x00", "0000", "é", "a" * 64, "1 "]
    rows = spark.createDataFrame([(text,) for text in [*texts, "ab", None]], "id string")
    packed = identity.packed_id(F.col("id"))
    assert rows.agg(F.count_distinct(packed)).first()[0] == len(texts)
    assert rows.filter(packed.isNull()).count() == 1
    assert rows.filter(F.length("id") == 64).select(F.length(packed)).first()[0] == 33
