import math
import random
from fractions import Fraction

import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from ledgerwatch.operators import curves, evaluation, ordered, quantiles, selection
from ledgerwatch.session import materialize
from ledgerwatch.spec import (
    BEST_F1,
    DEFAULT_THRESHOLDS,
    RECALL_WITH_FLOOR_ALIAS,
    ExperimentSpec,
    ThresholdPolicy,
)


def scored_rows(spark, seed, size, groups=("a", "b"), hot=True):
    """Random scores; in one group two thirds share one score, another holds few rows."""
    rng = random.Random(seed)
    rows = []
    for i in range(size):
        group = groups[0] if rng.random() < 0.8 else groups[-1]
        score = 0.3 if hot and rng.random() < 0.6 else round(rng.random(), rng.choice([1, 2, 6]))
        rows.append((group, score, float(rng.random() < score)))
    return rows, spark.createDataFrame(rows, "g string, fraud_score double, label double")


def brute_matrix(rows, threshold):
    hit = [(s >= threshold, y) for s, y in rows]
    return (
        sum(h and y == 1 for h, y in hit),
        sum(h and y == 0 for h, y in hit),
        sum(not h and y == 0 for h, y in hit),
        sum(not h and y == 1 for h, y in hit),
    )


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_sweep_matches_counting(spark, seed):
    rows, frame = scored_rows(spark, seed, 400)
    thresholds = [0.3, 0.05, 0.3, 0.95, 0.5]
    for group in ("a", "b"):
        part = [(s, y) for g, s, y in rows if g == group]
        got = evaluation.confusion_sweep(frame, thresholds, by=["g"]).filter(F.col("g") == group)
        by_position = {r["position"]: (r["tp"], r["fp"], r["tn"], r["fn"]) for r in got.collect()}
        assert by_position == {i: brute_matrix(part, t) for i, t in enumerate(thresholds)}


def test_sweep_edges(spark):
    rows = [(0.5, 1.0), (None, 1.0), (float("nan"), 0.0), (0.7, 2.0), (0.7, None), (1.0, 0.0)]
    frame = spark.createDataFrame(rows, "fraud_score double, label double")
    got = {r["threshold"]: (r["tp"], r["fp"], r["tn"], r["fn"]) for r in evaluation.confusion_sweep(frame, [0.5, 0.6]).collect()}
    assert got == {0.5: (1, 2, 0, 0), 0.6: (0, 2, 0, 1)}


def test_sweep_of_nothing_is_all_zero(spark):
    empty = spark.createDataFrame([], "fraud_score double, label double")
    rows = evaluation.threshold_metrics(empty, [0.1, 0.2]).collect()
    assert [(r["tp"], r["fp"], r["tn"], r["fn"], r["f1_score"]) for r in rows] == [(0, 0, 0, 0, 0.0)] * 2


def test_sweep_needs_thresholds(spark):
    with pytest.raises(ValueError):
        evaluation.confusion_sweep(spark.createDataFrame([], "fraud_score double, label double"), [])


def test_large_grid(spark):
    rows, frame = scored_rows(spark, 9, 200)
    grid = [i / 1000 for i in range(1001)]
    got = evaluation.confusion_sweep(frame, grid)
    assert got.count() == 1001
    assert got.filter("tp + fp + tn + fn <> 200").count() == 0


def test_matrix_at_own_threshold(spark):
    rows, frame = scored_rows(spark, 4, 300)
    chosen = spark.createDataFrame([("a", 0.3), ("b", 0.55)], "g string, threshold double")
    got = evaluation.confusion_at_own_threshold(frame, chosen, ["g"]).collect()
    for row in got:
        part = [(s, y) for g, s, y in rows if g == row["g"]]
        assert (row["tp"], row["fp"], row["tn"], row["fn"]) == brute_matrix(part, row["threshold"])


def evaluator(frame, metric):
    return BinaryClassificationEvaluator(
        labelCol="label", rawPredictionCol="fraud_score", metricName=metric, numBins=0
    ).evaluate(frame)


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("rows_per_range", [7, 1_000_000])
def test_areas_match_the_evaluator(spark, seed, rows_per_range):
    _, frame = scored_rows(spark, seed, 500)
    got = curves.areas_under_curves(frame, by=["g"], rows_per_range=rows_per_range).collect()
    assert len(got) == 2
    for row in got:
        part = frame.filter(F.col("g") == row["g"])
        assert math.isclose(row["roc_auc"], evaluator(part, "areaUnderROC"), abs_tol=1e-12)
        assert math.isclose(row["auc_pr"], evaluator(part, "areaUnderPR"), abs_tol=1e-12)


@pytest.mark.parametrize("label", [0.0, 1.0])
def test_areas_of_a_single_class_match_the_evaluator(spark, label):
    rows = spark.createDataFrame([(s / 10, label) for s in range(10)], "fraud_score double, label double")
    row = curves.areas_under_curves(rows).first()
    assert math.isclose(row["roc_auc"], evaluator(rows, "areaUnderROC"), abs_tol=1e-12)
    assert math.isclose(row["auc_pr"], evaluator(rows, "areaUnderPR"), abs_tol=1e-12)


def test_areas_of_nothing(spark):
    assert curves.areas_under_curves(spark.createDataFrame([], "fraud_score double, label double")).count() == 0


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("rows_per_range", [3, 50, 1_000_000])
def test_running_totals_match_a_plain_sum(spark, descending, rows_per_range):
    rng = random.Random(5)
    values = {(g, v): rng.randint(0, 9) for g in ("a", "b") for v in rng.sample(range(1000), 90 if g == "a" else 5)}
    frame = spark.createDataFrame([(g, float(v), n) for (g, v), n in values.items()], "g string, v double, n long")
    stored = materialize(frame, "test-points")
    got = ordered.running_totals(stored, "v", ["n"], ["g"], descending, rows_per_range).collect()
    assert len(got) == len(values)
    for row in got:
        reached = (lambda v: v >= row["v"]) if descending else (lambda v: v <= row["v"])
        expected = sum(n for (g, v), n in values.items() if g == row["g"] and reached(v))
        assert row["cum_n"] == expected


def test_running_totals_with_extreme_values(spark):
    order = [float("-inf"), -1.0, 0.0, 1e300, float("inf"), float("nan")]
    frame = spark.createDataFrame([(v, 1) for v in order], "v double, n long")
    stored = materialize(frame, "test-extremes")
    got = ordered.running_totals(stored, "v", ["n"], rows_per_range=2).orderBy("v").collect()
    assert [row["cum_n"] for row in got] == [1, 2, 3, 4, 5, 6]


@pytest.mark.parametrize("rows_per_range", [10, 1_000_000])
def test_exact_quantiles_under_skew(spark, rows_per_range):
    values = [5.0] * 400 + [float(v) for v in range(1000)]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    got = quantiles.exact_quantiles(frame, "v", [0.0001, 0.07, 0.25, 0.6, 0.8, 1.0], rows_per_range)
    ranked = sorted(values)
    for row in got.collect():
        rank = math.ceil(Fraction(str(row["share"])) * len(values))
        assert row["value"] == ranked[max(1, rank) - 1]


@pytest.mark.parametrize("strange", [0, 600])
def test_exact_quantiles_count_only_near_the_ranks_in_a_large_table(spark, monkeypatch, strange):
    """As exact as before; where NaN misleads the sketch, all values are counted."""
    stored = []
    monkeypatch.setattr(quantiles, "WORTH_A_SKETCH", 20_000)
    monkeypatch.setattr(quantiles, "materialize", lambda df, label: stored.append(materialize(df, label)) or stored[-1])
    spread = F.when(F.col("id") % 4 == 0, 7.5).otherwise((F.xxhash64("id") % 1_000_003) / 10.0)
    frame = spark.range(30_000).select(F.when(F.col("id") < strange, float("nan")).otherwise(spread).alias("v"))
    shares = [0.0001, 0.3, 0.6, 0.6002, 0.8, 1.0]
    got = {row["share"]: row["value"] for row in quantiles.exact_quantiles(frame, "v", shares).collect()}
    ranked = sorted((row["v"] for row in frame.collect()), key=lambda v: (math.isnan(v), v))
    for share in shares:
        want = ranked[math.ceil(Fraction(str(share)) * len(ranked)) - 1]
        assert got[share] == want or (math.isnan(got[share]) and math.isnan(want))
    distinct = frame.distinct().count()
    assert stored[0].count() == distinct if strange else stored[0].count() < distinct / 50


def metric_rows(spark, rows):
    columns = "g string, position int, threshold double, precision double, recall double, f1_score double"
    return spark.createDataFrame(rows, columns)


FLOOR_CASE = [
    ("x", 0, 0.2, 0.60, 0.95, 0.73),
    ("x", 1, 0.4, 0.72, 0.88, 0.79),
    ("x", 2, 0.6, 0.90, 0.75, 0.82),
]
FALLBACK_CASE = [("x", 0, 0.2, 0.40, 0.95, 0.56), ("x", 1, 0.4, 0.50, 0.75, 0.60)]


@pytest.mark.parametrize("rows", [FLOOR_CASE, FALLBACK_CASE])
def test_threshold_with_floor(spark, rows):
    chosen = selection.choose_threshold(metric_rows(spark, rows), ThresholdPolicy(min_precision=0.70))
    assert chosen.first()["threshold"] == 0.4


def test_alias_policy_and_best_f1(spark):
    frame = metric_rows(spark, FLOOR_CASE)
    alias = selection.choose_threshold(frame, ThresholdPolicy(RECALL_WITH_FLOOR_ALIAS, 0.70))
    assert alias.first()["threshold"] == 0.4
    assert selection.choose_threshold(frame, ThresholdPolicy(BEST_F1)).first()["threshold"] == 0.6


def test_unknown_policy():
    with pytest.raises(ValueError):
        ThresholdPolicy("most_alerts")


@pytest.mark.parametrize("part", ["candidates", "seeds", "thresholds"])
def test_an_experiment_needs_every_part(part):
    with pytest.raises(ValueError, match=part):
        ExperimentSpec(**{part: ()})


def test_choice_from_nothing_is_nothing(spark):
    assert selection.choose_threshold(metric_rows(spark, []), ThresholdPolicy()).count() == 0


def test_choice_matches_the_plain_rule_on_ties(spark):
    rng = random.Random(11)
    steps = [0.2, 0.5, 0.7, 0.9]
    rows = [
        (f"run{g}", i, t, rng.choice(steps), rng.choice(steps), rng.choice(steps))
        for g in range(120)
        for i, t in enumerate((0.1, 0.3, 0.5, 0.7))
    ]
    got = selection.choose_threshold(metric_rows(spark, rows), ThresholdPolicy(), by=["g"])
    for row in got.collect():
        own = [r for r in rows if r[0] == row["g"]]
        able = [r for r in own if r[3] >= 0.70]
        best = max(able, key=lambda r: (r[4], r[5], r[3])) if able else max(own, key=lambda r: (r[5], r[4], r[3]))
        assert row["position"] == best[1]


def test_champion_ties_go_to_the_first_listed(spark):
    runs = spark.createDataFrame(
        [("late", 1, 0.5, 0.4), ("early", 0, 0.5, 0.4), ("weak", 2, 0.4, 0.9)],
        "candidate_id string, candidate_position int, auc_pr double, f1_score double",
    )
    assert selection.champion(runs).first()["candidate_id"] == "early"
    assert selection.champion(runs.limit(0)).count() == 0


def test_median_of_an_even_count(spark):
    runs = spark.createDataFrame([(0.2,), (0.4,), (0.9,), (0.3,)], "threshold double")
    assert math.isclose(selection.median_threshold(runs).first()[0], 0.35)


def test_default_grid():
    assert len(DEFAULT_THRESHOLDS) == 19
    assert (DEFAULT_THRESHOLDS[0], DEFAULT_THRESHOLDS[2], DEFAULT_THRESHOLDS[-1]) == (0.05, 0.15, 0.95)


def test_areas_with_billions_of_rows_on_a_score(spark, monkeypatch):
    """Stored counts of two scores, each held by more rows than fit a product of longs."""
    many = 10_000_000_000
    points = spark.createDataFrame(
        [(0.9, 3 * many, many), (0.1, many, 3 * many)], "fraud_score double, positives long, negatives long"
    )
    monkeypatch.setattr(curves, "score_points", lambda *args: points)
    row = curves.areas_under_curves(points).first()
    assert row["roc_auc"] == pytest.approx(0.75)


def test_a_run_without_rows_keeps_its_matrix(spark):
    scored = spark.createDataFrame([("a", 0.9, 1.0), ("a", 0.2, 0.0)], "g string, fraud_score double, label double")
    chosen = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "g string, threshold double")
    got = evaluation.confusion_at_own_threshold(scored, chosen, ["g"])
    assert {tuple(r) for r in got.collect()} == {("a", 0.5, 1, 0, 1, 0), ("b", 0.5, 0, 0, 0, 0)}
