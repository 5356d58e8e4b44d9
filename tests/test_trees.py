import pytest
from pyspark.sql import functions as F

from bindings.views import COARSE, coarse
from ledgerwatch.operators.classes import balanced_weights
from ledgerwatch.operators.ensemble import fit_ensemble, training_layout
from ledgerwatch.operators.trees import (
    exact_bins,
    impurity_importance,
    permutation_importance,
    stored_nodes,
    with_partner,
)
from ledgerwatch.spec import Candidate

SF_DIR = "/root/testdata/sf0.001"
FOREST = Candidate("forest", forest_trees=6, forest_depth=4, boosting_rounds=5, boosting_depth=3)


@pytest.fixture(scope="module")
def rows(spark):
    found = coarse(spark, SF_DIR).cache()
    yield found
    found.unpersist()


def layout(rows, partitions):
    weights = balanced_weights(rows, COARSE.label)
    return training_layout(rows, weights.legit, weights.positive, COARSE, partitions)


def test_exact_trees_do_not_depend_on_layout_or_seed(spark, rows, folder):
    bins = exact_bins(rows, COARSE.features)
    assert bins == 101  # k has a hundred values
    found = []
    for partitions, seed in ((1, 1), (7, 2)):
        fitted = fit_ensemble(layout(rows, partitions), Candidate("c", 1, 3, 1, 3), seed, COARSE, bins)
        base = folder("models")
        fitted.save(base)
        nodes = [stored_nodes(spark, f"{base}/{m}", COARSE.features).drop("weight", "gain", "impurity", "share", "prediction") for m in ("rf_model", "gbt_model")]
        found.append([sorted(map(tuple, n.collect()), key=str) for n in nodes])
    assert found[0] == found[1] and len(found[0][0]) > 3


def test_bins_follow_rows_and_values(spark):
    few = spark.range(10_000).select((F.col("id") % 3).alias("a"), F.lit(1).alias("b"))
    assert exact_bins(few, ["a", "b"]) == 101
    assert exact_bins(few.limit(0), ["a", "b"]) == 2


def test_nodes_and_importances_of_a_whole_ensemble(spark, rows, folder):
    fitted = fit_ensemble(layout(rows, 2), FOREST, 7, COARSE)
    base = folder("models")
    fitted.save(base)
    for name, model in (("rf_model", fitted.forest), ("gbt_model", fitted.boosted)):
        nodes = stored_nodes(spark, f"{base}/{name}", COARSE.features).cache()
        assert nodes.count() == sum(t.numNodes for t in model.trees)
        # What arrives at a node's sides is what arrived at the node.
        sides = nodes.alias("n").join(nodes.alias("l"), F.expr("l.tree = n.tree and l.node = n.left"))
        sides = sides.join(nodes.alias("r"), F.expr("r.tree = n.tree and r.node = n.right"))
        bad = sides.filter("n.rows != l.rows + r.rows or abs(n.weight - l.weight - r.weight) > 1e-6")
        assert sides.count() == nodes.filter("feature is not null").count() > 0 and bad.count() == 0
        got = {r.feature: r.importance for r in impurity_importance(nodes, COARSE.features, alike=name == "rf_model").collect()}
        want = dict(zip(COARSE.features, model.featureImportances.toArray()))
        assert got.keys() == want.keys() and abs(sum(got.values()) - 1) < 1e-9
        assert all(abs(got[f] - want[f]) < 1e-9 for f in want)


def test_importance_of_trees_without_a_split(spark, rows, folder):
    one_class = rows.withColumn("label", F.lit(1.0)).withColumn("class_weight", F.lit(1.0))
    base = folder("models")
    fitted = fit_ensemble(training_layout(one_class, 1.0, 1.0, COARSE, 1), Candidate("c", 1, 1, 1, 1), 1, COARSE)
    fitted.save(base)
    nodes = stored_nodes(spark, f"{base}/rf_model", COARSE.features)
    assert [r.importance for r in impurity_importance(nodes, COARSE.features).collect()] == [0.0] * 4


def test_every_row_is_a_partner_once(spark):
    rows = spark.range(500).select("id", (F.col("id") * 2).alias("x"), F.lit("y").alias("y"))
    for each in (1_000, 20):
        found = with_partner(rows.repartition(5), "id", ["x", "y"], each, 500).collect()
        assert sorted(r.partner.x for r in found) == [2 * i for i in range(500)]
        assert sum(r.partner.x != r.x for r in found) > 450
    assert with_partner(rows.limit(0), "id", ["x"], 10, 0).count() == 0


def test_permutation_importance_knows_the_feature_that_counts(spark):
    rows = spark.range(4_000).select(
        "id", (F.col("id") % 10 / 10.0).alias("a"), (F.xxhash64("id") % 7).cast("double").alias("b"),
        (F.col("id") % 10 >= 5).cast("double").alias("label"),
    )
    found = permutation_importance(rows, lambda df: df.withColumn("fraud_score", F.col("a")), ["a", "b"], "id", rows_per_block=300)
    got = {r.feature: r for r in found.collect()}
    assert got["a"].roc_auc == 1.0 and got["b"].importance == 0.0
    assert abs(got["a"].permuted_auc - 0.5) < 0.05
