"""Registered queries over models that SQL can fit again: trees over every split, registries."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindings import views
from bindings.queries import query, rounded
from bindings.views import COARSE, wall_clock
from ledgerwatch.operators import listings
from ledgerwatch.operators.classes import balanced_weights
from ledgerwatch.operators.ensemble import (
    DeployedModel,
    Ensemble,
    fit_ensemble,
    score_table,
    training_layout,
    with_ensemble_score,
)
from ledgerwatch.operators.trees import exact_bins, impurity_importance, permutation_importance, stored_nodes
from ledgerwatch.plans.training import ExperimentResult, run_experiment
from ledgerwatch.session import materialize, scratch_path
from ledgerwatch.sources.registry import latest_model, versions
from ledgerwatch.spec import BEST_F1, Candidate, ExperimentSpec, ThresholdPolicy

NOW = datetime(2024, 2, 1, 6, 0, tzinfo=timezone.utc)
STUMP = Candidate("stump", forest_trees=1, forest_depth=1, boosting_rounds=1, boosting_depth=1)
PAIR = Candidate("pair", forest_trees=1, forest_depth=2, boosting_rounds=1, boosting_depth=2)
# Trees of this kind score below 0.5 for most rows, hence the finer part of the grid.
EXACT = ExperimentSpec(
    candidates=(STUMP, PAIR),
    seeds=(42, 52),
    policy=ThresholdPolicy(BEST_F1),
    exact_cuts=True,
    exact_trees=True,
    parallel_fits=4,
)


def _exact_pair(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Ensemble, str]:
    """All rows, both models of depth 2 fitted to them, and where they are stored."""
    rows = materialize(views.coarse(spark, sf_dir), "coarse-rows")
    weights = balanced_weights(rows, COARSE.label)
    layout = training_layout(rows, weights.legit, weights.positive, COARSE, 4)
    fitted = fit_ensemble(layout, PAIR, 42, COARSE, exact_bins(rows, COARSE.features))
    base = scratch_path(spark, "exact-pair")
    fitted.save(base)
    return rows, fitted, base


def _nodes(spark: SparkSession, base: str) -> DataFrame:
    forest = stored_nodes(spark, f"{base}/rf_model", COARSE.features).withColumn("model", F.lit("forest"))
    boosted = stored_nodes(spark, f"{base}/gbt_model", COARSE.features).withColumn("model", F.lit("boosted"))
    return forest.unionByName(boosted)


@query
def tree_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fitted trees as rows: which splits were chosen, what arrives where, what leaves say.
    (With balanced weights the root's two classes weigh the same, so its prediction is a tie.)"""
    nodes = _nodes(spark, _exact_pair(spark, sf_dir)[2])
    nodes = nodes.withColumn("prediction", F.when(F.col("feature").isNull(), F.col("prediction")))
    return rounded(nodes.drop("impurity", "tree_weight", "tree"), 6)


@query
def tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both probabilities and their mean for every row."""
    rows, fitted, _ = _exact_pair(spark, sf_dir)
    scored = with_ensemble_score(rows, fitted, COARSE)
    names = ("event_id", "label", "rf_fraud_probability", "gbt_fraud_probability", "fraud_score")
    return rounded(scored.select(*names))


@query
def tree_score_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same in the layout of the score table: decided, stamped."""
    rows, fitted, _ = _exact_pair(spark, sf_dir)
    rows = rows.withColumn("event_timestamp", F.timestamp_micros((F.col("Time") * 1e6 + views.EPOCH_MICROS).cast("long")))
    table = score_table(rows, DeployedModel(fitted, 0.5, "exact-pair"), COARSE, F.lit(NOW), 7)
    return wall_clock(rounded(table))


@query
def feature_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of the impurity each feature's splits remove, per model and over both."""
    nodes = materialize(_nodes(spark, _exact_pair(spark, sf_dir)[2]), "nodes")
    each = impurity_importance(nodes, COARSE.features, ("model",))
    apart = nodes.withColumn("tree", F.concat_ws("/", "model", F.col("tree").cast("string")))
    both = impurity_importance(apart.withColumn("model", F.lit("both")), COARSE.features, ("model",))
    return rounded(each.unionByName(both), 6)


@query
def feature_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ROC area lost when a feature's values move to other rows, in blocks of some 1,000 rows."""
    rows, fitted, _ = _exact_pair(spark, sf_dir)
    found = permutation_importance(
        rows, lambda df: with_ensemble_score(df, fitted, COARSE), COARSE.features, "event_id", rows_per_block=1_000
    )
    return rounded(found)


def _experiment(spark: SparkSession, sf_dir: str) -> tuple[ExperimentResult, str]:
    base = scratch_path(spark, "exact-models")
    registry = f"{base}/registry"
    rows = views.coarse(spark, sf_dir)
    return run_experiment(rows, COARSE, EXACT, base, registry, name="exact", now=NOW), registry


@query
def exact_experiment_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every candidate and seed on validation rows, the champion on test rows."""
    return rounded(_experiment(spark, sf_dir)[0].metrics)


@query
def exact_experiment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(listings.summary_listing(_experiment(spark, sf_dir)[0].summary))


@query
def exact_test_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(listings.test_run_listing(_experiment(spark, sf_dir)[0].metrics))


@query
def exact_deployed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The champion fitted again on train and validation rows, over the grid on test rows."""
    return rounded(listings.model_metrics_listing(_experiment(spark, sf_dir)[0].model_metrics))


@query
def exact_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered record, read back as the latest of its registry."""
    registry = versions(spark, _experiment(spark, sf_dir)[1])
    newest = latest_model(registry)["model_version"]
    row = registry.filter(F.col("model_version") == newest)
    text = lambda name: F.array_join(F.col(name).cast("array<string>"), ",").alias(name)
    return wall_clock(
        rounded(
            row.select(
                "model_version",
                "threshold",
                "threshold_policy",
                "training_timestamp",
                text("feature_columns"),
                text("seeds"),
                "experiment_id",
                "candidate_id",
                F.col("class_weights")["0"].alias("legit_weight"),
                F.col("class_weights")["1"].alias("positive_weight"),
                F.col("time_cut_points")["train_validation"].alias("validation_from"),
                F.col("time_cut_points")["validation_test"].alias("test_from"),
                F.col("split_rows")["train"].alias("train_rows"),
                F.col("split_rows")["validation"].alias("validation_rows"),
                F.col("split_rows")["test"].alias("test_rows"),
                F.col("test_summary")["f1"].alias("test_f1"),
                F.col("test_summary")["roc_auc"].alias("test_roc_auc"),
            )
        )
    )
