"""The weighted forest + boosted-tree ensemble: fitting, scoring, comparing runs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerwatch.functions.scores import decide, ensemble, vector_item
from ledgerwatch.operators.silver import with_class_weight
from ledgerwatch.spec import Candidate, TransactionSpec

FEATURES = "features"


@dataclass(frozen=True)
class Ensemble:
    forest: RandomForestClassificationModel
    boosted: GBTClassificationModel

    def save(self, base: str) -> tuple[str, str]:
        """Write both models under ``base``, replacing earlier ones; returns their paths."""
        paths = (f"{base}/rf_model", f"{base}/gbt_model")
        self.forest.write().overwrite().save(paths[0])
        self.boosted.write().overwrite().save(paths[1])
        return paths

    @classmethod
    def load(cls, forest_path: str, boosted_path: str) -> Ensemble:
        return cls(
            RandomForestClassificationModel.load(forest_path),
            GBTClassificationModel.load(boosted_path),
        )


@dataclass(frozen=True)
class DeployedModel:
    """A loaded ensemble with the threshold and version its scores are stamped with."""

    ensemble: Ensemble
    threshold: float
    version: str

    @classmethod
    def from_registry(cls, row) -> DeployedModel:
        return cls(
            Ensemble.load(row["rf_model_path"], row["gbt_model_path"]),
            float(row["threshold"]),
            row["model_version"],
        )


def with_feature_vector(df: DataFrame, spec: TransactionSpec) -> DataFrame:
    """Assemble the features; a NULL feature becomes NaN rather than an error."""
    assembler = VectorAssembler(
        inputCols=list(spec.features), outputCol=FEATURES, handleInvalid="keep"
    )
    return assembler.transform(df)


def training_layout(
    rows: DataFrame, legit: float, positive: float, spec: TransactionSpec, partitions: int
) -> DataFrame:
    """Weighted feature vectors in a layout that depends on the rows alone.

    Tree training samples per partition, so the same rows in another layout give another
    model. Hashing unique ids into a fixed number of sorted partitions removes that. Plain
    numbers move with the ids; vectors are made where they arrive, and ids are left out then.
    """
    needed = dict.fromkeys([spec.id, spec.label, *spec.features])
    dealt = rows.select(*needed).repartition(partitions, spec.id).sortWithinPartitions(spec.id)
    weighted = with_class_weight(dealt, legit, positive, spec)
    return with_feature_vector(weighted, spec).select(spec.label, spec.weight, FEATURES)


ROWS = "equal_rows"


def summed_rows(rows: DataFrame, spec: TransactionSpec) -> DataFrame:
    """Rows with equal label and features as one, with their number."""
    return rows.groupBy(spec.label, *spec.features).agg(F.count(F.lit(1)).alias(ROWS))


def summed_layout(summed: DataFrame, legit: float, positive: float, spec: TransactionSpec) -> DataFrame:
    """Feature vectors of :func:`summed_rows` with the weight of all their rows, for exact trees.

    A fit that draws nothing adds up weights per value, so it finds the same splits and shares
    in these sums as in the rows, in any layout. A stored node's ``rows`` then counts sums; its
    ``weight`` is that of all rows. Where no rows are equal, this is a row each.
    """
    weighted = with_class_weight(summed, legit, positive, spec)
    weighted = weighted.withColumn(spec.weight, F.col(spec.weight) * F.col(ROWS))
    return with_feature_vector(weighted, spec).select(spec.label, spec.weight, FEATURES)


def fit_ensemble(
    training: DataFrame, candidate: Candidate, seed: int, spec: TransactionSpec, bins: int = 0
) -> Ensemble:
    """Fit both models on weighted rows.

    Each model is asked for its probabilities only: without the other output columns
    scoring runs one model evaluation per row instead of three.

    With ``bins`` (see :func:`~ledgerwatch.operators.trees.exact_bins`) nothing is drawn: every
    tree sees all rows and all features and tries every midpoint, so that the same rows give
    the same trees in any layout and with any seed.
    """
    columns = {
        "labelCol": spec.label,
        "featuresCol": FEATURES,
        "weightCol": spec.weight,
        "seed": int(seed),
    }
    whole = {}
    if bins:
        columns |= {"maxBins": int(bins), "featureSubsetStrategy": "all"}
        whole = {"bootstrap": False}
    forest = RandomForestClassifier(
        numTrees=candidate.forest_trees, maxDepth=candidate.forest_depth, **columns, **whole
    )
    boosted = GBTClassifier(
        maxIter=candidate.boosting_rounds, maxDepth=candidate.boosting_depth, **columns
    )
    return Ensemble(forest.fit(training), boosted.fit(training))


def _probability(model, rows: DataFrame, name: str) -> DataFrame:
    """Add the class-1 probability of one model under ``name``."""
    vector = f"_{name}"
    only_probability = model.copy(
        {model.probabilityCol: vector, model.rawPredictionCol: "", model.predictionCol: ""}
    )
    scored = only_probability.transform(rows)
    return scored.withColumn(name, vector_item(F.col(vector), 1)).drop(vector)


def with_ensemble_score(df: DataFrame, models: Ensemble, spec: TransactionSpec) -> DataFrame:
    """Add both probabilities and their mean, ``fraud_score``."""
    rows = with_feature_vector(df, spec)
    rows = _probability(models.forest, rows, "rf_fraud_probability")
    rows = _probability(models.boosted, rows, "gbt_fraud_probability")
    score = ensemble(F.col("rf_fraud_probability"), F.col("gbt_fraud_probability"))
    return rows.withColumn("fraud_score", score).drop(FEATURES)


def score_table(
    df: DataFrame,
    model: DeployedModel,
    spec: TransactionSpec,
    scored_at: Column,
    batch_id: int = 0,
) -> DataFrame:
    """Score rows in the layout of the score table. Batch and stream both use this.

    ``scored_at`` should be a constant of the scoring step, so that a recomputed task
    writes the same rows.
    """
    scored = with_ensemble_score(df, model.ensemble, spec)
    stamped = {
        "prediction": decide(F.col("fraud_score"), model.threshold),
        "threshold_used": F.lit(float(model.threshold)),
        "model_version": F.lit(str(model.version)),
        "scored_at": scored_at.cast("timestamp"),
        "scoring_batch_id": F.lit(int(batch_id)),
    }
    return scored.withColumns(stamped).select(*spec.score_columns, spec.raw_id)


@dataclass(frozen=True)
class FittedRun:
    candidate_id: str
    candidate_position: int
    run_id: int
    seed: int
    ensemble: Ensemble


RUN_KEYS = ("candidate_id", "candidate_position", "run_id", "seed")


def score_runs(rows: DataFrame, runs: Sequence[FittedRun], spec: TransactionSpec) -> DataFrame:
    """Label and score of every row under every run, from one scan of the rows."""
    scored = with_feature_vector(rows.select(spec.label, *spec.features), spec)
    results = []
    for number, run in enumerate(runs):
        forest, boosted = f"forest_{number}", f"boosted_{number}"
        scored = _probability(run.ensemble.forest, scored, forest)
        scored = _probability(run.ensemble.boosted, scored, boosted)
        results.append(
            F.struct(
                F.lit(run.candidate_id).alias("candidate_id"),
                F.lit(run.candidate_position).alias("candidate_position"),
                F.lit(run.run_id).alias("run_id"),
                F.lit(run.seed).alias("seed"),
                ensemble(F.col(forest), F.col(boosted)).alias("fraud_score"),
            )
        )
    return scored.select(spec.label, F.inline(F.array(*results)))
