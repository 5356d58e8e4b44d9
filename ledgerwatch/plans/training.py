"""The chronological experiment and the model it deploys."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from datetime import datetime, timezone
from math import ceil
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerwatch.operators.classes import ClassWeights, checked_weights
from ledgerwatch.operators.curves import areas_under_curves
from ledgerwatch.operators.duplicates import keep_first_numbers, keep_first_stored
from ledgerwatch.operators.ensemble import (
    RUN_KEYS,
    Ensemble,
    FittedRun,
    fit_ensemble,
    score_runs,
    summed_layout,
    summed_rows,
    training_layout,
)
from ledgerwatch.operators.evaluation import (
    confusion_at_own_threshold,
    threshold_metrics,
    with_rates,
)
from ledgerwatch.operators.selection import champion, choose_threshold, mark_selected, median_threshold
from ledgerwatch.operators.silver import labelled_only
from ledgerwatch.operators.split import (
    TEST,
    TRAIN,
    VALIDATION,
    TimeCuts,
    block_counts,
    check_blocks,
    time_cuts,
    with_block,
)
from ledgerwatch.operators.summary import long_metrics, run_summary
from ledgerwatch.operators.trees import exact_bins
from ledgerwatch.session import materialize, scratch_work
from ledgerwatch.sources.catalog import (
    EXPERIMENT_METRICS_SCHEMA,
    EXPERIMENT_SUMMARY_SCHEMA,
    layer_tables,
    save_layer,
)
from ledgerwatch.sources.registry import ModelRecord, register
from ledgerwatch.sources.writers import STORED_CODEC
from ledgerwatch.spec import Candidate, ExperimentSpec, TransactionSpec


def protocol_of(experiment: ExperimentSpec) -> str:
    """How the experiment was run, from its own parameters."""
    split = experiment.split
    test = 1 - split.train - split.validation
    return (
        f"split by time {split.train:g}/{split.validation:g}/{test:g}; policy {experiment.policy.name}"
        f" with precision {experiment.policy.min_precision:g}; seeds {', '.join(map(str, experiment.seeds))}"
    )


MANY_FIT_PARTITIONS = 64  # each costs a task and a result in every step of every fit
LARGE_FIT_PARTITION = 500_000


def fit_partitions(rows: int, experiment: ExperimentSpec) -> int:
    """Partitions of a training layout, by the number of rows alone.

    Beyond ``MANY_FIT_PARTITIONS`` of them partitions grow, up to ``LARGE_FIT_PARTITION`` rows,
    before their number does: a fit runs some fifty steps, each of which sends a result per
    partition to the driver and shuffles a block from every partition to every other.
    """
    wanted = ceil(rows / experiment.fit_rows_per_partition)
    return max(1, min(wanted, max(MANY_FIT_PARTITIONS, ceil(rows / LARGE_FIT_PARTITION))))


@dataclass(frozen=True)
class Blocks:
    rows: DataFrame
    cuts: TimeCuts
    row_counts: dict[str, int]
    label_counts: DataFrame

    def block(self, name: str) -> DataFrame:
        """One block; the stored table is partitioned by block, so others are not read."""
        return self.rows.filter(F.col("block") == name).drop("block")

    def weights(self, *names: str, label: str = "label") -> ClassWeights:
        """Balanced weights over some blocks, from the stored counts: no scan of the rows."""
        counts = self.label_counts.filter(F.col("block").isin(*names))
        return checked_weights(counts.groupBy(label).agg(F.sum("count").alias("count")), label)


@dataclass(frozen=True)
class ExperimentResult:
    metrics: DataFrame
    summary: DataFrame
    model_metrics: DataFrame
    long_model_metrics: DataFrame
    record: ModelRecord


def prepare_blocks(silver: DataFrame, spec: TransactionSpec, experiment: ExperimentSpec) -> Blocks:
    """One row per id, cut into three stored blocks.

    Only the id, label and feature columns go through the shuffle. Which of several rows
    with one id stays is decided by the raw event id, so reruns agree. Exact trees need no
    layout by id; for them only numbers are shuffled and stored. What the blocks were cut from
    is removed once they are stored.
    """
    needed = list(dict.fromkeys([spec.label, spec.time, *spec.features]))
    labelled = labelled_only(silver, spec.label)
    with scratch_work() as uncut:
        if experiment.exact_trees:
            single = keep_first_numbers(labelled, spec.id, [spec.raw_id], needed)
        else:
            wanted = list(dict.fromkeys([spec.id, *needed]))
            single = keep_first_stored(labelled, spec.id, [spec.raw_id], wanted)
        cuts = time_cuts(
            single, spec, experiment.split, experiment.quantile_error, experiment.exact_cuts
        )
    blocks = materialize(with_block(single, spec, cuts), "blocks", ("block",), STORED_CODEC)
    uncut.remove(silver.sparkSession)
    counts = materialize(block_counts(blocks, spec.label), "block-counts")
    return Blocks(blocks, cuts, check_blocks(counts, spec.label), counts)


def fit_layout(
    rows: DataFrame, weights: ClassWeights, spec: TransactionSpec, experiment: ExperimentSpec, count: int
) -> tuple[DataFrame, int]:
    """What a fit reads, and the bins of an exact one (else 0)."""
    if experiment.exact_trees:
        summed = materialize(summed_rows(rows, spec), "summed-rows")
        return summed_layout(summed, weights.legit, weights.positive, spec), exact_bins(summed, spec.features)
    partitions = fit_partitions(count, experiment)
    return training_layout(rows, weights.legit, weights.positive, spec, partitions), 0


def fit_runs(
    blocks: Blocks, spec: TransactionSpec, experiment: ExperimentSpec, model_base: str
) -> list[FittedRun]:
    """Fit and save every candidate with every seed. Each fit is a distributed job; they
    share one stored training layout."""
    train = blocks.block(TRAIN)
    weights = blocks.weights(TRAIN, label=spec.label)
    layout, bins = fit_layout(train, weights, spec, experiment, blocks.row_counts[TRAIN])
    layout = layout.persist(StorageLevel.MEMORY_AND_DISK)

    planned = [
        (position, candidate, run_id, seed)
        for position, candidate in enumerate(experiment.candidates)
        for run_id, seed in enumerate(experiment.seeds, start=1)
    ]

    def fit(plan: tuple[int, Candidate, int, int]) -> FittedRun:
        position, candidate, run_id, seed = plan
        fitted = fit_ensemble(layout, candidate, seed, spec, bins)
        fitted.save(f"{model_base}/{candidate.id}/seed-{seed}")
        return FittedRun(candidate.id, position, run_id, seed, fitted)

    try:
        with ThreadPool(max(1, experiment.parallel_fits)) as pool:
            return pool.map(inheritable_thread_target(train.sparkSession)(fit), planned, chunksize=1)
    finally:
        layout.unpersist()


def validation_results(
    scored: DataFrame, spec: TransactionSpec, experiment: ExperimentSpec
) -> DataFrame:
    """Chosen threshold, its matrix and rates, and both areas, for all runs together."""
    sweep = threshold_metrics(scored, experiment.thresholds, label=spec.label, by=RUN_KEYS)
    chosen = choose_threshold(sweep, experiment.policy, by=RUN_KEYS)
    areas = areas_under_curves(scored, label=spec.label, by=RUN_KEYS)
    return chosen.join(areas, list(RUN_KEYS))


def test_results(scored: DataFrame, chosen: DataFrame, spec: TransactionSpec) -> DataFrame:
    """The same for the test block, each run at the threshold it chose on validation."""
    at_own = confusion_at_own_threshold(scored, chosen, RUN_KEYS, label=spec.label)
    areas = areas_under_curves(scored, label=spec.label, by=RUN_KEYS)
    return with_rates(at_own).join(areas, list(RUN_KEYS))


def experiment_metrics(
    results: DataFrame, experiment_id: str, row_counts: dict[str, int], created_at: str
) -> DataFrame:
    stamped = results.withColumns(
        {
            "experiment_id": F.lit(experiment_id),
            "train_rows": F.lit(row_counts[TRAIN]),
            "validation_rows": F.lit(row_counts[VALIDATION]),
            "test_rows": F.lit(row_counts[TEST]),
            "created_at": F.lit(created_at),
        }
    )
    return stamped.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in EXPERIMENT_METRICS_SCHEMA]
    )


def experiment_summary(metrics: DataFrame) -> DataFrame:
    by = ("experiment_id", "candidate_id", "split_name", "selected_candidate", "created_at")
    return run_summary(metrics, by).select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in EXPERIMENT_SUMMARY_SCHEMA]
    )


def fit_deployment(
    blocks: Blocks, spec: TransactionSpec, experiment: ExperimentSpec, champion_id: str
) -> tuple[Ensemble, ClassWeights]:
    """Refit the champion on train and validation rows with the first seed."""
    rows = blocks.block(TRAIN).unionByName(blocks.block(VALIDATION))
    weights = blocks.weights(TRAIN, VALIDATION, label=spec.label)
    known = blocks.row_counts[TRAIN] + blocks.row_counts[VALIDATION]
    layout, bins = fit_layout(rows, weights, spec, experiment, known)
    layout = layout.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fitted = fit_ensemble(
            layout, experiment.candidate(champion_id), experiment.seeds[0], spec, bins
        )
    finally:
        layout.unpersist()
    return fitted, weights


def deployed_model_metrics(
    scored: DataFrame,
    spec: TransactionSpec,
    experiment: ExperimentSpec,
    version: str,
    created_at: str,
) -> DataFrame:
    """The deployed model over the whole threshold grid on the test block."""
    sweep = threshold_metrics(scored, experiment.thresholds, label=spec.label, by=RUN_KEYS)
    areas = areas_under_curves(scored, label=spec.label, by=RUN_KEYS)
    return sweep.join(areas, list(RUN_KEYS)).select(
        F.lit(version).alias("model_version"),
        "threshold",
        "precision",
        "recall",
        "f1_score",
        "tp",
        "fp",
        "tn",
        "fn",
        "auc_pr",
        "roc_auc",
        F.lit(created_at).alias("created_at"),
    )


def long_model_metrics(model_metrics: DataFrame, threshold: float) -> DataFrame:
    """The deployed model's metrics at its own threshold, one row per metric."""
    at = model_metrics.filter(F.abs(F.col("threshold") - F.lit(threshold)) < 1e-9)
    names = ("precision", "recall", "f1_score", "auc_pr", "roc_auc", "threshold")
    rows = long_metrics(at, ("model_version", "created_at"), {name: name for name in names})
    return rows.select("model_version", "metric_name", "metric_value", "created_at")


def run_experiment(
    silver: DataFrame,
    spec: TransactionSpec,
    experiment: ExperimentSpec,
    model_base: str,
    registry: str,
    name: str = "temporal",
    now: datetime | None = None,
) -> ExperimentResult:
    """Split, fit, choose on validation, report on test, refit and register.

    What reaches the driver: two cut points, six label counts, one row per run, and the
    fitted models. Scores of all runs are stored once and evaluated together.
    """
    started = now or datetime.now(timezone.utc)
    created_at = started.isoformat()
    experiment_id = f"{name}-{started.strftime('%Y%m%d%H%M%S')}"

    blocks = prepare_blocks(silver, spec, experiment)
    runs = fit_runs(blocks, spec, experiment, f"{model_base}/experiments/{experiment_id}")

    scored = materialize(score_runs(blocks.block(VALIDATION), runs, spec), "validation-scores")
    validation = materialize(validation_results(scored, spec, experiment), "validation-runs")
    champion_id = champion(validation).first()["candidate_id"]
    threshold = median_threshold(validation.filter(F.col("candidate_id") == champion_id)).first()[0]

    winners = [run for run in runs if run.candidate_id == champion_id]
    test_scored = materialize(score_runs(blocks.block(TEST), winners, spec), "test-scores")
    test = materialize(test_results(test_scored, validation, spec), "test-runs")

    results = validation.withColumn("split_name", F.lit("validation")).unionByName(
        test.withColumn("split_name", F.lit("test")), allowMissingColumns=True
    )
    metrics = experiment_metrics(
        mark_selected(results, champion_id), experiment_id, blocks.row_counts, created_at
    )
    summary = experiment_summary(metrics)

    deployed, weights = fit_deployment(blocks, spec, experiment, champion_id)
    version = f"{experiment_id}-deployment"
    base = f"{model_base}/deployed/{version}"
    forest_path, boosted_path = deployed.save(base)

    final = [FittedRun(champion_id, 0, 0, experiment.seeds[0], deployed)]
    final_scored = materialize(score_runs(blocks.block(TEST), final, spec), "deployed-scores")
    model_metrics = materialize(
        deployed_model_metrics(final_scored, spec, experiment, version, created_at), "model-metrics"
    )

    test_means = {
        row["metric_name"]: row["mean_value"]
        for row in summary.filter(
            (F.col("split_name") == "test") & (F.col("metric_name") != "threshold")
        ).collect()
    }
    record = ModelRecord(
        model_version=version,
        model_base_path=base,
        rf_model_path=forest_path,
        gbt_model_path=boosted_path,
        threshold=float(threshold),
        threshold_policy=experiment.policy.name,
        training_timestamp=started,
        feature_columns=list(spec.features),
        class_weights={"0": weights.legit, "1": weights.positive},
        experiment_id=experiment_id,
        protocol=protocol_of(experiment),
        time_cut_points={
            "train_validation": blocks.cuts.validation_from,
            "validation_test": blocks.cuts.test_from,
        },
        split_rows=blocks.row_counts,
        candidate_id=champion_id,
        seeds=list(experiment.seeds),
        test_summary=test_means,
    )
    register(silver.sparkSession, registry, record)
    return ExperimentResult(
        metrics, summary, model_metrics, long_model_metrics(model_metrics, float(threshold)), record
    )


def write_experiment(
    result: ExperimentResult, spec: TransactionSpec, targets: Mapping[str, str] | None = None
) -> None:
    """Append an experiment's rows to its four tables; ``targets`` replaces table names."""
    tables = layer_tables(spec)
    for name, rows in (
        ("gold.experiment_metrics", result.metrics),
        ("gold.experiment_summary", result.summary),
        ("gold.model_metrics", result.model_metrics),
        ("ml.model_metrics", result.long_model_metrics),
    ):
        save_layer(rows, tables[name], target=(targets or {}).get(name))
