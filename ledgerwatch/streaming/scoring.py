"""Scores, alerts and outgoing messages, one scoring step at a time."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerwatch.operators.ensemble import DeployedModel, score_table
from ledgerwatch.operators.kpi import alerts
from ledgerwatch.sources.catalog import layer_tables, read_step, replace_step
from ledgerwatch.sources.writers import as_messages, leaf_folder, write_messages
from ledgerwatch.spec import TransactionSpec


@dataclass(frozen=True)
class TopicSink:
    """Where messages go. A topic appends, at least once; for a file format ``folder`` is
    given a sub-folder per scoring step, which a repeated step replaces."""

    sink_format: str
    options: Mapping[str, str] = field(default_factory=dict)
    folder: str | None = None

    def send(self, messages: DataFrame, run: str, batch_id: int) -> None:
        if self.folder is None:
            write_messages(messages, self.sink_format, self.options)
            return
        step = leaf_folder(self.folder, {"scoring_run": run, "scoring_batch_id": batch_id})
        write_messages(messages, self.sink_format, {**self.options, "path": step}, "overwrite")


@dataclass(frozen=True)
class ScoreSinks:
    scores: str = "gold.fraud_scores"
    alerts: str = "gold.fraud_alerts"
    scored_topic: TopicSink | None = None
    alert_topic: TopicSink | None = None


def write_step(
    rows: DataFrame,
    model: DeployedModel,
    spec: TransactionSpec,
    sinks: ScoreSinks,
    run: str,
    batch_id: int,
    scored_at: datetime | None = None,
) -> None:
    """Score rows once, store them, and derive everything else from the stored scores.

    The score partition of this run and batch is replaced as a whole, then read back for
    the alerts and the messages: the models run once, and a repeated step ends with the
    rows of its last attempt only.
    """
    spark = rows.sparkSession
    tables = layer_tables(spec)
    stamp = F.lit(scored_at or datetime.now(timezone.utc))
    keys = {"scoring_run": run, "scoring_batch_id": batch_id}
    scored = score_table(rows, model, spec, stamp, batch_id)
    replace_step(scored, tables["gold.fraud_scores"], keys, sinks.scores)

    stored = read_step(spark, tables["gold.fraud_scores"], keys, sinks.scores)
    raised = alerts(stored)
    replace_step(raised, tables["gold.fraud_alerts"], keys, sinks.alerts)
    for sink, frame in ((sinks.scored_topic, stored), (sinks.alert_topic, raised)):
        if sink is not None:
            sink.send(as_messages(frame, spec.id, spec.score_columns), run, batch_id)


def micro_batch_writer(
    model: DeployedModel, spec: TransactionSpec, sinks: ScoreSinks, run: str
) -> Callable[[DataFrame, int], None]:
    """The ``foreachBatch`` function; models are loaded once, by the caller."""

    def write(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            write_step(batch, model, spec, sinks, run, batch_id)

    return write


def start_scoring(
    silver: DataFrame,
    model: DeployedModel,
    spec: TransactionSpec,
    sinks: ScoreSinks,
    checkpoint: str,
    run: str,
    trigger: dict[str, object] | None = None,
) -> StreamingQuery:
    """Score a stream of typed rows. ``run`` must be new for every new checkpoint, since
    batch numbers start again with it."""
    return (
        silver.writeStream.foreachBatch(micro_batch_writer(model, spec, sinks, run))
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "30 seconds"}))
        .start()
    )


def score_batch(
    silver: DataFrame,
    model: DeployedModel,
    spec: TransactionSpec,
    sinks: ScoreSinks,
    run: str | None = None,
    scored_at: datetime | None = None,
) -> None:
    """Score a whole typed table as batch 0 of a run named after the model version."""
    if silver.isEmpty():
        raise ValueError("There are no typed rows to score; build the typed layer first.")
    write_step(silver, model, spec, sinks, run or f"batch-{model.version}", 0, scored_at)
