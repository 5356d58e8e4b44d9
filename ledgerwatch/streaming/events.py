"""JSON events: encoding rows into them and parsing them into the raw layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ledgerwatch.functions.identity import content_id, raw_event_key
from ledgerwatch.functions.lenient import blank_to_null, strict_double
from ledgerwatch.sources.catalog import layer_tables
from ledgerwatch.sources.writers import start_append
from ledgerwatch.spec import PROVENANCE_COLUMNS, TransactionSpec
from ledgerwatch.streaming.progress import observed
from ledgerwatch.streaming.stateful import first_deliveries

REJECT_COLUMN = "_unparsed"


def encode_events(
    rows: DataFrame,
    spec: TransactionSpec,
    source_file: str,
    now: Column | None = None,
    carried: tuple[str, ...] = (),
) -> DataFrame:
    """key / value messages: one JSON event per row, its fields in name order.

    A blank or missing id becomes the content hash of the features as numbers, a missing
    event time becomes ``now`` in ISO form with offset, blank numbers become JSON nulls.
    Text that is no number stops the job. ``carried`` columns are kept beside the message.
    """
    clock = F.current_timestamp() if now is None else now
    written = F.date_format(clock, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")

    kinds = dict(rows.dtypes)

    def given(name: str) -> Column:
        return blank_to_null(F.col(name).cast("string")) if name in kinds else F.lit(None)

    def number(name: str) -> Column:
        is_text = kinds[name] == "string"
        return strict_double(F.col(name), name) if is_text else F.col(name).cast("double")

    # As numbers, like the typed layer does it: "1" and "1.0" are the same transaction.
    derived = content_id([number(name) for name in spec.features])
    fields = {
        spec.id: F.coalesce(given(spec.id), derived),
        spec.event_time: F.coalesce(given(spec.event_time), written),
        spec.source: F.lit(source_file),
        **{name: number(name) for name in spec.required},
    }
    event = F.struct(*[fields[name].alias(name) for name in sorted(fields)])
    return rows.select(event.alias("event"), *carried).select(
        F.col(f"event.{spec.id}").alias("key"),
        F.to_json("event", {"ignoreNullFields": "false"}).alias("value"),
        *carried,
    )


def parse_messages(
    messages: DataFrame,
    spec: TransactionSpec,
    ingested_at: Column | None = None,
    keep_unparsed: bool = False,
) -> DataFrame:
    """Raw-layer rows from topic messages (``value``, ``topic``, ``partition``, ``offset``).

    Works on streams and tables alike and does not shuffle. Text that is no JSON gives a
    row of NULLs, a single unreadable field a NULL in its place; ``keep_unparsed`` adds
    the original text of such rows.
    """
    schema = T.StructType([*spec.event_schema.fields, T.StructField(REJECT_COLUMN, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": REJECT_COLUMN}
    topic, partition, offset = PROVENANCE_COLUMNS
    parsed = messages.select(
        F.from_json(F.col("value").cast("string"), schema, options).alias("event"),
        F.col("topic").alias(topic),
        F.col("partition").alias(partition),
        F.col("offset").alias(offset),
        (F.current_timestamp() if ingested_at is None else ingested_at).alias(spec.ingested_at),
    ).select("event.*", *PROVENANCE_COLUMNS, spec.ingested_at)
    keyed = parsed.withColumn(
        spec.raw_id, raw_event_key(F.col(spec.id), F.col(partition), F.col(offset))
    )
    extra = [REJECT_COLUMN] if keep_unparsed else []
    return keyed.select(*spec.bronze_columns, *extra)


def unparsed(parsed: DataFrame) -> DataFrame:
    """The messages that did not parse completely, with their text and origin."""
    return parsed.filter(F.col(REJECT_COLUMN).isNotNull()).select(
        *PROVENANCE_COLUMNS, F.col(REJECT_COLUMN).alias("value")
    )


def start_bronze(
    messages: DataFrame,
    spec: TransactionSpec,
    target: str,
    checkpoint: str,
    trigger: dict[str, object] | None = None,
    sink_format: str = "parquet",
    once_within: str | None = None,
    ingested_at: Column | None = None,
    name: str | None = None,
) -> StreamingQuery:
    """Append parsed messages to the raw table, partitioned by ingestion date.

    With ``once_within`` ("2 hours") a message that is delivered again within that time is
    stored once (:func:`~ledgerwatch.streaming.stateful.first_deliveries`). A stream with a
    ``name`` counts what each micro-batch delivers, for :mod:`~ledgerwatch.streaming.progress`.
    """
    table = layer_tables(spec)["bronze.transactions_raw"]
    parsed = parse_messages(messages, spec, ingested_at, keep_unparsed=bool(name))
    if name:
        _, partition, offset = PROVENANCE_COLUMNS
        newest = F.try_to_timestamp(spec.event_time)
        parsed = observed(parsed, partition, offset, newest, F.col(spec.ingested_at), F.col(REJECT_COLUMN).isNotNull())
    if once_within:
        parsed = first_deliveries(parsed, spec.raw_id, spec.ingested_at, once_within)
    rows = table.laid_out(parsed)
    return start_append(rows, target, checkpoint, table.partition_by, trigger, sink_format, name)


def start_rejects(
    messages: DataFrame,
    spec: TransactionSpec,
    target: str,
    checkpoint: str,
    trigger: dict[str, object] | None = None,
    sink_format: str = "parquet",
) -> StreamingQuery:
    """Append the text and origin of messages that did not parse, beside the raw table.

    A stream of its own with its own checkpoint: it can be started later, or again from the
    beginning, without touching the raw rows. ``raw_event_id`` names the row that
    ``start_bronze`` stores for the same message.
    """
    parsed = parse_messages(messages, spec, keep_unparsed=True)
    broken = parsed.filter(F.col(REJECT_COLUMN).isNotNull())
    rows = broken.select(
        spec.raw_id, *PROVENANCE_COLUMNS, spec.ingested_at, F.col(REJECT_COLUMN).alias("value")
    )
    return start_append(rows, target, checkpoint, (), trigger, sink_format)
