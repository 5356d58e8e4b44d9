"""Parameters shared by the operators: which columns mean what, and how to run an experiment.

Everything here is plain data. No class touches a Spark session, so a spec can be
built once on the driver and handed to any operator.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

# The column names of the card-transaction data set and of its event envelope.
CARD_FEATURES = ("Time", *(f"V{i}" for i in range(1, 29)), "Amount")
CARD_LABEL_SOURCE = "Class"
PROVENANCE_COLUMNS = ("kafka_topic", "kafka_partition", "kafka_offset")

# The experiment protocol (chronological 60/20/20, five seeds, 0.05 .. 0.95).
DEFAULT_SEEDS = (42, 52, 62, 72, 82)
DEFAULT_THRESHOLDS = tuple(round(0.05 * step, 2) for step in range(1, 20))

# The names a threshold policy may have.
BEST_F1 = "best_f1"
RECALL_WITH_FLOOR = "max_recall_with_precision_floor"
RECALL_WITH_FLOOR_ALIAS = "recall_at_min_precision"
POLICIES = (BEST_F1, RECALL_WITH_FLOOR, RECALL_WITH_FLOOR_ALIAS)


@dataclass(frozen=True)
class TransactionSpec:
    """Names the roles of columns, so one operator set serves any feature list."""

    features: tuple[str, ...] = CARD_FEATURES
    label_source: str = CARD_LABEL_SOURCE
    time: str = "Time"
    amount: str = "Amount"
    id: str = "transaction_id"
    event_time: str = "event_time"
    timestamp: str = "event_timestamp"
    label: str = "label"
    weight: str = "class_weight"
    source: str = "source_file"
    raw_id: str = "raw_event_id"
    ingested_at: str = "ingestion_timestamp"

    @property
    def required(self) -> tuple[str, ...]:
        """Columns an input file must have, in the order they are reported when missing."""
        return (*self.features, self.label_source)

    @property
    def event_schema(self) -> T.StructType:
        """Schema of one JSON event: three text fields, then every number as a double."""
        text = [T.StructField(name, T.StringType()) for name in (self.id, self.event_time, self.source)]
        numbers = [T.StructField(name, T.DoubleType()) for name in self.required]
        return T.StructType(text + numbers)

    # The columns of the raw, the typed and the feature table.
    @property
    def bronze_columns(self) -> tuple[str, ...]:
        return (self.id, self.event_time, *self.required, *self._origin)

    @property
    def _typed(self) -> tuple[str, ...]:
        """The event as typed columns: identity and time, numbers."""
        return (self.id, self.event_time, self.timestamp, *self.required)

    @property
    def _target(self) -> tuple[str, ...]:
        return (self.label, self.weight)

    @property
    def silver_columns(self) -> tuple[str, ...]:
        return (*self._typed, *self._target, *self._origin)

    @property
    def feature_table_columns(self) -> tuple[str, ...]:
        return (*self._typed, *self._target, "feature_array", *self._origin)

    @property
    def score_columns(self) -> tuple[str, ...]:
        # The columns of the score table and of its messages.
        return (
            self.id,
            self.timestamp,
            self.amount,
            self.label,
            "rf_fraud_probability",
            "gbt_fraud_probability",
            "fraud_score",
            "prediction",
            "threshold_used",
            "model_version",
            "scored_at",
            "scoring_batch_id",
        )

    @property
    def _origin(self) -> tuple[str, ...]:
        return (self.ingested_at, *PROVENANCE_COLUMNS, self.source, self.raw_id)


@dataclass(frozen=True)
class SplitFractions:
    """Shares of the chronological split; what is left over is the test block."""

    train: float = 0.60
    validation: float = 0.20

    @property
    def quantiles(self) -> tuple[float, float]:
        return (float(self.train), float(self.train + self.validation))


@dataclass(frozen=True)
class ThresholdPolicy:
    name: str = RECALL_WITH_FLOOR
    min_precision: float = 0.70

    def __post_init__(self) -> None:
        if self.name not in POLICIES:
            raise ValueError(f"Unsupported threshold policy: {self.name}")

    @property
    def uses_floor(self) -> bool:
        return self.name != BEST_F1


@dataclass(frozen=True)
class Candidate:
    """One pair of model sizes in the comparison."""

    id: str
    forest_trees: int
    forest_depth: int
    boosting_rounds: int
    boosting_depth: int


# The two candidates of the published protocol.
DEFAULT_CANDIDATES = (
    Candidate("compact", forest_trees=80, forest_depth=8, boosting_rounds=50, boosting_depth=3),
    Candidate("extended", forest_trees=120, forest_depth=10, boosting_rounds=60, boosting_depth=4),
)


@dataclass(frozen=True)
class ExperimentSpec:
    """Parameters of one candidate x seed comparison.

    ``fit_rows_per_partition`` fixes the row layout a fit sees: rows are dealt over as many
    partitions as that takes, up to 64; then partitions grow to 500,000 rows before there are
    more of them. Tree training depends on the layout, not only on its seed; the layout depends
    on the rows alone, so a repeated fit agrees.

    ``exact_trees`` fits every tree to all rows, all features and every midpoint between values,
    for features of few values and models that must not depend on a seed or a layout. Rows with
    equal label and features are fitted as one of their joint weight.

    ``parallel_fits`` fits run side by side. Late tree levels are small jobs that leave a
    cluster idle; each fit running at once caches its own copy of the binned rows.
    """

    candidates: tuple[Candidate, ...] = DEFAULT_CANDIDATES
    seeds: tuple[int, ...] = DEFAULT_SEEDS
    thresholds: tuple[float, ...] = DEFAULT_THRESHOLDS
    policy: ThresholdPolicy = field(default_factory=ThresholdPolicy)
    split: SplitFractions = field(default_factory=SplitFractions)
    quantile_error: float = 1e-4
    exact_cuts: bool = False
    fit_rows_per_partition: int = 500_000
    parallel_fits: int = 1
    exact_trees: bool = False

    def __post_init__(self) -> None:
        for name in ("candidates", "seeds", "thresholds"):
            if not getattr(self, name):
                raise ValueError(f"An experiment needs at least one of its {name}.")

    def candidate(self, candidate_id: str) -> Candidate:
        return next(item for item in self.candidates if item.id == candidate_id)
