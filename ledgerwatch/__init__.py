"""Transaction-risk analytics on Spark tables and streams."""

from ledgerwatch.spec import (
    Candidate,
    ExperimentSpec,
    SplitFractions,
    ThresholdPolicy,
    TransactionSpec,
)

__all__ = ["Candidate", "ExperimentSpec", "SplitFractions", "ThresholdPolicy", "TransactionSpec"]
