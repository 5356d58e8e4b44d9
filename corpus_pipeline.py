"""From raw documents to packed sequences, one operator of ``llm`` after the other.

A stage is called with all rows that the stage before it kept, and its result is written and
read again before the next. All stages but the last return the columns of the documents.

What a stage stores on its way is removed when the next one begins, whose documents are then its
written result; it stays if they still read any of it.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from ledgerwatch.session import Scratch, scratch_work
from llm import host_rules, mixing, near_copies, packing, repeats
from llm.rows import stored

CAPACITY = 1024
TOKENIZER = "byte_bpe_50k.json"
END = 2


_before: dict[str, Scratch] = {}  # by application: what its last stage stored

# Python workers serve one stage after the other. With these they give freed memory back to the
# machine instead of keeping what the largest batch so far took.
WORKERS = {
    "MALLOC_TRIM_THRESHOLD_": "4194304",
    "MALLOC_MMAP_THRESHOLD_": "4194304",
    "ARROW_DEFAULT_MEMORY_POOL": "system",
}


def stage(build):
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        application = spark.sparkContext.applicationId
        for name, value in WORKERS.items():
            spark.sparkContext.environment.setdefault(name, value)
        last = _before.pop(application, None)
        if last is not None and not last.holds(docs):
            last.remove(spark)
        with scratch_work() as work:
            out = build(spark, docs, sf_dir)
        _before[application] = work
        return out

    run_stage.__name__, run_stage.__doc__ = build.__name__, build.__doc__
    return run_stage


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and their host's verdict let stay."""
    return host_rules.keep(docs)


@stage
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, 0.8 or more in common."""
    return near_copies.keep_one(docs, width=5, share=(4, 5))


@stage
def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the passages that occur more than once."""
    return repeats.without_repeats(docs)


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of each source as often as its target asks for."""
    return mixing.mix(docs)


@stage
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in which sequence."""
    return packing.pack(docs, public_tokenizers.path(TOKENIZER), capacity=CAPACITY, end=END)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]
# Fingerprints (XXH64) and tokens are beyond the SQL engine; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, build in STAGES[:-1]:
        docs = stored(build(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
