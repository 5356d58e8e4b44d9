"""The operators of this package bound to the given tables, and SQL twins where SQL can say it.

Each query calls its operator with the parameters it would run with, over the whole table.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from ledgerwatch.session import scratch_path
from llm import graph_search, host_rules, interpolation, mixing, periodic_runs, pu_quality, repeats, sign_hashing, simhash, urls, whitening
from llm.oracles import ORACLES
from llm.packing import pack
from llm.simple8b import read_digests, write_ids
from llm.text import with_periodic_tail

__all__ = ["ORACLES", "QUERIES"]

TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), distance=4)


def op2_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph_search.neighbours(table(spark, sf_dir, "embeddings"), k=20, every=20)


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "llm-token-files")
    write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path(TOKENIZER), end=0)
    return read_digests(spark, path)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), capacity=1024, end=2)


def op4_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpolation.score(table(spark, sf_dir, "documents"))


def op5_positive_unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pu_quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = host_rules.judge(table(spark, sf_dir, "documents"))
    return judged.withColumns({n: F.round(n, 9) for n in ("excess", "tolerance")})


def op7_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix_sizes(docs, weights=(3, 1, 2), share=(3, 2), cap=2)


URL_RULES = (
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
)


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op10_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.remove_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), k=16)


def op12_sign_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sign_hashing.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.95)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return periodic_runs.run_digest(periodic_runs.collapse_runs(docs, least=12, prepare=with_periodic_tail))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_graph_search": op2_graph_search,
    "op3_token_files": op3_token_files,
    "op4_deleted_interpolation": op4_deleted_interpolation,
    "op5_positive_unlabelled": op5_positive_unlabelled,
    "op6_host_rules": op6_host_rules,
    "op7_mix_sources": op7_mix_sources,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_url_filter": op9_url_filter,
    "op10_repeated_phrases": op10_repeated_phrases,
    "op11_whitening": op11_whitening,
    "op12_sign_hashing": op12_sign_hashing,
    "op13_periodic_runs": op13_periodic_runs,
    "pipeline": corpus_pipeline.run,
}
