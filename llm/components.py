"""Connected components of links: united inside tasks, then large-star and small-star in turns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.rows import on_workers, stored, united


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("m"))


def _large(edges: DataFrame) -> DataFrame:
    """Every vertex links its larger neighbours to the least of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least(both).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every vertex links itself and its smaller neighbours to the least of them."""
    least = _least(edges)
    moved = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.withColumnRenamed("m", "b")).distinct()


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's links as links of every vertex to the least that these links reach."""
    held = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches if b.num_rows]
    if held:
        a, b = (np.concatenate(x) for x in zip(*held))
        names, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        group = united(np.arange(len(names)), place[: len(a)], place[len(a) :])
        own = np.flatnonzero(group != np.arange(len(names)))
        yield pa.RecordBatch.from_arrays([pa.array(names[own]), pa.array(names[group[own]])], ["a", "b"])


def components(links: DataFrame) -> DataFrame:
    """(a, root) for every linked vertex but the roots: the smallest vertex it reaches.

    ``links`` (a, b) are whole numbers in any direction and any number of times. Before each
    round a task unites the links of its own split of the stored table, whose size the session
    bounds; links that are one split are done by that. A hot vertex costs one partial minimum a
    task; the join behind it is one that Spark splits when skewed. The rounds end when every
    vertex links straight to its root, which a round leaves as it is. Round for round the links
    are a stored table, so a lost executor repeats one round.
    """
    on_workers(links.sparkSession)
    high, low = F.greatest("a", "b"), F.least("a", "b")
    edges = stored(links.select(high.alias("a"), low.alias("b")).where("a != b").distinct(), "links")
    known = None
    while True:
        nearer = edges.mapInArrow(_contracted, "a long, b long")
        if edges.rdd.getNumPartitions() < 2:
            return stored(nearer, "links").select("a", F.col("b").alias("root"))
        edges = stored(_small(_large(nearer)), "links")
        state = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if not state["n"] or known == (state["n"], state["h"]):
            return edges.select("a", F.col("b").alias("root"))
        known = (state["n"], state["h"])
