"""Helpers that the operators share: code on workers, row numbers, ordered parts, grouped batches."""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwatch.session import materialize

ROW = "_llm_row"
MIN_LONG = -(2**63)
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def on_workers(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.

    A cluster whose machines do not share that folder gets the package by ``--py-files``.
    """
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if ROOT not in known.split(os.pathsep):
        joined = os.pathsep.join(filter(None, [ROOT, known]))
        spark.sparkContext.environment["PYTHONPATH"] = joined


def parts_of(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def stored(df: DataFrame, label: str) -> DataFrame:
    """A reused table under the shared folder."""
    return materialize(df, f"llm-{label}")


def numbered(df: DataFrame, label: str, row: str = ROW) -> DataFrame:
    """The rows, stored, each with a number of its own that later reads agree on."""
    return stored(df.withColumn(row, F.monotonically_increasing_id()), label)


def wrapped(docs: DataFrame, text_col: str) -> DataFrame:
    """``text``, and all other columns as the struct ``doc``: whatever their names are, they do
    not meet those that an operator adds beside."""
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    return docs.select(F.struct(*others or [F.lit(0).alias("none")]).alias("doc"), F.col(f"`{text_col}`").alias("text"))


def unwrapped(df: DataFrame, docs: DataFrame, text_col: str) -> DataFrame:
    """The columns of ``docs`` again, in their order."""
    names = [F.col("text").alias(c) if c == text_col else F.col(f"doc.`{c}`") for c in docs.columns]
    return df.select(*names)


def crc_rest(column: str, divisor: int) -> Column:
    """crc32 of an id as text, modulo ``divisor``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor


class Ranges:
    """Numbers for ranges of a whole-number key in ascending order, nulls first.

    A key value that holds several quantiles gets ranges of its own, over which any hash of
    the row deals its rows. ``total`` is how many numbers there are.
    """

    def __init__(self, quantiles: list[int], parts: int):
        cuts: list[tuple[int, int]] = []  # first key value of a range; ranges it is dealt over
        for value in sorted(set(quantiles)):
            times = quantiles.count(value)
            if cuts and cuts[-1][0] == value:
                cuts.pop()
            cuts.append((value, times))
            if times > 1 and value < 2**63 - 1:
                cuts.append((value + 1, 1))
        nulls = 1 if quantiles else parts
        self.edges = np.array([c for c, _ in cuts], dtype=np.int64)
        self.width = np.array([nulls, 1, *[w for _, w in cuts]], dtype=np.uint64)
        self.first = (np.cumsum(self.width) - self.width).astype(np.int64)
        self.total = int(self.width.sum())

    def of(self, keys: np.ndarray, null: np.ndarray, spread: np.ndarray) -> np.ndarray:
        place = np.where(null, 0, 1 + np.searchsorted(self.edges, keys, side="right"))
        return self.first[place] + (spread.astype(np.uint64) % self.width[place]).astype(np.int64)


def ranges_of(df: DataFrame, key: str, parts: int) -> Ranges:
    """Ranges of about equal row counts. Only the key column is read, for its quantiles."""
    if parts < 2:
        return Ranges([], 1)
    shares = [k / parts for k in range(1, parts)]
    found = df.select(F.percentile_approx(key, F.lit(shares), F.lit(10_000)).alias("q")).first()["q"]
    return Ranges([int(x) for x in found or []], parts)


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Cut batches that are sorted by ``keys`` (whole numbers) into slices of one key each."""
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, dtype=bool)
        change[0] = True
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        at = np.flatnonzero(change).tolist()
        for a, b in zip(at, [*at[1:], batch.num_rows]):
            yield tuple(int(c[a]) for c in columns), batch.slice(a, b - a)


def smaller(batches: Iterator[pa.RecordBatch], column: int | str, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a text column has about ``most`` bytes in each, or one row."""
    for batch in batches:
        bounds = offsets_of(batch.column(column))
        at = 0
        while at < batch.num_rows:
            stop = int(np.searchsorted(bounds, bounds[at] + most, side="right")) - 1
            stop = min(max(stop, at + 1), batch.num_rows)
            yield batch.slice(at, stop - at)
            at = stop


def offsets_of(column: pa.Array) -> np.ndarray:
    """Where each list, text or binary value of an Arrow column begins, and the end."""
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    raw = np.frombuffer(column.buffers()[1], dtype=kind)
    return raw[column.offset : column.offset + len(column) + 1].astype(np.int64)


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of the spans, one span after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def pieces_for(rows: int, each: int) -> int:
    return max(1, math.ceil(rows / each))


def united(group: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Groups after linking members; every group is named after its first member."""
    while True:
        x, y = group[a], group[b]
        differ = x != y
        if not differ.any():
            return group
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        lower = np.arange(len(group))
        np.minimum.at(lower, np.maximum(x, y), np.minimum(x, y))
        while True:
            again = lower[lower]
            if (again == lower).all():
                break
            lower = again
        group = lower[group]
