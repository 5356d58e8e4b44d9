"""Best-fit packing of documents into sequences of a fixed number of tokens: large-item matching.

Lengths are whole numbers up to the capacity, so the counts of each length decide the whole
packing and have at most ``capacity`` rows, whatever the data. ``plan`` packs these counts:

* Pieces above a third of the capacity go first. No three of them fit together, so they pair at
  most twice per sequence: the longest takes the longest partner that fits, greedily.
* Shorter pieces, longest first, go into the smallest gap that holds them.

Sequences that are filled alike are kept as one range of sequence numbers, so a plan is a list
of runs: "pieces number r to r + k of this length go to sequences s to s + k at this offset".
Every piece has a number among the pieces of its length and looks its place up in the plan. No
group is gathered: a length that a third of all pieces share is a count like any other.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from llm.rows import on_workers, smaller, spans, stored
from llm.tokens import encoder, with_end

RANKS = 1 << 44  # above any count of pieces of one length


class Plan:
    """Runs of placed pieces: length, first rank, how many, first sequence, offset in each."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.runs: list[tuple[int, int, int, int, int]] = []
        self.used = dict.fromkeys(counts, 0)
        self.sequences = 0
        self.capacity = capacity
        self.gaps: dict[int, list[tuple[int, int]]] = {}  # gap: ranges (first sequence, how many)
        left = {length: n for length, n in counts.items() if n}
        third = capacity / 3
        self._pair(sorted((x for x in left if x > third), reverse=True), left)
        for length in sorted((x for x in left if x <= third), reverse=True):
            self._fill(length, left[length])

    def _place(self, length: int, count: int, sequence: int, offset: int) -> None:
        self.runs.append((length, self.used[length], count, sequence, offset))
        self.used[length] += count

    def _open(self, count: int) -> int:
        first = self.sequences
        self.sequences += count
        return first

    def _leave(self, gap: int, sequence: int, count: int) -> None:
        if gap and count:
            self.gaps.setdefault(gap, []).append((sequence, count))

    def _pair(self, large: list[int], left: dict[int, int]) -> None:
        for length in large:
            for partner in large:
                if not left[length]:
                    break
                if partner > length or length + partner > self.capacity or not left[partner]:
                    continue
                pairs = left[length] // 2 if partner == length else min(left[length], left[partner])
                if not pairs:
                    continue
                first = self._open(pairs)
                self._place(length, pairs, first, 0)
                self._place(partner, pairs, first, length)
                left[length] -= pairs
                left[partner] -= pairs
                self._leave(self.capacity - length - partner, first, pairs)
            if left[length]:
                first = self._open(left[length])
                self._place(length, left[length], first, 0)
                self._leave(self.capacity - length, first, left[length])
                left[length] = 0

    def _fill(self, length: int, count: int) -> None:
        for gap in sorted(g for g in self.gaps if g >= length):
            for first, many in self.gaps.pop(gap):
                done = self._stack(length, count, first, many, gap)
                count -= done
            if not count:
                return
        each = self.capacity // length
        many = -(-count // each)
        self._stack(length, count, self._open(many), many, self.capacity)

    def _stack(self, length: int, count: int, first: int, many: int, gap: int) -> int:
        """Fill sequences one after the other, as the smallest gap asks for; what it placed."""
        each = gap // length
        full = min(many, count // each)
        rest = min(count - full * each, each) if full < many else 0
        offset = self.capacity - gap
        for k in range(each if full else 0):
            self._place(length, full, first, offset + k * length)
        self._leave(gap - each * length, first, full)
        for k in range(rest):
            self._place(length, 1, first + full, offset + k * length)
        if rest:
            self._leave(gap - rest * length, first + full, 1)
        begun = full + (rest > 0)
        self._leave(gap, first + begun, many - begun)
        return full * each + rest

    def tables(self) -> tuple[np.ndarray, ...]:
        """Sorted keys (length and rank), first sequence, first rank and offset of each run."""
        table = np.array(self.runs, dtype=np.int64).reshape(-1, 5)
        key = table[:, 0] * RANKS + table[:, 1]
        order = np.argsort(key)
        return key[order], table[order, 3], table[order, 1], table[order, 4]


PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long"


def _pieces(path: str, end: int | None, capacity: int, keep_ids: bool):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch in smaller(batches, 1):
            ids, counts = encoder(path).encode(batch.column(1))
            if end is not None:
                ids, counts = with_end(ids, counts, end)
            many = np.maximum(1, -(-counts // capacity))
            piece = spans(np.zeros(len(counts), np.int64), many)
            short = np.repeat(counts - (many - 1) * capacity, many)  # the first piece's length
            length = np.where(piece == 0, short, capacity)
            start = np.where(piece == 0, 0, short + (piece - 1) * capacity)
            begin = np.repeat(np.cumsum(counts) - counts, many) + start
            plain = ids.astype("<u4")
            bounds = list(zip(begin.tolist(), (begin + length).tolist()))
            # The piece's number among this task's pieces of its length.
            order = np.argsort(length, kind="stable")
            by = np.bincount(length, minlength=capacity + 1)
            rank = np.empty(len(length), dtype=np.int64)
            rank[order] = spans(seen, by)
            seen += by
            columns = {
                "doc_id": batch.column(0).take(pa.array(np.repeat(np.arange(len(counts)), many))),
                "piece": pa.array(piece, pa.int32()), "start": pa.array(start), "length": pa.array(length),
                "ids_crc32": pa.array([zlib.crc32(plain[a:b]) for a, b in bounds], pa.int64()),
                "part": pa.array(np.full(len(piece), part, np.int32)), "rank": pa.array(rank),
            }
            if keep_ids:
                columns["ids"] = pa.array([plain[a:b].tobytes() for a, b in bounds], pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    return of


def _placed(plan: Plan, names: list[str]):
    keys, sequence, first, offset = plan.tables()

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("rank").to_numpy() + batch.column("before").to_numpy()
            length = batch.column("length").to_numpy()
            run = np.searchsorted(keys, length * RANKS + rank, side="right") - 1
            columns = {name: batch.column(name) for name in names}
            columns["sequence_id"] = pa.array(sequence[run] + rank - first[run])
            columns["offset"] = pa.array(offset[run])
            yield pa.RecordBatch.from_pydict(columns)

    return of


def pack(
    docs: DataFrame, tokenizer: str, capacity: int = 1024, end: int | None = 2, id_col: str = "doc_id",
    text_col: str = "text", keep_ids: bool = False,
) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; with
    ``keep_ids`` also its ids, as little-endian 32-bit numbers.

    A document of more than ``capacity`` tokens is cut into pieces of ``capacity``, its first
    piece being the shorter one. A null or empty text is the end id alone; without an end id it
    is a piece of length 0, which takes offset 0 of a sequence of its own. A null id is kept,
    rows with the same id are packed each for itself, other columns are not read. Without rows
    there are no pieces.
    """
    spark = docs.sparkSession
    on_workers(spark)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    schema = PIECE + (", ids binary" if keep_ids else "")
    pieces = stored(own.mapInArrow(_pieces(tokenizer, end, capacity, keep_ids), schema), "pieces")
    per_task = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    earlier = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    before = per_task.select("length", "part", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    before = stored(before, "piece-counts")
    # At most one row per length: capacity + 1 of them.
    counts = {r["length"]: r["n"] for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan = Plan(counts, capacity) if 0 not in counts else _with_empty(counts, capacity)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else [])]
    kinds = {f.name: f.dataType.simpleString() for f in pieces.schema}
    schema = ", ".join([*(f"{n} {kinds[n]}" for n in names), "sequence_id long", "offset long"])
    return pieces.join(before.drop("n"), ["length", "part"]).mapInArrow(_placed(plan, names), schema)


def _with_empty(counts: dict[int, int], capacity: int) -> Plan:
    plan = Plan({k: n for k, n in counts.items() if k}, capacity)
    plan.used[0] = 0
    plan._place(0, counts[0], plan._open(counts[0]), 0)
    return plan


def sequences(placed: DataFrame) -> DataFrame:
    """The packed sequences themselves, from ``pack(..., keep_ids=True)``: sequence_id, the ids of
    its pieces in order, and where each piece ends. A sequence has at most ``capacity`` ids."""
    inside = F.sort_array(F.collect_list(F.struct("offset", "length", "ids")))
    packed = placed.groupBy("sequence_id").agg(inside.alias("pieces"))
    ids = F.aggregate("pieces", F.lit(b""), lambda whole, p: F.concat(whole, p["ids"]))
    ends = F.transform("pieces", lambda p: p["offset"] + p["length"])
    return packed.select("sequence_id", ids.alias("ids"), ends.alias("ends"))
