"""Token ids in files of 64-bit words: Simple-8b word-aligned coding.

A word has a selector in its upper 4 bits and a run of ids, each in the same number of bits, in
the other 60. Selector 0 is the escape: the word holds one id as it is, whatever its width. Ids
come in blocks of ``BLOCK``; a word never reaches into the next block, and the place of every
block's first word is stored, so a reader decodes all blocks at once, selector by selector, and
can start at any block. Each document starts a block.

A file is Parquet, written and committed by Spark. A row is a segment of consecutive documents:

    part, seq       place of the segment: ascending (part, seq) is ascending document order
    doc_ids, counts one per document: its id (or null) and how many ids it has
    offsets         the first word of each block
    words           the words, little-endian
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from llm.rows import Ranges, on_workers, parts_of, ranges_of, smaller
from llm.tokens import encoder, with_end

BLOCK = 256
# Ids per word and bits per id, by selector: more ids of fewer bits further down.
PACKED = ((1, 60), (2, 30), (3, 20), (4, 15), (5, 12), (6, 10), (7, 8), (8, 7), (10, 6), (12, 5), (15, 4), (20, 3), (30, 2), (60, 1))
SEGMENT_WORDS = 1 << 18
MASK = (1 << 60) - 1


def _best(wide: np.ndarray, at: np.ndarray, room: np.ndarray) -> np.ndarray:
    """The selector for a word that starts at each position of ``at``; ``room``: ids left in its
    block. ``wide`` has 64 zeros behind the ids.

    What fits under one selector fits under every earlier one, so each step looks only at
    positions that the step before could fill. Behind a block's end there are zeros.
    """
    best = np.zeros(len(at), dtype=np.int64)
    where = np.arange(len(at))
    most = wide[at]
    before = 1
    for selector, (count, bits) in enumerate(PACKED[1:], start=1):
        for step in range(before, count):
            following = wide[at + step]
            following[room <= step] = 0
            most = np.maximum(most, following)
        fits = most < (1 << bits)
        if not fits.all():
            at, most, room, where = at[fits], most[fits], room[fits], where[fits]
            if not len(at):
                break
        best[where] = selector
        before = count
    return best


def encode_blocks(ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of blocks of the given lengths (1 to BLOCK), and how many words each block has."""
    top = int(ids.max()) if len(ids) else 0
    if top > MASK:
        raise ValueError("an id needs more than 60 bits")
    wide = np.concatenate([ids, np.zeros(64, ids.dtype)]).astype(np.uint32 if top < 1 << 32 else np.uint64)
    ends = np.cumsum(lengths)
    take = np.array([c for c, _ in PACKED], dtype=np.int64)
    at, block = ends - lengths, np.arange(len(lengths))
    turns = []
    while len(at):  # one word of every unfinished block a turn
        stop = ends[block]
        best = _best(wide, at, stop - at)
        turns.append((at, block, best))
        at = at + take[best]
        on = at < stop
        at, block = at[on], block[on]
    if not turns:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    at, block, chosen = (np.concatenate(x) for x in zip(*turns))
    order = np.argsort(at)
    at, block, chosen = at[order], block[order], chosen[order]
    words = chosen.astype(np.uint64) << np.uint64(60)
    left = ends[block] - at
    for selector, (count, bits) in enumerate(PACKED):
        mine = np.flatnonzero(chosen == selector)
        start, room = at[mine], left[mine]
        for lane in range(count if len(mine) else 0):
            value = wide[start + lane].astype(np.uint64)
            value[room <= lane] = 0
            words[mine] |= value << np.uint64(lane * bits)
    return words, np.bincount(block, minlength=len(lengths))


def decode_blocks(words: np.ndarray, offsets: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The ids of all blocks, one block after the other; all words of a selector at once."""
    chosen = (words >> np.uint64(60)).astype(np.int64)
    take = np.array([c for c, _ in PACKED], dtype=np.int64)[chosen]
    bounds = np.concatenate([offsets, [len(words)]]).astype(np.int64)
    per_block = np.diff(bounds)
    ends = np.cumsum(lengths)
    starts = ends - lengths
    # Ids in front of each word: those of earlier words of its block, after the block's start.
    running = np.cumsum(take) - take
    at = running - np.repeat(running[np.minimum(bounds[:-1], max(len(words) - 1, 0))], per_block)
    at += np.repeat(starts, per_block)
    stop = np.repeat(ends, per_block)
    out = np.zeros(int(lengths.sum()), dtype=np.uint64)
    for selector, (count, bits) in enumerate(PACKED):
        mine = np.flatnonzero(chosen == selector)
        if not len(mine):
            continue
        lanes = np.arange(count)
        mask = np.uint64((1 << bits) - 1)
        values = (words[mine, None] >> (lanes * bits).astype(np.uint64)) & mask
        place = at[mine, None] + lanes
        keep = place < stop[mine, None]
        out[place[keep]] = values[keep]
    return out


def block_lengths(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths of all blocks of documents with so many ids each, and blocks per document."""
    blocks = -(-counts // BLOCK)
    lengths = np.full(int(blocks.sum()), BLOCK, dtype=np.int64)
    last = np.cumsum(blocks)[blocks > 0] - 1
    lengths[last] = (counts - (blocks - 1) * BLOCK)[blocks > 0]
    return lengths, blocks


CODED = "part int, doc_id long, tie long, n long, words binary, sizes binary"


def _coded(path: str, end: int | None, ranges: Ranges):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in smaller(batches, 1):
            ids, counts = encoder(path).encode(batch.column(1))
            if end is not None:
                ids, counts = with_end(ids, counts, end)
            lengths, blocks = block_lengths(counts)
            words, sizes = encode_blocks(ids, lengths)
            ends = np.cumsum(blocks)
            word_ends = np.concatenate([[0], np.cumsum(sizes)])
            words, sizes = words.astype("<u8"), sizes.astype("<u2")
            payload = [
                (words[word_ends[a] : word_ends[b]].tobytes(), sizes[a:b].tobytes())
                for a, b in zip((ends - blocks).tolist(), ends.tolist())
            ]
            tie = np.array([zlib.crc32(w) for w, _ in payload], dtype=np.int64)
            keys = batch.column(0)
            part = ranges.of(keys.fill_null(0).to_numpy(zero_copy_only=False), keys.is_null().to_numpy(zero_copy_only=False), tie)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(part, pa.int32()), keys, pa.array(tie), pa.array(counts),
                    pa.array([w for w, _ in payload], pa.binary()), pa.array([s for _, s in payload], pa.binary()),
                ],
                ["part", "doc_id", "tie", "n", "words", "sizes"],
            )

    return of


SEGMENT = "part int, seq int, n long, doc_ids array<long>, counts array<long>, offsets array<int>, words binary"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Join consecutive documents of a part to segments of about SEGMENT_WORDS words."""
    part, seq, held, filled = None, 0, [], 0

    def flush() -> pa.RecordBatch:
        sizes = np.frombuffer(b"".join(x[3] for x in held), dtype="<u2").astype(np.int64)
        row = {
            "part": part, "seq": seq, "n": sum(x[1] for x in held), "doc_ids": [x[0] for x in held],
            "counts": [x[1] for x in held], "offsets": (np.cumsum(sizes) - sizes).tolist(), "words": b"".join(x[2] for x in held),
        }
        return pa.RecordBatch.from_pylist([row], schema=_SEGMENT)

    for batch in batches:
        for p, *document in zip(*(batch.column(k).to_pylist() for k in ("part", "doc_id", "n", "words", "sizes"))):
            if held and (p != part or filled >= SEGMENT_WORDS):
                yield flush()
                seq = seq + 1 if p == part else 0
                held, filled = [], 0
            elif p != part:
                seq = 0
            part = p
            held.append(document)
            filled += len(document[2]) // 8
    if held:
        yield flush()


_SEGMENT = pa.schema(
    [
        ("part", pa.int32()), ("seq", pa.int32()), ("n", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
        ("counts", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int32())), ("words", pa.binary()),
    ]
)


def write_ids(
    docs: DataFrame, path: str, tokenizer: str, end: int | None = 0, id_col: str = "doc_id",
    text_col: str = "text", parts: int | None = None,
) -> None:
    """Write the ids of all texts to ``path`` in ascending id order.

    A null text is empty, an empty text has only ``end``. Null ids come first; rows with the
    same id follow each other in an order that their ids alone decide. Texts of any length are
    coded whole: a very long one fills a segment of its own. Other columns are not read.
    """
    on_workers(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ranges = ranges_of(own, "doc_id", parts or parts_of(docs.sparkSession))
    coded = own.mapInArrow(_coded(tokenizer, end, ranges), CODED)
    ordered = coded.repartitionById(ranges.total, "part").sortWithinPartitions("part", "doc_id", "tie", "n")
    ordered.mapInArrow(_segments, SEGMENT).write.parquet(path)


def _decoded(segments: pa.RecordBatch) -> Iterator[tuple[dict, np.ndarray, np.ndarray]]:
    for row in segments.to_pylist():
        counts = np.array(row["counts"], dtype=np.int64)
        lengths, _ = block_lengths(counts)
        words = np.frombuffer(row["words"], dtype="<u8")
        yield row, counts, decode_blocks(words, np.array(row["offsets"], dtype=np.int64), lengths)


DIGEST = "part int, seq int, doc_id long, ahead long, n_tokens long, ids_crc32 long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            for row, counts, ids in _decoded(batch.slice(k, 1)):
                plain = ids.astype("<u4")
                ends = np.cumsum(counts)
                crc = [zlib.crc32(plain[a:b]) for a, b in zip((ends - counts).tolist(), ends.tolist())]
                n = len(counts)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(n, row["part"], np.int32)), pa.array(np.full(n, row["seq"], np.int32)),
                        pa.array(row["doc_ids"], pa.int64()), pa.array(ends - counts), pa.array(counts), pa.array(crc, pa.int64()),
                    ],
                    ["part", "seq", "doc_id", "ahead", "n_tokens", "ids_crc32"],
                )


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            for row, counts, ids in _decoded(batch.slice(k, 1)):
                bounds = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids.astype(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), lists], ["doc_id", "ids"])


def read_ids(spark, path: str) -> DataFrame:
    """doc_id and the list of ids of each document of the files."""
    on_workers(spark)
    return spark.read.schema(SEGMENT).parquet(path).mapInArrow(_ids, "doc_id long, ids array<long>")


def read_digests(spark, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, decoded from the files.

    Starts need the ids of all segments before: sums per part, one row a part, are added up
    along the parts; within a part a window runs over its few segments.
    """
    on_workers(spark)
    files = spark.read.schema(SEGMENT).parquet(path)
    sizes = files.groupBy("part", "seq").agg(F.sum("n").alias("n"))
    ahead = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    parts = parts.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before_part"))
    inside = W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    places = sizes.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(parts, "part")
    found = files.mapInArrow(_digests, DIGEST).join(places.drop("n"), ["part", "seq"])
    start = F.col("before_part") + F.col("inside") + F.col("ahead")
    return found.select("doc_id", start.alias("start"), "n_tokens", "ids_crc32")
