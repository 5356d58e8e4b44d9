"""Near-duplicate documents by SimHash, linked through a Gray-order hierarchical index.

A document's fingerprint has one bit for each bit position that more than half the hashes of
its word shingles have set. Fingerprints with at most ``distance`` differing bits are linked,
and the components of the links are the groups of near-duplicates.

The index is a tree of masked bit patterns. A node stands for fingerprints that agree on the
bits of its mask; the bits that an ancestor's mask has already are left out of it, so the
differences that a query shows against the nodes of a path add up, and a node where they exceed
the distance is left with all that lies below it.

* The upper nodes have fixed masks. The 64 bits are cut into ``cuts`` stretches, and a mask
  takes all but ``distance`` of them; two fingerprints that differ in ``distance`` bits agree on
  the bits of at least one mask. So every pair that is to be linked meets under an upper node of
  which both are members, and a query goes to the nodes that it agrees with alone. The number of
  stretches follows from the number of fingerprints, so that nodes stay small.
* Under an upper node its fingerprints are sorted by Gray rank, where neighbours differ in few
  bits. ``FAN`` neighbours make a leaf and ``FAN`` nodes the next node, whose mask is the bits
  that they share.

The members of an upper node search its tree. Each task keeps the groups of what it has linked
so far, passes over nodes that lie in the query's own group whole, and returns at most one link
per member, to its group's first. An upper node of more than ``NODE`` members (many near copies
of one text) is cut into chunks, and every two chunks of it meet in one task, whichever it is.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm.components import components
from llm.rows import ROW, numbered, on_workers, parts_of, smaller, spans, stored, united, unwrapped, wrapped
from llm.text import shingles, texts_of

BITS = 64
FAN = 32
NODE = 4096
EXPECTED = 2048  # fingerprints that an upper node may be expected to have
AT_ONCE = 1 << 15  # pairs of a query and a node that are compared in one step
HASHES_AT_ONCE = 1 << 16


def fingerprint(text: bytes, width: int = 4, seed: int = 42) -> int:
    """SimHash of a text's word shingles, repeats included; 0 for a text without words."""
    found = shingles(text.lower().split(), width)
    ones = np.zeros(BITS, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(found), HASHES_AT_ONCE):
        hashes = np.array([digest(x, seed) for x in found[at : at + HASHES_AT_ONCE]], dtype=">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(found))
    return int(bits.view(">u8")[0])


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each bit pattern in the Gray code."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


def _fingerprints(text_col: str, width: int, seed: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in smaller(batches, text_col):
            found = np.array([fingerprint(t, width, seed) for t in texts_of(batch.column(text_col))], dtype=np.uint64)
            names = [n for n in batch.schema.names if n != text_col]
            columns = [batch.column(n) for n in names] + [pa.array(found.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, [*names, "fp"])

    return of


def with_fingerprints(rows: DataFrame, text_col: str = "text", width: int = 4, seed: int = 42) -> DataFrame:
    """``rows`` without the text and with ``fp``, the fingerprint as a signed 64-bit number."""
    on_workers(rows.sparkSession)
    fields = [f for f in rows.schema.fields if f.name != text_col] + [T.StructField("fp", T.LongType())]
    return rows.mapInArrow(_fingerprints(text_col, width, seed), T.StructType(fields))


def upper_masks(count: int, distance: int) -> list[int]:
    """Masks of the upper nodes for so many fingerprints."""
    cuts = distance + 1
    while cuts < 2 * distance + 2 and count / 2 ** (BITS * (cuts - distance) / cuts) > EXPECTED:
        cuts += 1
    edges = [round(k * BITS / cuts) for k in range(cuts + 1)]
    stretches = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in itertools.combinations(stretches, cuts - distance)]


class Tree:
    """Trees of several upper nodes at once: level 0 has leaves of FAN fingerprints."""

    def __init__(self, prints: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        """``prints`` in Gray order within each upper node, which begins at ``starts``."""
        many = -(-sizes // FAN)
        first = spans(np.zeros(len(sizes), np.int64), many) * FAN + np.repeat(starts, many)
        last = np.minimum(first + FAN, np.repeat(starts + sizes, many))
        self.levels = []
        agree = ~np.bitwise_or.reduceat(prints ^ np.repeat(prints[first], last - first), first)
        pattern = prints[first]
        below = None
        while True:
            level = {"first": first, "last": last, "mask": agree, "pattern": pattern, "below": below}
            self.levels.append(level)
            if (many <= 1).all():
                break
            up = -(-many // FAN)
            begin = np.cumsum(many) - many
            child = spans(np.zeros(len(many), np.int64), up) * FAN + np.repeat(begin, up)
            stop = np.minimum(child + FAN, np.repeat(begin + many, up))
            apart = pattern ^ np.repeat(pattern[child], stop - child)
            shared = np.bitwise_and.reduceat(agree, child) & ~np.bitwise_or.reduceat(apart, child)
            # A child's mask keeps what the parent's has not: differences add up along a path.
            level["mask"] = agree & ~np.repeat(shared, stop - child)
            first, last, agree, pattern = first[child], last[stop - 1], shared, pattern[child]
            below, many = (child, stop - child), up


def _group_links(prints: np.ndarray, tree: Tree, roots: np.ndarray, chunk: np.ndarray | None, distance: int) -> np.ndarray:
    """For each fingerprint the first member of its group, by links of at most ``distance``.

    ``roots``: each fingerprint's tree. ``chunk``: if given, only pairs of different chunks need
    to be found.
    """
    group = np.arange(len(prints))
    top = len(tree.levels) - 1
    work = [(top, np.arange(len(prints)), roots, np.zeros(len(prints), dtype=np.uint8))]
    while work:
        level, query, node, apart = work.pop()
        if len(query) > AT_ONCE:
            for a in range(0, len(query), AT_ONCE):
                b = a + AT_ONCE
                work.append((level, query[a:b], node[a:b], apart[a:b]))
            continue
        at = tree.levels[level]
        apart = apart + np.bitwise_count((prints[query] ^ at["pattern"][node]) & at["mask"][node])
        near = (apart <= distance) & (at["last"][node] > query + 1)
        query, node, apart = query[near], node[near], apart[near]
        if not len(query):
            continue
        low = np.minimum.reduceat(group, at["first"])
        high = np.maximum.reduceat(group, at["first"])
        other = (low[node] != group[query]) | (high[node] != group[query])
        query, node, apart = query[other], node[other], apart[other]
        if level:
            child, many = at["below"]
            copies = many[node]
            work.append((level - 1, np.repeat(query, copies), spans(child[node], copies), np.repeat(apart, copies)))
            continue
        copies = at["last"][node] - at["first"][node]
        member = spans(at["first"][node], copies)
        query = np.repeat(query, copies)
        hit = (member > query) & (np.bitwise_count(prints[query] ^ prints[member]) <= distance)
        if chunk is not None:
            hit &= (chunk[query] != chunk[member]) | (chunk[query] == 0)
        group = united(group, query[hit], member[hit])
    return group


def _linked(distance: int):
    """Links of the upper nodes of a partition, which arrive sorted by node and Gray rank."""

    def links(node: np.ndarray, fp: np.ndarray, chunk: np.ndarray) -> pa.RecordBatch:
        begin = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
        sizes = np.diff(np.concatenate([begin, [len(node)]]))
        begin, kept = begin[sizes > 1], np.repeat(sizes > 1, sizes)
        fp, chunk, sizes = fp[kept].view(np.uint64), chunk[kept], sizes[sizes > 1]
        if not len(fp):
            return _links(fp, fp)
        starts = np.cumsum(sizes) - sizes
        # Several chunks: pairs inside one are found where that chunk meets itself.
        group = _group_links(fp, Tree(fp, starts, sizes), np.repeat(np.arange(len(sizes)), sizes), chunk, distance)
        own = np.flatnonzero(group != np.arange(len(group)))
        return _links(fp[own], fp[group[own]])

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for batch in batches:
            if batch.num_rows:
                held.append([batch.column(n).to_numpy() for n in ("node", "fp", "chunk")])
            if sum(len(h[0]) for h in held) >= 4 * NODE:
                node, fp, chunk = (np.concatenate(x) for x in zip(*held))
                # The last node may go on in the next batch.
                before = np.flatnonzero(node != node[-1])
                done = int(before[-1]) + 1 if len(before) else 0
                if done:
                    yield links(node[:done], fp[:done], chunk[:done])
                held = [[node[done:], fp[done:], chunk[done:]]]
        if held:
            yield links(*(np.concatenate(x) for x in zip(*held)))

    return of


def _links(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])


def _members(masks: list[int]):
    """Each fingerprint once for every upper node that it is a member of, with its Gray rank."""
    patterns = np.array(masks, dtype=np.uint64)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            rank = gray_rank(fp) ^ np.uint64(1 << 63)  # signed order is Gray order
            upper = np.repeat(np.arange(len(patterns)), len(fp))
            columns = [
                pa.array(upper.astype(np.int32)), pa.array((fp[None, :] & patterns[:, None]).ravel().view(np.int64)),
                pa.array(np.tile(fp, len(patterns)).view(np.int64)), pa.array(np.tile(rank, len(patterns)).view(np.int64)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["mask", "pattern", "fp", "rank"])

    return of


def near_links(prints: DataFrame, distance: int = 4) -> DataFrame:
    """Links (a, b) between fingerprints of at most ``distance`` differing bits, enough to
    connect whatever a chain of such pairs connects. ``prints`` (fp) is stored and distinct."""
    spark = prints.sparkSession
    masks = upper_masks(prints.count(), distance)
    members = prints.select("fp").mapInArrow(_members(masks), "mask int, pattern long, fp long, rank long")
    # Upper nodes above NODE members, of which there are few: how many chunks each is cut into.
    large = members.groupBy("mask", "pattern").agg(F.count("*").alias("n")).where(F.col("n") > NODE // 2)
    large = stored(large.select("mask", "pattern", F.ceil(F.col("n") / (NODE // 2)).alias("chunks")), "large-nodes")
    placed = members.join(large, ["mask", "pattern"], "left")
    chunks = F.coalesce("chunks", F.lit(1))
    mine = F.pmod(F.xxhash64("fp"), chunks)
    # A chunk meets every chunk once, itself included: pair (i, j) with i <= j.
    other = F.explode(F.when(chunks > 1, F.sequence(F.lit(0), chunks - 1)).otherwise(F.array(F.lit(0).cast("long"))))
    met = placed.withColumn("mine", mine).withColumn("other", other)
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    # Within a pair of different chunks only pairs across count; chunk 0 marks "all count".
    side = F.when(low == high, 0).otherwise(F.when(F.col("mine") == low, 1).otherwise(2))
    met = met.select(F.xxhash64("mask", "pattern", low, high).alias("node"), "mask", "pattern", low.alias("low"), high.alias("high"), "fp", "rank", side.cast("int").alias("chunk"))
    parts = max(parts_of(spark), 1)
    dealt = met.repartition(parts, "node").sortWithinPartitions("node", "mask", "pattern", "low", "high", "rank")
    return dealt.select("node", "fp", "chunk").mapInArrow(_linked(distance), "a long, b long")


def near_groups(rows: DataFrame, id_col: str = "doc_id", distance: int = 4) -> DataFrame:
    """(fp, group, component_id) of every fingerprint of ``rows``: a name of its group, and the
    smallest id of the group's rows (null if none has one)."""
    prints = stored(rows.groupBy("fp").agg(F.min(id_col).alias("least_id")), "fingerprints")
    found = components(near_links(prints, distance)).withColumnRenamed("a", "fp")
    named = prints.join(found, "fp", "left").select("fp", "least_id", F.coalesce("root", "fp").alias("group"))
    named = stored(named, "near-groups")
    least = named.groupBy("group").agg(F.min("least_id").alias("component_id"))
    return stored(named.join(least, "group").select("fp", "group", "component_id"), "components")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 4) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id.

    A null text is empty, and texts without words share the fingerprint zero, which is linked
    like any other. Null ids are never a component's id unless it has no other. Repeated rows
    are rows like any other. Texts of any length are taken whole.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = stored(with_fingerprints(own), "document-fingerprints")
    groups = near_groups(rows, "doc_id", distance)
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(groups, "fp").select("doc_id", hexed.alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = 4) -> DataFrame:
    """One document of each group, with the columns of ``docs``: that of the smallest id, null
    ids last, and of rows that repeat it the first stored."""
    own = numbered(wrapped(docs, text_col), "numbered-documents")
    slim = own.select(F.col(ROW).alias("row"), F.col(f"doc.`{id_col}`").alias("id"), "text")
    rows = stored(with_fingerprints(slim), "document-fingerprints")
    groups = near_groups(rows, "id", distance)
    met = rows.join(groups, "fp").where(F.col("id").eqNullSafe(F.col("component_id")))
    chosen = stored(met.groupBy("group").agg(F.min("row").alias(ROW)).select(ROW), "kept-rows")
    return unwrapped(own.join(chosen, ROW, "left_semi"), docs, text_col)
