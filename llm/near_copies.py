"""Near copies by exact Jaccard similarity of word shingles.

A text is the set of its word shingles, lower-cased. Texts with a similarity of at least
``share`` are linked, and the components of the links are the groups of near copies. Texts with
one set are one from here on. No pair is linked before its whole sets are compared.

1. *Proposals.* SimHash fingerprints of the sets go through the Gray-order index of
   :mod:`llm.simhash`, which proposes the close copies. MinHash proposes those farther apart:
   ``BANDS`` keys a text, each of ``ROWS`` smallest hashes; of two texts with similarity s a key
   is shared with chance s ** ROWS, so at 0.8 all 32 are missed once in 20 million pairs. Here
   every member of a key is proposed with the key's first.
2. *Confirmation.* The sets of what is proposed with one text meet that text's set in a task (in
   several, if they are many) and are compared there; what leaves it is links.
3. *The rest.* Where these links leave several groups under a key, its members' sketches (one
   byte of each smallest hash) are compared in blocks: a member is marked under the key if a
   member of another group may have the similarity, by a limit that a pair at it misses by
   ``FAR`` standard deviations, and if the two share no earlier key. Marked members' sets meet
   under their keys and all are compared, by counting along the lists of texts that hold each
   shingle. A task returns at most one link per member, to its group's first.

The documents lie in buckets by row, so texts move once, when they are stored. A key with many
members is cut into chunks that meet in pairs (:mod:`llm.sign_hashing`), so
no task holds a large group; pairs of texts are never rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm import simhash
from llm.components import components
from llm.repeats import bucketed
from llm.rows import ROW, on_workers, parts_of, runs, smaller, spans, stored, unwrapped, wrapped
from llm.sign_hashing import BUCKET, _by_node, _bytes, _meeting, _sides
from llm.text import texts_of

BANDS, ROWS = 32, 4
FAR = 6.0
DISTANCE = 4  # bits in which fingerprints of close copies differ
HUB = 2048  # sets that one task compares with a hub's
AT_ONCE = 1 << 20  # bytes of text
HASHES_AT_ONCE = 1 << 14
ODD = np.uint64(0x9E3779B97F4A7C15)
_drawn = np.random.default_rng(20).integers(0, 2**63, (2, BANDS * ROWS), dtype=np.uint64)
FLIPS, FACTORS = _drawn[0] * np.uint64(2), _drawn[1] * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted 64-bit hashes of the distinct shingles; fewer words than ``width`` are one shingle."""
    words = [t.lower().split() for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    flat = pa.array([w for own in words for w in own], pa.binary()).dictionary_encode()
    known = np.array([xxhash.xxh64_intdigest(w) for w in flat.dictionary.to_pylist()], dtype=np.uint64)
    values = known[flat.indices.to_numpy(zero_copy_only=False)]
    each = np.where(counts > 0, np.maximum(counts - width + 1, 1), 0)
    begin = np.cumsum(counts) - counts
    at, stop = spans(begin, each), np.repeat(begin + counts, each)
    found = np.zeros(len(at), dtype=np.uint64)
    for k in range(width):
        inside = at + k < stop
        found[inside] = _mixed((found[inside] + values[at[inside] + k]) * ODD)
    ends = np.cumsum(each)
    return [np.unique(found[a:b]) for a, b in zip(ends - each, ends)]


def sketches(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, a byte of each smallest hash, SimHash fingerprint) of non-empty sets, a row each."""
    sizes = np.array([len(s) for s in sets])
    starts, flat = np.cumsum(sizes) - sizes, np.concatenate(sets)
    keys = np.zeros((len(sets), BANDS), dtype=np.uint64)
    low = np.zeros((len(sets), BANDS * ROWS), dtype=np.uint8)
    for k, (flip, factor) in enumerate(zip(FLIPS, FACTORS)):
        band = k // ROWS
        least = np.minimum.reduceat(_mixed((flat ^ flip) * factor), starts)
        low[:, k] = least.astype(np.uint8)
        keys[:, band] = _mixed((keys[:, band] + least) * ODD + np.uint64(band))
    prints = np.zeros(len(sets), dtype=np.uint64)
    for k, own in enumerate(sets):
        ones = np.zeros(64, dtype=np.int64)
        for at in range(0, len(own), HASHES_AT_ONCE):
            bits = np.unpackbits(own[at : at + HASHES_AT_ONCE].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            ones += bits.sum(axis=0, dtype=np.int64)
        prints[k] = np.packbits(2 * ones > len(own)).view(">u8")[0]
    return keys, low, prints


def _sketched(width: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in smaller(batches, "text", AT_ONCE):
            sets = shingle_sets(texts_of(batch.column("text")), width)
            full = np.flatnonzero([len(s) > 0 for s in sets])
            keys, low, prints = np.zeros((len(sets), BANDS), np.uint64), np.zeros((len(sets), BANDS * ROWS), np.uint8), np.zeros(len(sets), np.uint64)
            if len(full):
                keys[full], low[full], prints[full] = sketches([sets[i] for i in full])
            columns = [
                batch.column("row"), batch.column("id"),
                pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                pa.array(np.array([len(s) for s in sets], dtype=np.int64)),
                pa.array([k.tobytes() if len(s) else None for k, s in zip(keys, sets)], pa.binary()),
                pa.array([k.tobytes() if len(s) else None for k, s in zip(low, sets)], pa.binary()),
                pa.array(prints.view(np.int64), mask=np.array([not len(s) for s in sets], dtype=bool)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["row", "id", "whole", "n", "keys", "low", "fp"])

    return of


def _as_sets(width: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in smaller(batches, "text", AT_ONCE):
            sets = shingle_sets(texts_of(batch.column("text")), width)
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([s.tobytes() for s in sets], pa.binary())], ["row", "held"])

    return of


def _in_bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each set once for every band, with its key."""
    for batch in batches:
        n = batch.num_rows
        keys = _bytes(batch.column("keys")).view(np.int64) if n else np.zeros((0, BANDS), np.int64)
        columns = [pa.array(np.tile(np.arange(BANDS, dtype=np.int32), n)), pa.array(keys.ravel()), pa.array(np.zeros(n * BANDS, np.int32)), pa.array(np.repeat(batch.column("row").to_numpy(), BANDS))]
        yield pa.RecordBatch.from_arrays(columns, [*BUCKET, "row"])


def _similar(share: tuple[int, int], common: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether ``common`` elements of two sets with ``sizes`` together are enough."""
    return sum(share) * common >= share[0] * sizes


def _with_hubs(share: tuple[int, int]):
    """Links of sets with the hub's, which comes first of those with its number and salt."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, hub = None, np.zeros(0, np.uint64)
        for key, part in runs(batches, ["a", "salt"]):
            held = part.column("held").to_pylist()
            row = part.column("row").to_numpy()
            if key != name:
                name, hub = key, np.frombuffer(held[0], np.uint64)
            sets = [np.frombuffer(h, np.uint64) for h in held]
            sizes = np.array([len(s) for s in sets])
            flat = np.concatenate(sets)
            at = np.minimum(np.searchsorted(hub, flat), len(hub) - 1)
            same = np.concatenate([[0], np.cumsum(hub[at] == flat)])
            ends = np.cumsum(sizes)
            common = same[ends] - same[ends - sizes]
            near = _similar(share, common, sizes + len(hub)) & (row != key[0])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(int(near.sum()), key[0])), pa.array(row[near])], ["a", "b"])

    return of


def _confirmed(pairs: DataFrame, held: DataFrame, share: tuple[int, int]) -> DataFrame:
    """Those of the stored, distinct ``pairs`` (a, b) whose sets have the similarity."""
    salts = F.ceil(F.count("*") / HUB).alias("salts")
    hubs = stored(pairs.groupBy("a").agg(salts), "hubs")
    deal = F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt")
    members = pairs.join(hubs, "a").select("a", deal, F.col("b").alias("row"), F.lit(1).alias("kind"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt")
    first = hubs.select("a", every, F.col("a").alias("row"), F.lit(0).alias("kind"))
    met = first.unionByName(members).join(held, "row")
    dealt = met.repartition(parts_of(pairs.sparkSession), "a", "salt").sortWithinPartitions("a", "salt", "kind", "row")
    return dealt.select("a", "salt", "row", "held").mapInArrow(_with_hubs(share), "a long, b long")


def sketch_limit(share: tuple[int, int]) -> int:
    """Bytes of a sketch that a pair with the similarity has alike, but for ``FAR`` deviations."""
    alike = share[0] / share[1] + (1 - share[0] / share[1]) / 256
    many = BANDS * ROWS
    return max(1, math.floor(many * alike - FAR * math.sqrt(many * alike * (1 - alike))))


def _marked(limit: int):
    def compare(node: pa.Table) -> pa.RecordBatch | None:
        band = int(node.column("table")[0].as_py())
        low = np.ascontiguousarray(_bytes(node.column("sketch").combine_chunks()).T)
        keys = _bytes(node.column("keys").combine_chunks()).view(np.int64)[:, :band]
        group = node.column("group").to_numpy()
        marked = np.zeros(len(group), dtype=bool)
        for a, b in _sides(node.column("chunk").to_numpy()):
            for at in range(0, len(a), 128):
                own = a[at : at + 128]
                alike = np.zeros((len(own), len(b)), dtype=np.uint8)
                for line in low:
                    alike += line[own][:, None] == line[b][None, :]
                i, j = np.nonzero((alike >= limit) & (group[own][:, None] != group[b][None, :]))
                i, j = own[i], b[j]
                for k in range(0, len(i), 1 << 16):
                    p, q = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
                    new = ~(keys[p] == keys[q]).any(axis=1)
                    marked[p[new]] = marked[q[new]] = True
        if not marked.any():
            return None
        own = pa.array(np.flatnonzero(marked))
        return pa.RecordBatch.from_arrays([node.column(c).combine_chunks().take(own) for c in (*BUCKET, "row")], [*BUCKET, "row"])

    return _by_node(compare)


def groups_of(sets: list[np.ndarray], share: tuple[int, int]) -> np.ndarray:
    """The first set of each set's group, by exact similarity of all pairs."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, values = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(values, kind="stable")
    owner, values_sorted = owner[order], values[order]
    first = np.searchsorted(values_sorted, np.arange(values_sorted[-1] + 2))
    ends = np.cumsum(sizes)
    group = np.arange(len(sets))
    for i in range(len(sets)):
        own = values[ends[i] - sizes[i] : ends[i]]
        common = np.bincount(owner[spans(first[own], first[own + 1] - first[own])], minlength=len(sets))
        near = np.flatnonzero(_similar(share, common, sizes + sizes[i]))
        found = np.unique(group[near])
        if len(found) > 1:
            group[np.isin(group, found)] = found[0]
    return group


def _united_sets(share: tuple[int, int]):
    def compare(node: pa.Table) -> pa.RecordBatch | None:
        row = node.column("row").to_numpy()
        group = groups_of([np.frombuffer(h, np.uint64) for h in node.column("held").to_pylist()], share)
        own = np.flatnonzero(group != np.arange(len(group)))
        if not len(own):
            return None
        return pa.RecordBatch.from_arrays([pa.array(row[own]), pa.array(row[group[own]])], ["a", "b"])

    return _by_node(compare)


MEMBER = "table int, key long, size int, row long"


def near_links(sets: DataFrame, texts: DataFrame, width: int = 5, share: tuple[int, int] = (4, 5)) -> DataFrame:
    """Links (a, b) that connect whatever a chain of texts with the similarity connects.

    ``sets`` (row, n, keys, low, fp) has one row per distinct, non-empty set and is stored;
    ``texts`` (numbered ``ROW``, text) has at least these.
    """
    parts = max(parts_of(sets.sparkSession), 1)
    members = sets.select("row", "keys").mapInArrow(_in_bands, MEMBER)
    shared = members.groupBy(*BUCKET).agg(F.min("row").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    met = stored(members.join(shared, BUCKET), "shared-keys")
    prints = stored(sets.groupBy("fp").agg(F.min("row").alias("one")), "fingerprints")
    close = simhash.near_links(prints, DISTANCE).distinct()
    close = close.join(prints.select(F.col("fp").alias("a"), F.col("one").alias("x")), "a")
    close = close.join(prints.select(F.col("fp").alias("b"), F.col("one").alias("y")), "b")
    alike = sets.select("fp", "row").join(prints, "fp").where("row != one").select(F.col("one").alias("x"), F.col("row").alias("y"))
    proposed = close.select("x", "y").unionByName(alike).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    proposed = proposed.unionByName(met.where("row != first").select(F.col("first").alias("a"), F.col("row").alias("b")))
    pairs = stored(proposed.distinct(), "pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("row")).unionByName(met.select("row")).distinct()
    chosen = texts.join(wanted, texts[ROW] == wanted["row"], "left_semi").select(F.col(ROW).alias("row"), "text")
    held = stored(chosen.mapInArrow(_as_sets(width), "row long, held binary"), "shingle-sets")
    links = stored(_confirmed(pairs, held, share), "near-links")

    groups = components(links)
    placed = met.select(*BUCKET, "row").join(groups.withColumnRenamed("a", "row"), "row", "left")
    placed = stored(placed.withColumn("group", F.coalesce("root", "row")).drop("root"), "placed-keys")
    several = placed.groupBy(*BUCKET).agg(F.min("group").alias("low_group"), F.max("group").alias("high_group"))
    several = stored(several.where("low_group != high_group").select(*BUCKET), "open-keys")
    open_rows = placed.join(several, BUCKET)
    carried = sets.select("row", "keys", F.col("low").alias("sketch")).join(open_rows.select("row", "group").distinct(), "row")
    marked = _meeting(open_rows.select(*BUCKET, "row"), parts, stored(carried, "open-sketches"))
    marked = stored(marked.mapInArrow(_marked(sketch_limit(share)), MEMBER).distinct(), "marked")
    rest = _meeting(marked, parts, held).mapInArrow(_united_sets(share), "a long, b long")
    return links.unionByName(rest)


def keep_one(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, share: tuple[int, int] = (4, 5)
) -> DataFrame:
    """One document of each group, with the columns of ``docs``: that of the smallest id, null
    ids last, and of rows that repeat it the first stored.

    ``share`` is the least similarity as a fraction. Texts without words are one group; texts of
    fewer words than ``width`` are one shingle. Texts of any length are taken whole, and an
    empty table gives no rows.
    """
    on_workers(docs.sparkSession)
    own = bucketed(wrapped(docs, text_col))
    slim = own.select(F.col(ROW).alias("row"), F.col(f"doc.`{id_col}`").alias("id"), "text")
    kind = slim.schema["id"].dataType.simpleString()
    schema = f"row long, id {kind}, whole binary, n long, keys binary, low binary, fp long"
    rows = stored(slim.mapInArrow(_sketched(width), schema), "sketches")
    sets = stored(rows.groupBy("whole").agg(F.min("row").alias("row"), F.min("id").alias("least_id")), "distinct-sets")
    kept = stored(rows.drop("id", "whole").join(sets.select("row"), "row", "left_semi").where("n > 0"), "set-sketches")
    links = near_links(kept, own.select(ROW, "text"), width, share)
    named = sets.join(components(links), F.col("row") == F.col("a"), "left")
    named = stored(named.select("whole", "least_id", F.coalesce("root", "row").alias("group")), "near-groups")
    least = named.groupBy("group").agg(F.min("least_id").alias("component_id"))
    met = rows.select("row", "id", "whole").join(named, "whole").join(least, "group")
    met = met.where(F.col("id").eqNullSafe(F.col("component_id")))
    chosen = stored(met.groupBy("group").agg(F.min("row").alias(ROW)).select(ROW), "kept-rows")
    return unwrapped(own.join(chosen.withColumnRenamed(ROW, "row"), F.col(ROW) == F.col("row"), "left_semi"), docs, text_col)
