"""Near-duplicate vectors by cosine: random-hyperplane sign hashing in several tables.

Which sides of random hyperplanes a vector lies on are its signs. A table takes ``bits`` of them
as its key, and vectors with one key in one table meet. Two vectors at the least cosine agree on a
key with chance (1 - angle / pi) ** bits; there are so many tables that such a pair misses all of
them with a chance of at most ``MISS``, and closer pairs miss less. ``bits`` grows with the number
of vectors, so that strangers stay few under a key.

1. Rows with one vector are one vector from here on, with its number of rows.
2. *Sketches meet.* Under each key of each table the first ``SKETCH`` signs of its vectors are
   compared. Vectors whose sketches differ by no more than a pair at the least cosine ever does
   (``FAR`` standard deviations) are marked there; most vectors of most tables have no such partner
   and their components are never sent anywhere.
3. *Vectors meet.* Under a key the marked ones are compared by exact cosine. A pair counts in the
   first table that it shares a key of. A task sums what each vector is linked to, unites what is
   linked and returns one row per vector with that sum and one link to its group's first.
4. Sums are added up per vector, and links become components by stored star rounds.

A key with more than ``NODE`` vectors is cut into chunks, and every two chunks meet in one task,
whichever it is, so that no group is too large for one; the comparisons themselves grow with the
square of a group in which everything is near to everything, since links are to be counted.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.components import components
from llm.rows import ROW, on_workers, parts_of, runs, stored, united

MISS = 1e-5
SKETCH = 256
FAR = 8.0
NODE = 4096  # vectors of one key that meet in one task
EXPECTED = 96  # vectors that a key may be expected to have
AT_ONCE = 1024  # vectors compared with others in one step
SEED = 12


def tables_for(count: int, cosine: float) -> tuple[int, int]:
    """(bits of a key, tables) for so many vectors."""
    agree = 1 - math.acos(cosine) / math.pi
    bits = min(32, max(4, math.ceil(math.log2(max(count, 1) / EXPECTED)) if count > EXPECTED else 4))
    met = agree**bits
    return bits, 1 if met >= 1 else math.ceil(math.log(MISS) / math.log1p(-met))


def sketch_limit(cosine: float) -> int:
    """Signs of a sketch in which a pair at the least cosine may differ."""
    differ = math.acos(cosine) / math.pi
    return min(SKETCH, math.ceil(SKETCH * differ + FAR * math.sqrt(SKETCH * differ * (1 - differ)) + 1))


def signs(vectors: np.ndarray, count: int) -> np.ndarray:
    """Sides of ``count`` hyperplanes for each vector, as bits in bytes."""
    planes = np.random.default_rng(SEED).standard_normal((count, vectors.shape[1]))
    return np.packbits(vectors @ planes.T > 0, axis=1)


def keys_of(packed: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """The key of each vector in each table."""
    flat = np.unpackbits(packed, axis=1, count=bits * tables).reshape(len(packed), tables, bits)
    return flat @ (1 << np.arange(bits, dtype=np.int64))


def usable(column: pa.Array) -> np.ndarray:
    """Lists that are not null, hold only finite numbers, and not only zeros."""
    return np.array([bool(v) and None not in v and bool(np.isfinite(v).all()) and bool(np.any(v)) for v in column.to_pylist()], dtype=bool)


def by_length(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix in double precision) for each length among usable lists."""
    lengths = np.fromiter((len(v) if v is not None else 0 for v in column.to_pylist()), np.int64, len(column))
    for d in np.unique(lengths).tolist():
        own = np.flatnonzero(lengths == d)
        flat = column.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False)
        yield own, flat.astype(np.float64).reshape(len(own), d)


def _signed(count: int):
    width = -(-count // 8)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            good = np.flatnonzero(usable(vectors))
            whole = np.zeros(len(vectors), dtype="V16")
            packed = np.zeros((len(vectors), width), dtype=np.uint8)
            size = np.zeros(len(vectors), dtype=np.int32)
            for own, x in by_length(vectors.take(pa.array(good))):
                at = good[own]
                packed[at] = signs(x, count)
                size[at] = x.shape[1]
                x += 0.0  # -0.0 is 0.0
                whole[at] = [np.void(xxhash.xxh3_128_digest(v.tobytes())) for v in x]
            columns = [
                batch.column(ROW), batch.column("id"), pa.array(size),
                pa.array([w.tobytes() if s else None for w, s in zip(whole, size.tolist())], pa.binary()),
                pa.array([p.tobytes() for p in packed], pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [ROW, "id", "size", "whole", "signs"])

    return of


def _bytes(column: pa.Array) -> np.ndarray:
    """Binary values of equal length as rows of bytes."""
    joined = b"".join(column.to_pylist())
    return np.frombuffer(joined, dtype=np.uint8).reshape(len(column), -1)


def _in_tables(bits: int, tables: int):
    """Each vector once for every table, with its key and sketch."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(at, AT_ONCE)
                packed, n = _bytes(batch.column("signs")), batch.num_rows
                keys = keys_of(packed, bits, tables)
                sketch = [s.tobytes() for s in packed[:, : SKETCH // 8]]
                columns = [
                    pa.array(np.tile(np.arange(tables, dtype=np.int32), n)), pa.array(keys.ravel()),
                    batch.column("size").take(pa.array(np.repeat(np.arange(n), tables))),
                    batch.column("row").take(pa.array(np.repeat(np.arange(n), tables))),
                    pa.array(sketch, pa.binary()).take(pa.array(np.repeat(np.arange(n), tables))),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["table", "key", "size", "row", "sketch"])

    return of


BUCKET = ["table", "key", "size"]


def _meeting(members: DataFrame, parts: int, carried: DataFrame | None = None) -> DataFrame:
    """Members of a key side by side: those of a large one in chunks, each pair of chunks once.

    ``chunk`` is 0 where all pairs of a node count, else 1 or 2, and pairs across count. Keys
    with a single member are left out. ``carried`` has further columns for each row.
    """
    many = members.groupBy(*BUCKET).agg(F.count("*").alias("n")).where("n > 1")
    placed = members.join(stored(many, "shared-keys"), BUCKET)
    placed = placed if carried is None else placed.join(carried, "row")
    chunks = F.when(F.col("n") > NODE, F.ceil(F.col("n") / (NODE // 2))).otherwise(1)
    placed = placed.withColumn("chunks", chunks).withColumn("mine", F.pmod(F.xxhash64("row"), F.col("chunks")))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    low, high = F.least("mine", "other"), F.greatest("mine", "other")
    side = F.when(low == high, 0).otherwise(F.when(F.col("mine") == low, 1).otherwise(2)).cast("int")
    met = met.withColumn("low", low).withColumn("high", high).withColumn("chunk", side)
    met = met.withColumn("node", F.xxhash64(*BUCKET, "low", "high")).drop("chunks", "mine", "other", "n")
    return met.repartition(parts, "node").sortWithinPartitions("node", *BUCKET, "low", "high", "row")


def _by_node(compare: Callable[[pa.Table], pa.RecordBatch | None]):
    """``compare`` for each node of sorted batches; a node may go on in the next batch."""
    order = ["node", *BUCKET, "low", "high"]

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, name = [], None
        for key, part in runs(batches, order):
            if key != name and held:
                if sum(h.num_rows for h in held) > 1 and (out := compare(pa.Table.from_batches(held))) is not None:
                    yield out
                held = []
            name = key
            held.append(part)
        if sum(h.num_rows for h in held) > 1 and (out := compare(pa.Table.from_batches(held))) is not None:
            yield out

    return of


def _sides(chunk: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of places to compare: each pair once, apart from places with themselves."""
    if chunk[0] == 0:
        every = np.arange(len(chunk))
        for at in range(0, len(every), AT_ONCE):
            yield every[at : at + AT_ONCE], every[at:]
    else:
        first, second = np.flatnonzero(chunk == 1), np.flatnonzero(chunk == 2)
        for at in range(0, len(first), AT_ONCE):
            yield first[at : at + AT_ONCE], second


def _marked(limit: int):
    def compare(node: pa.Table) -> pa.RecordBatch | None:
        sketch = _bytes(node.column("sketch").combine_chunks()).view(np.uint64)
        near = np.zeros(len(sketch), dtype=bool)
        for a, b in _sides(node.column("chunk").to_numpy()):
            differ = np.zeros((len(a), len(b)), dtype=np.uint16)
            for k in range(sketch.shape[1]):
                differ += np.bitwise_count(sketch[a, k][:, None] ^ sketch[b, k][None, :])
            hit = (differ <= limit) & (a[:, None] != b[None, :])
            near[a] |= hit.any(axis=1)
            near[b] |= hit.any(axis=0)
        if not near.any():
            return None
        own = pa.array(np.flatnonzero(near))
        return pa.RecordBatch.from_arrays([node.column(c).combine_chunks().take(own) for c in (*BUCKET, "row")], [*BUCKET, "row"])

    return _by_node(compare)


def _linked(cosine: float, bits: int, tables: int):
    def compare(node: pa.Table) -> pa.RecordBatch | None:
        row, times = node.column("row").to_numpy(), node.column("times").to_numpy()
        x = node.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        x = x.reshape(len(row), -1)
        x = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
        x /= np.sqrt(np.einsum("nd,nd->n", x, x))[:, None]
        keys = keys_of(_bytes(node.column("signs").combine_chunks()), bits, tables)[:, : int(node.column("table")[0].as_py())]
        group, links = np.arange(len(row)), np.zeros(len(row), dtype=np.int64)
        for a, b in _sides(node.column("chunk").to_numpy()):
            i, j = np.nonzero(x[a] @ x[b].T >= cosine)
            i, j = a[i], b[j]
            once = (i < j) if node.column("chunk")[0].as_py() == 0 else i != j
            i, j = i[once], j[once]
            group = united(group, i, j)
            for at in range(0, len(i), 1 << 16):
                p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
                new = ~(keys[p] == keys[q]).any(axis=1)  # met in no table before
                links += np.bincount(p[new], times[q[new]], len(row)).astype(np.int64)
                links += np.bincount(q[new], times[p[new]], len(row)).astype(np.int64)
        some = np.flatnonzero((links > 0) | (group != np.arange(len(row))))
        if not len(some):
            return None
        return pa.RecordBatch.from_arrays([pa.array(row[some]), pa.array(links[some]), pa.array(row[group[some]])], ["row", "links", "first"])

    return _by_node(compare)


def near_vectors(table: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """One row per row of ``table``: vec_id, n_links (other rows linked directly), component_id
    (smallest id reachable by links), kept (the row has that id).

    Linked are rows found with a cosine of at least ``cosine``, 0 < cosine <= 1, in double
    precision. Vectors that are null, empty or zero, or hold null or non-finite components, are
    linked with nothing, and vectors of different lengths never with each other. Repeated rows
    are rows like any other. A null id is a component's id only if it has no other. Columns but
    these two are not read.
    """
    spark = table.sparkSession
    on_workers(spark)
    own = table.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").alias("vector"))
    own = stored(own.withColumn(ROW, F.monotonically_increasing_id()), "vectors")
    bits, tables = tables_for(own.count(), cosine)
    kind = own.schema["id"].dataType.simpleString()
    marks = stored(own.mapInArrow(_signed(max(SKETCH, bits * tables)), f"{ROW} long, id {kind}, size int, whole binary, signs binary"), "signs")
    # Rows with one vector have the same signs, which a minimum over binary values keeps.
    vectors = marks.where("whole IS NOT NULL").groupBy("size", "whole").agg(
        F.min(ROW).alias("row"), F.min("id").alias("least_id"), F.count("*").alias("times"), F.min("signs").alias("signs"))
    vectors = stored(vectors, "distinct-vectors")

    parts = max(parts_of(spark), 1)
    bucketed = vectors.select("row", "size", "signs").mapInArrow(_in_tables(bits, tables), "table int, key long, size int, row long, sketch binary")
    marked = _meeting(stored(bucketed, "tables"), parts).mapInArrow(_marked(sketch_limit(cosine)), "table int, key long, size int, row long")
    marked = stored(marked.distinct(), "marked")
    # Only vectors with a partner travel, once for each key they have one under.
    partners = marked.select("row").distinct()
    sent = vectors.join(partners, "row", "left_semi").select("row", "times", "signs")
    sent = stored(sent.join(own.select(F.col(ROW).alias("row"), "vector"), "row"), "vectors-with-partners")
    found = stored(_meeting(marked, parts, sent).mapInArrow(_linked(cosine, bits, tables), "row long, links long, first long"), "vector-links")

    links = found.groupBy("row").agg(F.sum("links").alias("links"))
    roots = components(found.select(F.col("row").alias("a"), F.col("first").alias("b")))
    named = vectors.join(roots, F.col("row") == F.col("a"), "left").withColumn("root", F.coalesce("root", "row"))
    named = stored(named.join(links, "row", "left").select("size", "whole", "least_id", "times", "root", F.coalesce("links", F.lit(0)).alias("links")), "placed-vectors")
    least = named.groupBy("root").agg(F.min("least_id").alias("component_id"))
    placed = named.join(least, "root").select("size", "whole", (F.col("links") + F.col("times") - 1).alias("n_links"), "component_id")
    out = marks.select("id", "size", "whole").join(placed, ["size", "whole"], "left")
    component = F.when(F.col("whole").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
