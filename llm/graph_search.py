"""Nearest neighbours by inner product: robust-pruned directed graphs, one per shard.

Distinct vectors are dealt by a hash into shards of about ``SHARD``. A shard's graph grows by
batches: a greedy beam search in the graph so far proposes neighbours for each new vector, and
robust pruning keeps an edge to the nearest candidate and drops those that this neighbour is
nearer to by the relaxation factor, and so on, which leaves near and diverse edges. Edges are
then added the other way round, and lists that grow too long are pruned anew. Vectors that no
path from the entry reaches become entries themselves. The graphs are a stored table.

Every query visits every shard of its length with a beam search; scores of what the beam holds
are computed anew in double precision from the original vectors, and the best of all shards are
the result. A shard's graph reaches a task once, before its queries, which then stream through;
only where more than ``BLOCK`` queries meet it does a second task get a copy.

Inner products become distances by one more coordinate, which gives all vectors the same length;
a query has 0 there. Rows with the same vector are one node. A node keeps the ``k`` + 1 smallest
ids, which is exact: ties go to smaller ids, so no result can hold more of its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from llm.rows import on_workers, parts_of, pieces_for, runs, stored

SHARD = 8192  # vectors of a graph, or fewer where that leaves tasks idle
LEAST = 2048
BLOCK = 1 << 17  # queries that one task sends through a graph
DEGREE = 40
BUILD_BEAM = 72
BEAM = 112
RELAX = 1.2
WIDTH = 4  # nodes that a search opens at once
FIRST = 512  # vectors that start a graph, all compared with each other
AT_ONCE = 256


class Graph:
    def __init__(self, vectors: np.ndarray):
        """``vectors`` of equal length (n, d), as 32-bit floats."""
        self.x = vectors
        self.edges = np.full((len(vectors), DEGREE), -1, dtype=np.int32)
        self.entries = np.zeros(0, dtype=np.int64)

    def build(self, seed: int = 0) -> Graph:
        n = len(self.x)
        order = np.random.default_rng(seed).permutation(n)
        first = order[:FIRST]
        centre = self.x.mean(axis=0)
        self.entries = first[[int(np.argmax(self.x[first] @ centre))]]
        own = np.tile(first, (len(first), 1))
        for at in range(0, len(first), AT_ONCE):
            self._connect(first[at : at + AT_ONCE], own[at : at + AT_ONCE])
        at = len(first)
        while at < n:
            batch = order[at : at + min(at, 4 * AT_ONCE)]
            at += len(batch)
            found = [self.search(self.x[batch[k : k + AT_ONCE]], BUILD_BEAM)[0] for k in range(0, len(batch), AT_ONCE)]
            self._connect(batch, np.concatenate(found))
        self._reach_all()
        return self

    def _connect(self, nodes: np.ndarray, candidates: np.ndarray) -> None:
        self._prune(nodes, candidates)
        source = np.repeat(nodes, DEGREE)
        target = self.edges[nodes].ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        begin = np.flatnonzero(np.concatenate([[True], target[1:] != target[:-1]])) if len(target) else target
        rank = np.arange(len(target)) - np.repeat(begin, np.diff(np.append(begin, len(target))))
        for turn in range(int(rank.max()) // DEGREE + 1 if len(rank) else 0):
            now = (rank >= turn * DEGREE) & (rank < (turn + 1) * DEGREE)
            own, place = np.unique(target[now], return_inverse=True)
            more = np.full((len(own), DEGREE), -1, dtype=np.int64)
            more[place, rank[now] - turn * DEGREE] = source[now]
            for k in range(0, len(own), AT_ONCE):
                part = own[k : k + AT_ONCE]
                self._prune(part, np.concatenate([self.edges[part].astype(np.int64), more[k : k + AT_ONCE]], axis=1))

    def _prune(self, nodes: np.ndarray, candidates: np.ndarray) -> None:
        """Robust pruning of each node's candidates (-1: none) to at most DEGREE edges."""
        for k in range(0, len(nodes), AT_ONCE):
            own, found = nodes[k : k + AT_ONCE], candidates[k : k + AT_ONCE]
            found = np.sort(np.where(found == own[:, None], -1, found), axis=1)
            found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
            x = self.x[found]
            square = float(self.x[0] @ self.x[0])
            near = 2 * (square - np.einsum("bcd,bd->bc", x, self.x[own]))
            near[found < 0] = np.inf
            order = np.argsort(near, axis=1)[:, : 2 * BUILD_BEAM]
            rows = np.arange(len(own))[:, None]
            found, near, x = found[rows, order], near[rows, order], x[rows, order]
            between = 2 * (square - np.matmul(x, x.transpose(0, 2, 1)))
            alive = np.isfinite(near)
            edges = np.full((len(own), DEGREE), -1, dtype=np.int32)
            for slot in range(DEGREE):
                best = np.argmax(alive, axis=1)
                some = alive[np.arange(len(own)), best]
                if not some.any():
                    break
                edges[some, slot] = found[some, best[some]]
                kept = between[np.arange(len(own)), best]
                alive &= ~((RELAX**2 * kept <= near) & some[:, None])
                alive[np.arange(len(own)), best] = False
            self.edges[own] = edges

    def _reach_all(self) -> None:
        seen = np.zeros(len(self.x), dtype=bool)
        front = self.entries
        while True:
            seen[front] = True
            ahead = np.unique(self.edges[front])
            front = ahead[(ahead >= 0) & ~seen[ahead]]
            if not len(front):
                left = np.flatnonzero(~seen)
                if not len(left):
                    return
                front = left[:1].astype(np.int64)
                self.entries = np.concatenate([self.entries, front])

    def search(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Nodes of the largest products that a beam search holds (-1: none), best first."""
        many = len(queries)
        rows = np.arange(many)[:, None]
        seen = np.zeros((many, len(self.x)), dtype=bool)
        nodes = np.tile(self.entries, (many, 1))
        seen[:, self.entries] = True
        score = queries @ self.x[self.entries].T
        open_ = np.ones(nodes.shape, dtype=bool)
        while True:
            order = np.argsort(-score, axis=1)[:, :beam]
            nodes, score, open_ = nodes[rows, order], score[rows, order], open_[rows, order]
            turn = np.cumsum(open_, axis=1)
            chosen = open_ & (turn <= WIDTH)
            if not chosen.any():
                return nodes, score
            width = int(chosen.sum(axis=1).max())
            pick = np.argsort(~chosen, axis=1, kind="stable")[:, :width]
            real = chosen[rows, pick]
            open_[chosen] = False
            ahead = self.edges[nodes[rows, pick]]
            ahead[~real] = -1
            ahead = np.sort(ahead.reshape(many, -1), axis=1).astype(np.int64)
            ahead[:, 1:][ahead[:, 1:] == ahead[:, :-1]] = -1
            ahead[seen[rows, ahead]] = -1
            fresh = ahead >= 0
            width = max(1, int(fresh.sum(axis=1).max()))
            pick = np.argsort(~fresh, axis=1, kind="stable")[:, :width]
            ahead, fresh = ahead[rows, pick], fresh[rows, pick]
            seen[np.nonzero(fresh)[0], ahead[fresh]] = True
            product = np.einsum("bcd,bd->bc", self.x[ahead], queries)
            product[~fresh] = -np.inf
            nodes = np.concatenate([nodes, ahead], axis=1)
            score = np.concatenate([score, product], axis=1)
            open_ = np.concatenate([open_, fresh], axis=1)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    joined = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    flat = joined.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(joined), -1).astype(np.float64)


INDEX = "size int, shard int, node int, vector array<{kind}>, ids array<long>, edges array<int>, entry boolean, top double"


def _built(schema: pa.Schema):
    def of(key: tuple, table: pa.Table) -> pa.Table:
        x, top = _matrix(table.column("vector")), table.column("top")[0].as_py()
        more = np.sqrt(np.maximum(0.0, top - (x * x).sum(axis=1)))
        graph = Graph(np.column_stack([x, more]).astype(np.float32)).build()
        entry = np.zeros(len(x), dtype=bool)
        entry[graph.entries] = True
        columns = {
            "size": pa.array(np.full(len(x), key[0].as_py(), np.int32)), "shard": pa.array(np.full(len(x), key[1].as_py(), np.int32)),
            "node": pa.array(np.arange(len(x), dtype=np.int32)), "vector": table.column("vector").cast(schema.field("vector").type),
            "ids": table.column("ids").cast(pa.list_(pa.int64())), "edges": pa.array(list(graph.edges), pa.list_(pa.int32())),
            "entry": pa.array(entry), "top": pa.array(np.full(len(x), top)),
        }
        return pa.table(columns, schema=schema)

    return of


FOUND = "query_id long, query_row long, vec_id long, score double"
_found = pa.schema([("query_id", pa.int64()), ("query_row", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


class Shard:
    """A shard's graph with its vectors as given, and the ids of each."""

    def __init__(self, index: pa.Table):
        self.x, top = _matrix(index.column("vector")), index.column("top")[0].as_py()
        more = np.sqrt(np.maximum(0.0, top - (self.x * self.x).sum(axis=1)))
        self.graph = Graph(np.column_stack([self.x, more]).astype(np.float32))
        self.graph.edges = np.array(index.column("edges").to_pylist(), dtype=np.int32)
        self.graph.entries = np.flatnonzero(index.column("entry").to_numpy())
        ids = index.column("ids").to_pylist()
        self.held = np.fromiter(map(len, ids), np.int64, len(ids))
        self.flat, self.begin = np.concatenate([np.array(i, dtype=np.int64) for i in ids]), np.cumsum(self.held) - self.held

    def nearest(self, queries: pa.RecordBatch, k: int) -> pa.RecordBatch:
        q, own, rows = _matrix(queries.column("vector")), queries.column("query_id").to_numpy(), queries.column("query_row").to_numpy()
        flat_q = np.column_stack([q, np.zeros(len(q))]).astype(np.float32)
        out = []
        for at in range(0, len(q), AT_ONCE):
            nodes, _ = self.graph.search(flat_q[at : at + AT_ONCE], max(BEAM, 2 * k))
            for i, row in enumerate(nodes, start=at):
                row = np.unique(row[row >= 0])
                score = np.einsum("nd,d->n", self.x[row], q[i])
                many = self.held[row]
                places = np.repeat(self.begin[row] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
                found, score = self.flat[places], np.repeat(score, many)
                score, found = score[found != own[i]], found[found != own[i]]
                best = np.lexsort((found, -score))[:k]
                out.append((np.full(len(best), own[i]), np.full(len(best), rows[i]), found[best], score[best]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], schema=_found)


def _searched(k: int):
    """Rows arrive by shard, its nodes in order before its queries."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes: list[pa.RecordBatch] = []
        name, shard = None, None
        for (*key, kind), part in runs(batches, ["size", "shard", "block", "kind"]):
            if key != name:
                name, nodes, shard = key, [], None
            if not kind:
                nodes.append(part)
            elif nodes or shard:
                if nodes:
                    shard, nodes = Shard(pa.Table.from_batches(nodes)), []
                yield shard.nearest(part, k)

    return of


def _usable(column: str) -> Column:
    """Not null, not zero, and every component a finite number."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    v = F.col(column)
    return v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0)


def neighbours(
    table: DataFrame, k: int = 20, every: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", shard: int = SHARD
) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest found for each query.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows with
    another id and a vector of the same length. Null, zero and non-finite vectors and null ids
    take no part. A repeated row counts once; rows that share an id but not the vector are
    queries and candidates each for itself. With fewer than ``k`` candidates all are returned,
    and none for a table without others. Other columns are not read.
    """
    spark = table.sparkSession
    on_workers(spark)
    parts = max(parts_of(spark), 1)
    floats = table.schema[vector_col].dataType.simpleString() == "array<float>"
    kind = "float" if floats else "double"
    rows = table.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vector_col}`").cast(f"array<{kind}>").alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & _usable("vector"))
    rows = rows.groupBy("id", "vector").agg(F.count("*").alias("times")).drop("times")
    place = F.row_number().over(W.partitionBy("vector").orderBy("id"))
    first = rows.withColumn("place", place).where(F.col("place") <= k + 1)
    nodes = stored(first.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")), "distinct-vectors")
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    stats = nodes.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n"), F.max(square).alias("top"))
    each = F.greatest(F.lit(min(LEAST, shard)), F.least(F.lit(shard), F.ceil(F.col("n") / parts)))
    lengths = stored(stats.select("size", "top", F.ceil(F.col("n") / each).cast("int").alias("shards")), "lengths")

    dealt = nodes.withColumn("size", F.size("vector")).join(lengths, "size")
    dealt = dealt.withColumn("shard", F.pmod(F.xxhash64("vector"), F.col("shards")).cast("int"))
    number = pa.float32() if floats else pa.float64()
    schema = pa.schema([
        ("size", pa.int32()), ("shard", pa.int32()), ("node", pa.int32()), ("vector", pa.list_(number)), ("ids", pa.list_(pa.int64())),
        ("edges", pa.list_(pa.int32())), ("entry", pa.bool_()), ("top", pa.float64()),
    ])
    index = stored(dealt.drop("shards").groupBy("size", "shard").applyInArrow(_built(schema), INDEX.format(kind=kind)), "graphs")

    asked = rows.where(F.col("id") % every == 0).withColumn("size", F.size("vector"))
    queries = stored(
        asked.select(F.col("id").alias("query_id"), "vector", "size", F.monotonically_increasing_id().alias("query_row")), "queries"
    )
    blocks = pieces_for(queries.count(), BLOCK)
    every_block = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    every_shard = F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard")
    block = F.pmod(F.xxhash64("query_row"), F.lit(blocks)).cast("int").alias("block")
    sent = queries.join(lengths, "size").select("size", every_shard, "query_id", "query_row", "vector", block, F.lit(1).alias("kind"))
    graphs = index.select("*", every_block, F.lit(0).alias("kind"))
    met = graphs.unionByName(sent, allowMissingColumns=True).repartition(parts, "size", "shard", "block")
    met = met.sortWithinPartitions("size", "shard", "block", "kind", "node")
    found = met.mapInArrow(_searched(k), FOUND)
    rank = F.row_number().over(W.partitionBy("query_row").orderBy(F.desc("score"), "vec_id"))
    best = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
