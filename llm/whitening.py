"""Whitening of vectors: pivoted Cholesky of the centred scatter, then one-sided Jacobi.

Entries become whole numbers, so that counts, sums and deviations are exact and copies are told
exactly. The fit list is each distinct whole-number vector once.

1. Sums of the fit list per dimension, exact.
2. The scatter of centred vectors: (n * x - S) / n, whose numerator is exact, so nothing cancels.
   Every task adds up one matrix; the tasks' matrices are added by Spark.
3. On the driver, whose work depends on the number of dimensions alone: Cholesky with pivots of
   the covariance gives a triangular factor with as many columns as it has rank. Jacobi turns
   pairs of that factor's columns until all are orthogonal. The columns' squared norms are the
   eigenvalues, the columns over their norms the components; the covariance itself is never
   diagonalised, which keeps small eigenvalues accurate.
4. All rows are projected, and the identity error is measured over the fit list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.rows import on_workers, stored

SCALE = 64
SHIFT = 1_000_000
LARGEST = 2.0**55  # of an entry times SCALE
RANK = 1e-13  # pivots below this share of the largest variance are rounding
AT_ONCE = 4096


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """L (d, r) with L @ L.T = v, rows in the order of ``v``; r is the rank found."""
    d = len(v)
    rest, factor, order = np.diag(v).astype(np.float64).copy(), np.zeros((d, d)), np.arange(d)
    least = RANK * max(float(rest.max(initial=0.0)), 0.0) * max(d, 1)
    for k in range(d):
        at = k + int(np.argmax(rest[order[k:]]))
        if rest[order[at]] <= least:
            return factor[:, :k]
        order[[k, at]] = order[[at, k]]
        pivot, below = order[k], order[k + 1 :]
        top = np.sqrt(rest[pivot])
        factor[pivot, k] = top
        factor[below, k] = (v[below, pivot] - factor[below, :k] @ factor[pivot, :k]) / top
        rest[below] -= factor[below, k] ** 2
    return factor


def jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, components as columns) of factor @ factor.T, largest first.

    Columns are turned in rounds of disjoint pairs, every pair once a sweep, until the cosine
    between any two is rounding.
    """
    u = factor.copy()
    r = u.shape[1]
    ring = np.arange(r + r % 2)  # an odd number of columns gets a place that rests
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(ring) - 1):
            a, b = ring[: len(ring) // 2], ring[len(ring) // 2 :][::-1]
            real = (a < r) & (b < r)
            a, b = a[real], b[real]
            x, y = u[:, a], u[:, b]
            xx, yy, xy = (np.einsum("dk,dk->k", p, q) for p, q in ((x, x), (y, y), (x, y)))
            size = np.sqrt(xx * yy)
            share = np.divide(np.abs(xy), size, out=np.zeros_like(size), where=size > 0)
            worst = max(worst, float(share.max(initial=0.0)))
            turn = share > 1e-16
            zeta = np.divide(yy - xx, 2 * xy, out=np.zeros_like(xy), where=turn)
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            t = np.where(turn, t, 0.0)
            c = 1 / np.sqrt(1 + t * t)
            u[:, a], u[:, b] = c * x - c * t * y, c * t * x + c * y
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
        if worst < 1e-15:
            break
    norms = np.sqrt(np.einsum("dk,dk->k", u, u))
    order = np.argsort(-norms, kind="stable")
    order = order[norms[order] > 0]
    return norms[order] ** 2, u[:, order] / norms[order]


def components_of(v: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest ``k`` eigenvalues of a covariance, or its rank, and components as columns.

    A component's sign makes its entry of largest size positive (the first, if several)."""
    values, vectors = jacobi(pivoted_cholesky(v))
    values, vectors = values[:k], vectors[:, :k]
    first = np.argmax(np.abs(vectors) > np.abs(vectors).max(axis=0, initial=0.0) * (1 - 1e-9), axis=0)
    return values, vectors * np.where(vectors[first, np.arange(len(values))] < 0, -1.0, 1.0)


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, int, np.ndarray]]:
    """(batch, places, length, matrix of whole numbers) for each length in it."""
    for whole in batches:
        for at in range(0, whole.num_rows, AT_ONCE):
            batch = whole.slice(at, AT_ONCE)
            lists = batch.column("x")
            lengths = np.diff(np.asarray(lists.offsets))
            for d in np.unique(lengths).tolist():
                own = np.flatnonzero(lengths == d)
                yield batch, own, d, lists.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).reshape(len(own), d)


def _scattered(fits: dict[int, tuple[int, np.ndarray]], turns: dict[int, np.ndarray] | None = None):
    """Sums of products of centred vectors, or of those turned by ``turns``: a row of the matrix
    in each row, for each task."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for _, _, d, x in _matrices(batches):
            n, s = fits[d]
            z = (n * x - s) / n
            z = z if turns is None else z @ turns[d]
            sums[d] = sums.get(d, 0.0) + z.T @ z
        for d, m in sums.items():
            k = len(m)
            columns = [np.full(k * k, d, np.int32), np.repeat(np.arange(k, dtype=np.int32), k), np.tile(np.arange(k, dtype=np.int32), k), m.ravel()]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["size", "i", "j", "v"])

    return of


def _covariances(fit: DataFrame, fits: dict[int, tuple[int, np.ndarray]], turns: dict[int, np.ndarray] | None = None) -> dict[int, np.ndarray]:
    found = fit.mapInArrow(_scattered(fits, turns), "size int, i int, j int, v double").groupBy("size", "i", "j").agg(F.sum("v").alias("v"))
    table = found.toArrow().to_pydict()
    size, i, j = (np.array(table[c], dtype=np.int64) for c in ("size", "i", "j"))
    v = np.array(table["v"], dtype=np.float64)
    out = {}
    for d, (n, _) in fits.items():
        own = size == d
        k = int(i[own].max(initial=-1)) + 1
        out[d] = np.zeros((k, k))
        out[d][i[own], j[own]] = v[own] / n
    return out


def exact_squares(x: np.ndarray, n: int, s: np.ndarray) -> list[int]:
    """Sum over dimensions of (n * x - S) squared, exact, for each row."""
    y = n * x - s
    widest = int(np.abs(y).max(initial=0))
    if widest * widest * max(1, y.shape[1]) < 2**63:
        return np.einsum("nd,nd->n", y, y).tolist()
    found = [sum(e * e for e in row) for row in y.tolist()]
    if max(found) >= 2**63:
        raise OverflowError("a deviation of n * x - S is beyond a 64-bit number")
    return found


def _whitened(fits: dict[int, tuple[int, np.ndarray]], models: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, float]]):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, own, d, x in _matrices(batches):
            (n, s), (_, turn, explained, error) = fits[d], models[d]
            k, m = turn.shape[1], len(own)
            if not k:
                continue
            deviation = np.array(exact_squares(x, n, s), dtype=np.int64)
            columns = [
                batch.column("id").take(pa.array(np.repeat(own, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                pa.array(np.full(m * k, n)), pa.array(np.repeat(deviation, k)), pa.array(((n * x - s) / n @ turn).ravel()),
                pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return of


def whole_numbers(column: str):
    """floor(SCALE * entry) + SHIFT of each entry."""
    return F.transform(F.col(column).cast("array<double>"), lambda c: F.floor(c * SCALE) + SHIFT)


def whiten(table: DataFrame, k: int = 16, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, component (from 1), n, deviation, whitened, explained and identity_error for each
    row and each of the ``k`` largest components, or as many as the fit list has rank.

    Rows whose vector is null or holds null or non-finite entries are dropped, as are those with
    an entry too large for a whole number (2 ** 55 / SCALE). Vectors of each length are a table
    of their own: fitted, numbered and projected apart. Empty vectors have no components, and a
    fit list of one vector, or of copies alone, has none either, so such rows give no result.
    Repeated rows and null ids stay. Other columns are not read.

    The driver holds a matrix of dimensions by dimensions per length, nothing that grows with rows.
    """
    on_workers(table.sparkSession)
    bad = lambda c: c.isNull() | F.isnan(c) | (F.abs(c * SCALE) > LARGEST)
    own = table.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    own = own.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & ~F.exists("vector", bad))
    rows = stored(own.select("id", whole_numbers("vector").alias("x")), "whole-vectors")
    fit = stored(rows.select("x").groupBy("x").agg(F.count("*").alias("times")).select("x"), "fit-list")
    kind = rows.schema["id"].dataType.simpleString()

    sums: dict[int, tuple[int, np.ndarray]] = {}
    found = fit.mapInArrow(_summed, "size int, at int, n long, s decimal(38,0)").groupBy("size", "at")
    for r in found.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect():
        sums.setdefault(r["size"], (r["n"], np.zeros(r["size"], dtype=np.int64)))[1][r["at"]] = int(r["s"])
    covariances = _covariances(fit, sums)
    solved = {d: components_of(v, k) for d, v in covariances.items()}
    turns = {d: vectors / np.sqrt(values) for d, (values, vectors) in solved.items()}
    errors = {d: float(np.abs(c - np.eye(len(c))).max(initial=0.0)) for d, c in _covariances(fit, sums, turns).items()}
    models = {d: (values, turns[d], values / max(np.trace(covariances[d]), 1e-300), errors[d]) for d, (values, _) in solved.items()}
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    return rows.mapInArrow(_whitened(sums, models), schema)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each length: vectors and sums per dimension, one set for each task."""
    sums: dict[int, tuple[int, np.ndarray]] = {}
    for _, _, d, x in _matrices(batches):
        n, s = sums.get(d, (0, np.zeros(d, dtype=object)))
        sums[d] = n + len(x), s + x.sum(axis=0)
    for d, (n, s) in sums.items():
        columns = [
            pa.array(np.full(d, d, np.int32)), pa.array(np.arange(d, dtype=np.int32)),
            pa.array(np.full(d, n)), pa.array([int(v) for v in s], pa.decimal128(38, 0)),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["size", "at", "n", "s"])
