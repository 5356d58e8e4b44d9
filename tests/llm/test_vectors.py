"""Whitening and near-duplicate vectors against plain versions."""

import math
import random

import numpy as np
import pytest

from llm import sign_hashing, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, row long, size int, signs binary, x int"


@pytest.fixture(scope="module")
def vectors(spark):
    """A table of vectors from (vec_id, embedding) rows, with clashing extra columns."""
    return lambda rows, kind="float": spark.createDataFrame(
        [(i, v, 0, 1, 2, b"s", 3) for i, v in rows], SCHEMA.replace("float", kind)
    )


def near_families(seed, families=40, dims=24, noise=0.25):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(families):
        centre = rng.standard_normal(dims)
        for _ in range(int(rng.integers(1, 12))):
            v = centre + noise * rng.standard_normal(dims) * rng.random()
            rows.append([float(c) for c in np.float32(v * rng.choice([0.01, 1, 30]))])
        if rng.random() < 0.3:
            rows += [rows[-1]] * 3
    order = rng.permutation(len(rows))
    return [(int(i), rows[j]) for i, j in enumerate(order)]


def plain_near(rows, least=0.95):
    """(vec_id, n_links, component_id, kept) by comparing every row with every other."""
    def fine(v):
        return bool(v) and None not in v and all(map(math.isfinite, v)) and any(v)

    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(rows)
    good = [np.array(v) / np.abs(v).max() if fine(v) else None for _, v in rows]
    for i, x in enumerate(good):
        for j in range(i):
            y = good[j]
            if x is None or y is None or len(x) != len(y):
                continue
            if x @ y / math.sqrt((x @ x) * (y @ y)) >= least:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    least_id = {}
    for i, (vec_id, _) in enumerate(rows):
        if vec_id is not None:
            least_id[find(i)] = min(vec_id, least_id.get(find(i), vec_id))
    return sorted(
        ((v, links[i], least_id.get(find(i)), v == least_id.get(find(i))) for i, (v, _) in enumerate(rows)), key=repr
    )


def got_near(df):
    return sorted((tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_vectors_equal_brute_force(vectors, seed):
    rows = near_families(seed)
    want = plain_near(rows)
    assert got_near(sign_hashing.near_vectors(vectors(rows))) == want
    assert sum(w[1] for w in want) > 100 and len({w[2] for w in want}) > 20


def test_large_keys_are_cut_into_chunks(vectors, monkeypatch):
    rows = near_families(3, families=12, noise=0.1)
    want = plain_near(rows)
    monkeypatch.setattr(sign_hashing, "NODE", 6)
    monkeypatch.setattr(sign_hashing, "AT_ONCE", 3)
    assert got_near(sign_hashing.near_vectors(vectors(rows))) == want


def test_recall_at_the_least_cosine(vectors):
    """Pairs just above the least cosine, which tables miss most often."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(1500):
        x = rng.standard_normal(32)
        y = rng.standard_normal(32)
        x /= np.linalg.norm(x)
        y -= (x @ y) * x
        y /= np.linalg.norm(y)
        angle = math.acos(0.9503)
        rows += [(2 * i, [float(c) for c in x]), (2 * i + 1, [float(c) for c in math.cos(angle) * x + math.sin(angle) * y])]
    found = sign_hashing.near_vectors(vectors(rows, "double"))
    assert found.where("n_links = 1").count() == 3000


def test_tables_follow_the_number_of_vectors():
    for count in (1, 50, 10_000, 10**9):
        bits, tables = sign_hashing.tables_for(count, 0.95)
        agree = 1 - math.acos(0.95) / math.pi
        assert (1 - agree**bits) ** tables <= sign_hashing.MISS
        assert count / 2**bits <= sign_hashing.EXPECTED
    assert sign_hashing.tables_for(1000, 1.0)[1] == 1


ODD = [
    (1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]),
    (7, [1.0, 0.0]), (7, [1.0, 0.0]), (None, [2.0, 0.0]), (8, [1.0, -0.0]), (9, [1.0, 0.0, 0.0]), (-3, [0.0, 1.0, 0.0]),
    (None, [0.0, -1.0]), (10, [3e38, 0.0]), (11, [1e-38, 0.0]),
]


def test_near_vectors_of_odd_rows(vectors):
    assert got_near(sign_hashing.near_vectors(vectors(ODD))) == plain_near(ODD)
    assert sign_hashing.near_vectors(vectors([])).count() == 0
    assert sign_hashing.near_vectors(vectors(ODD[:6])).where("n_links = 0 and kept").count() == 6


def plain_whitening(v, k):
    x = np.floor(64 * v).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    z = (n * fit - s) / n
    values, vectors = np.linalg.eigh(z.T @ z / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = ((n * x - s) / n) @ vectors[:, :k] / np.sqrt(values[:k])
    return n, ((n * x - s) ** 2).sum(axis=1), out, values[:k] / values.sum()


def test_whitening_equals_a_plain_version(vectors):
    rng = np.random.default_rng(4)
    v = np.float32(rng.standard_normal((400, 12)) * np.geomspace(5, 0.1, 12) + rng.standard_normal(12) * 1000)
    v = np.concatenate([v, v[:50], v[:1]])
    rows = [(i, [float(c) for c in x]) for i, x in enumerate(v)]
    got = whitening.whiten(vectors(rows), k=5).toPandas()
    n, deviation, want, explained = plain_whitening(v.astype(np.float64), 5)
    assert set(got["n"]) == {n} and n <= 400 and len(got) == 5 * len(rows)
    table = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    signs = np.sign((table * want).sum(axis=0))
    assert np.abs(table * signs - want).max() < 1e-9
    one = got[got.component == 1].sort_values("vec_id")
    assert one.deviation.tolist() == deviation.tolist()
    assert np.abs(got[got.vec_id == 3].sort_values("component").explained / explained - 1).max() < 1e-9
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9


def test_jacobi_on_the_factor():
    rng = np.random.default_rng(8)
    for d, rank in ((1, 1), (2, 2), (7, 7), (9, 4), (16, 15)):
        a = rng.standard_normal((d, rank)) * np.geomspace(1, 1e-4, rank)
        v = a @ a.T
        factor = whitening.pivoted_cholesky(v)
        assert factor.shape == (d, rank) and np.abs(factor @ factor.T - v).max() < 1e-12
        values, vectors = whitening.jacobi(factor)
        assert np.abs(vectors.T @ vectors - np.eye(rank)).max() < 1e-12
        assert np.abs(values / np.linalg.eigvalsh(v)[::-1][:rank] - 1).max() < 1e-5
        assert np.abs(v @ vectors - vectors * values).max() < 1e-12
    assert whitening.pivoted_cholesky(np.zeros((3, 3))).shape == (3, 0)


def test_whitening_of_odd_rows(vectors):
    got = whitening.whiten(vectors(ODD + [(12, [5.0, 2.0]), (13, [1e300, 1.0])], "double"), k=16).collect()
    # Lengths are fitted apart; [3e38, 0] and [1e300, 1] are too large; copies count once.
    two = [r for r in got if r.vec_id in (3, 7, None, 8, 11, 12)]
    assert len(got) == len(two) + 2 and {r.component for r in two} == {1, 2} and len(two) == 16
    assert {r.n for r in two} == {5}  # (0, 0) and (1e-38, 0), (1, 0) and (1, -0), (2, 0), (0, -1), (5, 2)
    assert {(r.vec_id, r.component, r.n) for r in got if r.vec_id in (9, -3)} == {(9, 1, 2), (-3, 1, 2)}
    assert max(r.identity_error for r in got) < 1e-9
    assert whitening.whiten(vectors([])).count() == 0
    assert whitening.whiten(vectors([(1, [1.0, 2.0]), (2, [1.0, 2.0])])).count() == 0


def test_exact_squares_beyond_64_bits():
    x = np.array([[10**6, -(10**6)], [5, 7]], dtype=np.int64)
    n, s = 10**3, np.array([11, -13])
    assert whitening.exact_squares(x, n, s) == [sum((n * int(a) - int(b)) ** 2 for a, b in zip(r, s)) for r in x]
    with pytest.raises(OverflowError):
        whitening.exact_squares(x, 10**5, s)


def test_whitening_is_the_same_on_any_layout(vectors):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(200)]
    a = whitening.whiten(vectors(rows).repartition(7), k=3).orderBy("vec_id", "component").toPandas()
    b = whitening.whiten(vectors(rows[::-1]).coalesce(1), k=3).orderBy("vec_id", "component").toPandas()
    assert np.abs(a.whitened - b.whitened).max() < 1e-9 and a.deviation.equals(b.deviation)
