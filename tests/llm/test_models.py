import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from llm import graph_search, interpolation, pu_quality
from llm.queries import QUERIES


def fold(doc, folds):
    return zlib.crc32(("" if doc is None else str(doc)).encode()) % folds


def plain_counts(rows):
    counts, pairs, texts = Counter(), Counter(), []
    for doc, text, *_ in rows:
        words = [*(text or "").encode().lower().split(), b" "]
        texts.append(words)
        if fold(doc, 10):
            counts.update(words)
            pairs.update(zip([b" ", *words], words))
    return counts, pairs, texts


def check_base(rows, got):
    counts, _, texts = plain_counts(rows)
    n, v = sum(counts.values()), len(counts)
    want = Counter()
    for (doc, *_), words in zip(rows, texts):
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words)
        want[(doc, fold(doc, 10) == 0, len(words), sum(counts[w] > 0 for w in words), n, round(base, 6))] += 1
    assert Counter((*tuple(r)[:5], round(r.base_score, 6)) for r in got) == want
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)


def test_base_counts_of_the_query_and_held_out_gain(spark, sf_docs):
    rows = sf_docs(spark)
    got = QUERIES["op4_deleted_interpolation"](spark, "/root/testdata/sf0.001").collect()
    check_base(rows, got)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_scores_of_odd_rows_and_empty_table(documents, odd_rows):
    check_base(odd_rows, interpolation.score(documents(odd_rows)).collect())
    assert interpolation.score(documents([])).count() == 0


def test_scores_follow_counts_and_weights(documents, monkeypatch):
    """Every text once more with the same weights, from plain counts; and what a context leaves
    to all known words and one unknown sums to one."""
    rows = [(k, " ".join(f"v{(k * i + i * i) % 17}" for i in range(1 + k % 23))) for k in range(150)]
    fitted = []
    fit = interpolation.fit_weights
    monkeypatch.setattr(interpolation, "fit_weights", lambda *a: fitted.append(fit(*a)) or fitted[-1])
    got = {r.doc_id: r.score for r in interpolation.score(documents(rows)).collect()}
    counts, pairs, texts = plain_counts(rows)
    n, v, weights = sum(counts.values()), len(counts), fitted[0]

    def probability(before, word):
        c = counts[before]
        w = weights[0 if not c else c.bit_length()]
        return w[0] * (pairs[before, word] / c if c else 0) + w[1] * counts[word] / n + w[2] / (v + 1)

    for (doc, _), words in zip(rows, texts):
        assert got[doc] == pytest.approx(sum(math.log10(probability(a, b)) for a, b in zip([b" ", *words], words)))
    for before in [*counts, b"never seen"]:
        assert sum(probability(before, w) for w in [*counts, b"unknown"]) == pytest.approx(1)


def test_weights_favour_what_predicts():
    weights = interpolation.fit_weights([(3, 0, -40, 900), (3, 1, -40, 100), (5, 1, -8, 1000)], 1e-6)
    assert np.allclose(weights.sum(axis=1), 1)
    assert weights[3][0] > 0.8 and weights[5][1] > 0.9


@pytest.mark.parametrize("values", [[], [0], [0, 0], [1, 2**40, 7], list(range(300))])
def test_packed_numbers(values):
    x = np.array(values, dtype=np.uint64)
    assert interpolation.unpack(interpolation.pack(x)).tolist() == values
    ordered = np.sort(x)
    assert interpolation.unpack_sorted(interpolation.pack_sorted(ordered)).tolist() == sorted(values)


def recall(table, found, every=20, k=20):
    ids = np.array([i for i, _ in table])
    x = np.array([v for _, v in table], dtype=float)
    by = defaultdict(list)
    for r in sorted(found, key=lambda r: r["rank"]):
        by[r.query_id].append((r.vec_id, r.score))
    hits = total = 0
    for q in np.flatnonzero(ids % every == 0):
        score = x @ x[q]
        best = [j for j in np.lexsort((ids, -score)) if j != q][:k]
        got = by[ids[q]]
        assert len(got) == len(best)
        place = {int(i): j for j, i in enumerate(ids)}
        assert all(s == pytest.approx(float(x[place[v]] @ x[q]), abs=1e-12) for v, s in got)
        assert got == sorted(got, key=lambda g: (-g[1], g[0]))
        hits += len({int(ids[j]) for j in best} & {v for v, _ in got})
        total += len(best)
    return hits / total


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_recall_of_the_query(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    assert recall(rows, QUERIES["op2_graph_search"](spark, "/root/testdata/sf0.01").collect()) >= 0.95


def test_recall_over_several_shards_and_lengths(spark):
    rng = np.random.default_rng(0)
    x = (rng.normal(size=(1500, 16)) * rng.uniform(0.2, 3, size=(1500, 1))).astype(np.float32)
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    assert recall(rows, graph_search.neighbours(vectors(spark, rows), shard=400).collect()) >= 0.9


def test_equal_vectors_are_all_candidates(spark):
    rows = [(k, [1.0, 0.0]) for k in range(60)] + [(k, [0.0, 1.0]) for k in range(60, 70)]
    got = graph_search.neighbours(vectors(spark, rows)).collect()
    by = defaultdict(list)
    for r in sorted(got, key=lambda r: r["rank"]):
        by[r.query_id].append((r.vec_id, r.score))
    assert by[0] == [(k, 1.0) for k in range(1, 21)]
    assert by[40] == [(k, 1.0) for k in range(20)]
    assert by[60] == [(k, 1.0) for k in range(61, 70)] + [(k, 0.0) for k in range(11)]


def test_vectors_that_take_no_part(spark):
    bad = [(20, None), (40, []), (60, [0.0, 0.0]), (80, [float("nan"), 1.0]), (100, [float("inf"), 1.0]), (120, [None, 1.0]), (140, [1.0]), (None, [1.0, 1.0])]
    rows = [*bad, (0, [1.0, 2.0]), (1, [2.0, 1.0]), (1, [2.0, 1.0])]
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in graph_search.neighbours(vectors(spark, rows)).collect()]
    assert got == [(0, 1, 1, 4.0)]
    assert graph_search.neighbours(vectors(spark, bad)).count() == 0
    assert graph_search.neighbours(vectors(spark, [])).count() == 0


def test_each_length_is_searched_among_its_own(spark):
    rng = np.random.default_rng(2)
    two = [(k, rng.normal(size=2).tolist()) for k in range(100)]
    plain = {tuple(r) for r in graph_search.neighbours(vectors(spark, two)).collect()}
    mixed = vectors(spark, [*two, (200, [1.0, 2.0, 3.0]), (201, [3.0, 2.0, 1.0]), (220, [1.0])])
    for name in ("query_row", "shard", "kind", "label"):  # columns of other meaning
        mixed = mixed.withColumn(name, mixed["vec_id"])
    got = {tuple(r) for r in graph_search.neighbours(mixed).collect()}
    assert len(plain) == 100 and got == plain | {(200, 1, 201, 10.0)}


def test_more_queries_than_a_block(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=8).astype(np.float32).tolist()) for k in range(400)]
    want = {tuple(r) for r in graph_search.neighbours(vectors(spark, rows)).collect()}
    monkeypatch.setattr(graph_search, "BLOCK", 7)
    assert {tuple(r) for r in graph_search.neighbours(vectors(spark, rows)).collect()} == want


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in QUERIES["op5_positive_unlabelled"](spark, folder).collect()}
    assert len(got) == spark.read.parquet(f"{folder}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert all(r.held_out == (fold(r.doc_id, 4) == 2) for r in got.values())
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [(labels[k], r.predicted) for k, r in got.items() if r.held_out and k in labels]
    assert np.mean([a == b for a, b in held]) >= 0.95


def test_classifier_on_odd_rows(spark, documents, odd_rows):
    labels = spark.createDataFrame([(5, 1), (6, 1), (7, 0), (None, 1), (77, 1)], "doc_id long, quality int")
    got = pu_quality.classify(documents(odd_rows), labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in odd_rows)
    assert all(0 <= r.score <= 1 for r in got)
    none = pu_quality.classify(documents(odd_rows), labels.where("quality > 1")).collect()
    assert {r.score for r in none} == {0.5}
    assert pu_quality.classify(documents([]), labels).count() == 0


def test_negative_risk_stays_above_zero(spark):
    """Two well separated groups: the prior is found, and the risk on negatives is not negative."""
    rng = np.random.default_rng(3)
    good = np.column_stack([np.ones(900), rng.normal(2, 1, 900)])
    bad = np.column_stack([np.ones(600), rng.normal(-2, 1, 600)])
    rows = [(0, x.tolist()) for x in (*good[:600], *bad)] + [(1, x.tolist()) for x in good[600:]]
    sides = spark.createDataFrame(rows, "side int, x array<float>")
    prior = pu_quality.estimate_prior(sides, pu_quality.fit(sides, None, width=2))
    assert prior == pytest.approx(0.5, abs=0.08)
    w = pu_quality.fit(sides, prior, width=2)
    assert pu_quality.Risk(sides, w).negative(prior) >= 0
    assert np.mean(good @ w > 0) > 0.9 and np.mean(bad @ w < 0) > 0.9
