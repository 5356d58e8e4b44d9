from collections import Counter

import numpy as np
import pytest
import xxhash

from llm import simhash
from llm.components import components
from llm.queries import QUERIES


def plain_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, distance=4):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    x = np.array(prints, dtype=np.uint64)
    for i in range(len(x)):
        for j in np.flatnonzero(np.bitwise_count(x ^ x[i]) <= distance):
            a, b = sorted((find(i), find(int(j))))
            root[b] = a
    return [find(i) for i in range(len(x))]


def expected(rows):
    prints = [plain_print(r[1]) for r in rows]
    groups = plain_groups(prints)
    least = {}
    for row, group in zip(rows, groups):
        if row[0] is not None:
            least[group] = min(row[0], least.get(group, row[0]))
    return Counter((r[0], f"{p:016x}", least.get(g)) for r, p, g in zip(rows, prints, groups))


def found(df):
    return Counter((r.doc_id, r.fingerprint, r.component_id) for r in df.collect())


def near_prints(rng, centres, each, most):
    out = set()
    for centre in rng.integers(0, 2**63, centres, dtype=np.uint64):
        for _ in range(each):
            value = int(centre)
            for bit in rng.integers(0, 64, rng.integers(0, most)):
                value ^= 1 << int(bit)
            out.add(value)
    x = np.array(sorted(out), dtype=np.uint64)
    return x[np.argsort(simhash.gray_rank(x))]


def test_gray_rank_counts_the_gray_code():
    code = np.arange(1024, dtype=np.uint64)
    assert (simhash.gray_rank(code ^ (code >> np.uint64(1))) == code).all()


@pytest.mark.parametrize("seed", range(4))
def test_tree_finds_what_all_pairs_find(seed):
    x = near_prints(np.random.default_rng(seed), 20, 60, 7)
    tree = simhash.Tree(x, np.array([0]), np.array([len(x)]))
    group = simhash._group_links(x, tree, np.zeros(len(x), dtype=int), None, 4)
    assert group.tolist() == plain_groups(x)


@pytest.mark.parametrize("count", [10, 10**7, 10**9, 10**12])
def test_a_pair_within_the_distance_agrees_under_a_mask(count):
    masks = simhash.upper_masks(count, 4)
    rng = np.random.default_rng(1)
    for _ in range(300):
        differ = sum(1 << int(b) for b in rng.choice(64, 4, replace=False))
        assert any(not differ & m for m in masks)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(300, 200), (200, 250), (7, 7)]
    got = {r["a"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = dict.fromkeys(range(1, 41), 0) | dict.fromkeys(range(101, 160), 100) | {300: 200, 250: 200}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_over_many_splits(spark):
    """A long chain whose links are dealt over all tasks, and a hot vertex."""
    links = [(i, i + 1) for i in range(2_000)] + [(5_000, i) for i in range(5_001, 7_000)] + [(i, i + 10_000) for i in range(5_001, 5_400)]
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        got = {r["a"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    finally:
        spark.conf.unset(key)
    want = dict.fromkeys(range(1, 2_001), 0) | dict.fromkeys([*range(5_001, 7_000), *range(15_001, 15_400)], 5_000)
    assert got == want


def test_query_against_all_pairs(spark, sf_docs):
    rows = sf_docs(spark)
    assert found(QUERIES["op1_simhash"](spark, "/root/testdata/sf0.001")) == expected(rows)


def test_odd_rows_and_empty_table(documents, odd_rows):
    assert found(simhash.near_duplicates(documents(odd_rows))) == expected(odd_rows)
    assert simhash.near_duplicates(documents([])).count() == 0


def test_large_nodes_are_cut_into_chunks(documents, monkeypatch):
    base = [f"t{i}" for i in range(60)]
    rows = []
    for k in range(120):
        words = list(base)
        words[k % 60] = f"other{k}"
        rows.append((k, " ".join(words)))
    want = expected(rows)
    monkeypatch.setattr(simhash, "NODE", 8)
    assert found(simhash.near_duplicates(documents(rows))) == want


def test_one_document_of_a_group_stays(documents, odd_rows):
    df = documents(odd_rows)
    kept = simhash.keep_one(df)
    assert kept.columns == df.columns
    groups = {(c[1], c[2]) for c in expected(odd_rows)}
    least = {c for _, c in groups}
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids == Counter(least)
