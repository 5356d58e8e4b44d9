import random
from collections import Counter

import numpy as np

import corpus_pipeline
from llm import near_copies


def plain_sets(texts, width=5):
    out = []
    for text in texts:
        words = (text or "").encode().lower().split()
        out.append({tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set())
    return out


def plain_kept(rows):
    """Rows that stay, by comparing every text with every other."""
    sets = plain_sets([r[1] for r in rows])
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            common = len(x & sets[j])
            if 9 * common >= 4 * (len(x) + len(sets[j])):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    best = {}
    for i, r in enumerate(rows):
        key = (r[0] is None, r[0] or 0)
        if find(i) not in best or key < best[find(i)][0]:
            best[find(i)] = (key, r)
    return Counter((r[0], r[1]) for _, r in best.values())


def kept(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def edited(rng, words, edits):
    words = list(words)
    for at in rng.sample(range(len(words)), edits):
        words[at] = f"new{rng.randrange(10**9)}"
    return words


def test_edited_copies_are_found_at_the_similarity(spark, documents):
    rng = random.Random(5)
    rows = []
    for family in range(60):
        words = [f"f{family}w{rng.randrange(400)}" for _ in range(rng.randrange(40, 300))]
        for edits in (0, 0, 1, 2, 3, 4, 6):
            rows.append((len(rows), " ".join(edited(rng, words, edits))))
    # A chain: each near the next, the ends far apart.
    words = [f"c{i}" for i in range(200)]
    for _ in range(8):
        rows.append((len(rows), " ".join(words)))
        words = edited(rng, words, 3)
    rng.shuffle(rows)
    got = kept(near_copies.keep_one(documents(rows)))
    assert got == plain_kept(rows)
    assert kept(corpus_pipeline.near_dedup(spark, documents(rows), "")) == got


def test_texts_below_the_similarity_stay(documents):
    words = [f"w{i}" for i in range(104)]  # 100 shingles
    rows = [(1, " ".join(words))]
    # 11 shingles differ: 89 of 111 in common; 12 differ: 88 of 112.
    rows.append((2, " ".join(words[:-11] + [f"a{i}" for i in range(11)])))
    rows.append((3, " ".join([f"b{i}" for i in range(12)] + words[12:])))
    assert kept(near_copies.keep_one(documents(rows))) == plain_kept(rows) == Counter({rows[0]: 1, rows[2]: 1})


def test_near_copies_of_odd_rows(documents, odd_rows):
    df = documents(odd_rows)
    out = near_copies.keep_one(df)
    assert out.columns == df.columns
    got = out.collect()
    assert Counter(r.doc_id for r in got) == Counter(k[0] for k in plain_kept(odd_rows).elements())
    assert near_copies.keep_one(documents([])).count() == 0


def test_near_copies_of_the_given_table(spark, documents, sf_docs):
    rows = [r for r in sf_docs(spark, "/root/testdata/sf0.01") if len((r[1] or "").split()) >= 20]
    assert kept(near_copies.keep_one(documents(rows, clashing=False))) == plain_kept(rows)


def test_a_large_group_around_the_similarity(documents):
    """Two thousand copies of one text, each with edits of its own: of pairs some have the
    similarity and most do not quite."""
    rng = random.Random(8)
    words = [f"w{i}" for i in range(150)]
    rows = [(i, " ".join(edited(rng, words, rng.choice([1, 2, 3, 3])))) for i in range(2_000)]
    sets = plain_sets([r[1] for r in rows])
    got = kept(near_copies.keep_one(documents(rows, clashing=False)))
    assert got == by_counts(rows, sets)


def by_counts(rows, sets):
    """``plain_kept`` by numpy: all pairs at once."""
    names = {s: k for k, s in enumerate(sorted({x for own in sets for x in own}))}
    table = np.zeros((len(sets), len(names)), dtype=np.float32)
    for i, own in enumerate(sets):
        table[i, [names[x] for x in own]] = 1
    sizes = table.sum(axis=1)
    near = 9 * (table @ table.T) >= 4 * (sizes[:, None] + sizes[None, :])
    group = np.arange(len(rows))
    while True:
        least = np.where(near, group[None, :], len(rows)).min(axis=1)
        if (least == group).all():
            return Counter((rows[i][0], rows[i][1]) for i in np.unique(group))
        group = least


def test_large_keys_and_hubs_are_cut(monkeypatch, documents):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(edited(rng, words, rng.choice([1, 2, 3])))) for i in range(150)]
    monkeypatch.setattr("llm.sign_hashing.NODE", 16)
    monkeypatch.setattr(near_copies, "HUB", 7)
    assert kept(near_copies.keep_one(documents(rows))) == plain_kept(rows)


def test_groups_of_sets_equal_all_pairs():
    rng = random.Random(10)
    for _ in range(30):
        base = rng.sample(range(1000), 20)
        sets = [np.unique(np.array([x if rng.random() > 0.15 else rng.randrange(1000) for x in base], dtype=np.uint64)) for _ in range(25)]
        group = near_copies.groups_of(sets, (4, 5))
        root = list(range(25))
        for i in range(25):
            for j in range(i):
                a, b = set(sets[i].tolist()), set(sets[j].tolist())
                if 5 * len(a & b) >= 4 * len(a | b):
                    x, y = root[i], root[j]
                    root = [min(x, y) if r in (x, y) else r for r in root]
        assert group.tolist() == root
