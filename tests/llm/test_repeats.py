import hashlib
from collections import Counter

import numpy as np
import pytest

from llm import repeats
from llm.queries import QUERIES


def expected(rows, window=35):
    texts = [(r[1] or "").encode().split() for r in rows]
    times = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    out = Counter()
    for row, words in zip(rows, texts):
        gone = {i + k for i in range(len(words) - window + 1) if times[tuple(words[i : i + window])] > 1 for k in range(window)}
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out[(row[0], len(words), len(gone), kept.decode())] += 1
    return out


def found(df):
    return Counter(tuple(r) for r in df.collect())


def test_query_against_all_windows(spark, sf_docs):
    got = QUERIES["op10_repeated_phrases"](spark, "/root/testdata/sf0.001").collect()
    want = expected(sf_docs(spark))
    hashed = Counter({(d, n, g, hashlib.sha256(k.encode()).hexdigest()): c for (d, n, g, k), c in want.items()})
    assert Counter(tuple(r) for r in got) == hashed


def passages(seed):
    """Texts that share passages around the window's length, at edges, twice, and overlapping."""
    rng = np.random.default_rng(seed)
    fresh = iter(range(10**9))
    own = lambda n: [f"u{next(fresh)}" for _ in range(n)]
    shared = own(120)
    rows = []
    for k in range(40):
        a = int(rng.integers(0, 80))
        piece = shared[a : a + int(rng.integers(30, 45))]
        before, after = own(int(rng.integers(0, 50))), own(int(rng.integers(0, 50)))
        rows.append((k, " ".join([*before, *piece, *after])))
    rows.append((100, " ".join([*shared, *own(3), *shared])))
    rows.append((101, " ".join(["again"] * 36)))
    rows.append((102, " ".join(["once"] * 35)))
    rows.append((103, " ".join(["a", "b", "c"] * 15)))
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_shared_passages(documents, seed):
    rows = passages(seed)
    assert found(repeats.remove_repeats(documents(rows))) == expected(rows)


def test_split_shards_give_the_same(documents, monkeypatch):
    rows = passages(7)
    monkeypatch.setattr(repeats, "PATTERNS", 3)
    monkeypatch.setattr(repeats, "SEGMENTS", 2)
    assert found(repeats.remove_repeats(documents(rows))) == expected(rows)


def test_odd_rows_and_empty_table(documents, odd_rows):
    df = documents(odd_rows)
    assert found(repeats.remove_repeats(df)) == expected(odd_rows)
    cut = repeats.without_repeats(df)
    assert cut.columns == df.columns
    want = Counter()
    for (doc, n, gone, kept), times in expected(odd_rows).items():
        want[(doc, kept if gone else None)] += times
    texts = Counter((r[0], r[1]) for r in odd_rows)
    got = Counter((r.doc_id, None if (r.doc_id, r.text) in texts else r.text) for r in cut.collect())
    assert got == want
    assert repeats.remove_repeats(documents([])).count() == 0
