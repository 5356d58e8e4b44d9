import hashlib
import random
import zlib

import numpy as np
import pytest

from llm import periodic_runs as pr
from llm.text import with_periodic_tail


def plain_runs(w, least):
    """(start, length, period) by trying every period at every place."""
    n, found = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            part = w[i : j + q]
            smaller = any(part[d:] == part[:-d] for d in range(1, q))
            if len(part) >= max(least, 2 * q) and not smaller:
                found.append((i, len(part), q))
            i = j
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_lyndon(s):
    out = [0] * len(s)
    for i in range(len(s)):
        j = i
        while j < len(s) and s[j]:
            w = s[i : j + 1]
            if all(w < w[k:] for k in range(1, len(w))):
                out[i] = len(w)
            j += 1
    return out


def words_of(rng, n, letters):
    w = [b"w%d" % rng.randint(1, letters) for _ in range(n)]
    for _ in range(rng.randrange(3)):
        a, p = rng.randrange(n), rng.randint(1, 12)
        b = min(n, a + rng.randint(1, 6) * p)
        w[a:b] = [w[a + (i - a) % p] if a + (i - a) % p < n else w[i] for i in range(a, b)]
    return w


def test_lyndon_lengths_equal_the_definition():
    rng = random.Random(1)
    for _ in range(150):
        letters = rng.choice([1, 2, 3, 6])
        s = [0] + [rng.randint(1, letters) if rng.random() > 0.1 else 0 for _ in range(rng.randrange(1, 40))] + [0]
        assert pr.lyndon_lengths(np.array(s)).tolist() == plain_lyndon(s)


@pytest.mark.parametrize("plainly", [False, True])
def test_runs_equal_brute_force(monkeypatch, plainly):
    if plainly:  # what happens where hashes were wrong
        monkeypatch.setattr(pr, "runs_in", pr._plainly)
    rng = random.Random(2)
    for _ in range(200):
        least, letters = rng.choice([2, 3, 5, 12]), rng.choice([1, 2, 3, 5, 40])
        texts = [words_of(rng, rng.randrange(1, 70), letters) for _ in range(4)] + [[]]
        want = [(t, *r) for t, w in enumerate(texts) for r in plain_runs(w, least)]
        assert list(zip(*[c.tolist() for c in pr.runs_of_texts(texts, least)])) == want


def test_strings_that_hashes_confuse():
    """Thue-Morse words collide under any base modulo 2**64; the words decide."""
    bits = [bin(i).count("1") % 2 for i in range(4096)]
    text = [[b"ab"[b : b + 1] for b in bits] + [b"ab"[1 - b : 2 - b] for b in bits]]
    found = [c.tolist() for c in pr.runs_of_texts(text, 12)]
    w = text[0]
    for _, start, length, period in zip(*found):
        assert w[start : start + length - period] == w[start + period : start + length] and length >= max(12, 2 * period)
    assert [r for r in zip(*found[1:]) if r[2] <= 64] == plain_runs_of_short_periods(w, 12, 64)


def plain_runs_of_short_periods(w, least, most):
    out = []
    x = np.array([ord(c) for c in w])
    for q in range(1, most + 1):
        same = np.concatenate([[0], (x[q:] == x[:-q]).astype(int), [0]])
        for a, b in zip(np.flatnonzero(np.diff(same) == 1).tolist(), np.flatnonzero(np.diff(same) == -1).tolist()):
            length = b - a + q
            if length >= max(least, 2 * q) and not any((x[a + d : a + length] == x[a : a + length - d]).all() for d in range(1, q)):
                out.append((a, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def digest(doc_id, text):
    """The query's row, from its definition."""
    w = (text or "").encode().split()
    h, n = zlib.crc32(str(doc_id).encode() if doc_id is not None else b""), len(w)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(w, 12)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return (
        doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(),
    )


def digests(df):
    out = pr.run_digest(pr.collapse_runs(df, prepare=with_periodic_tail))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    return sorted(map(tuple, out.collect()), key=repr)


def test_the_query_on_texts_of_up_to_300_words(documents):
    rng = random.Random(5)
    rows = [(i, b" ".join(words_of(rng, rng.randrange(1, 300), rng.choice([2, 20, 500]))).decode()) for i in range(120)]
    assert digests(documents(rows)) == sorted((digest(*r) for r in rows), key=repr)


def test_odd_rows(documents, odd_rows):
    rows = [(r[0], r[1]) for r in odd_rows if len(r[1] or "") < 10_000]
    assert digests(documents(rows)) == sorted((digest(*r) for r in rows), key=repr)
    assert digests(documents([])) == []
    long_text = " ".join(f"w{i % 977}" for i in range(30_000))
    (row,) = pr.collapse_runs(documents([(5, long_text)])).collect()
    assert [tuple(r) for r in row.runs] == [(0, 30_000, 977)] and row.collapsed == " ".join(f"w{i}" for i in range(977))


def test_the_given_table(spark, documents, sf_docs):
    rows = [(r[0], r[1]) for r in sf_docs(spark) if len((r[1] or "").split()) <= 400]
    assert digests(documents(rows, clashing=False)) == sorted((digest(*r) for r in rows), key=repr)
