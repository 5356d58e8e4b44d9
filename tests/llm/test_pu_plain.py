"""Positive-unlabelled learning against a plain version over one matrix."""

import random
import zlib

import numpy as np

from llm import pu_quality as pu


def logistic(z):
    return 1 / (1 + np.exp(-np.clip(z, -60, 60)))


def plain_fit(every, positives, prior):
    """The same risk, summed over the rows as they are."""
    d = every.shape[1]

    def parts(w):
        out = []
        for x in (every, positives):
            p = logistic(x @ w)
            out.append((np.logaddexp(0, x @ w).mean(), x.mean(axis=0), x.T @ p / len(x), (x * (p * (1 - p))[:, None]).T @ x / len(x)))
        return out

    w = np.zeros(d)
    (_, mean, _, curve), _ = parts(w)
    ridge = np.diag(np.maximum(4 * np.diag(curve) - mean**2, 0) / len(positives) + 1e-6)
    for _ in range(pu.STEPS):
        (loss0, _, slope0, curve0), (loss1, mean1, slope1, curve1) = parts(w)
        if prior is None:
            slope, curve = slope0 + slope1 - mean1, curve0 + curve1
        else:
            slope, curve = slope0 - prior * mean1, curve0
        step = np.linalg.solve(curve + ridge, slope + ridge @ w)
        if prior is not None:
            falls = slope0 - prior * slope1
            over = falls @ step - (loss0 - prior * loss1)
            if over > 0:
                aside = np.linalg.solve(curve + ridge, falls)
                step = step - over / (falls @ aside) * aside
        cut = 1.0
        while True:
            tried = w - cut * step
            new0, new1 = parts(tried)
            negative = new0[0] - (prior or 0) * new1[0]
            if prior is None or negative >= -pu.BORDER or cut < 0.05:
                break
            cut /= 2
        if prior is not None and negative < -pu.BORDER:
            break
        w = tried
        if np.abs(step).max() < 1e-2:
            break
    return w


def plain_prior(every, positives, w, least=0.3):
    best = 1.0
    for edge in range(pu.BINS):  # scores from this bin on
        a, b = (np.minimum((logistic(x @ w) * pu.BINS).astype(int), pu.BINS - 1) >= edge for x in (every, positives))
        if b.mean() >= least:
            up = a.mean() + 2 * np.sqrt(a.mean() * (1 - a.mean()) / len(a))
            down = max(b.mean() - 2 * np.sqrt(b.mean() * (1 - b.mean()) / len(b)), 1e-3)
            best = min(best, up / down)
    return float(np.clip(best, 0.01, 0.99))


def texts(n):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(n):
        good = rng.random() < 0.6
        words = [rng.choice(["river", "stone", "walks", "under", "light", "quiet", "seven"]) for _ in range(rng.randrange(30, 90))]
        if not good:
            words = [w + rng.choice(["!!", "$#", " 12", ""]) for w in words]
        rows.append((i, " ".join(words)))
        if rng.random() < 0.4:
            labels.append((i, int(good), 0))
    return rows, labels


def test_scores_equal_a_plain_fit(spark, documents):
    rows, labels = texts(500)
    labels += [(3, 1, 0), (3, 0, 0), (9_999, 1, 0), (None, 1, 0)]  # both labels, no document, no id
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in pu.classify(documents(rows), table).collect()}

    x = pu.features([t.encode() for _, t in rows]).astype(np.float64)
    seen = {}
    for i, quality, _ in labels:
        seen.setdefault(i, set()).add(quality)
    held = [zlib.crc32(str(i).encode()) % 4 == 2 for i, _ in rows]
    own = [k for k, (i, _) in enumerate(rows) if seen.get(i) == {1} and not held[k]]
    first = plain_fit(x, x[own], None)
    prior = plain_prior(x, x[own], first)
    want = logistic(x @ plain_fit(x, x[own], prior))
    assert 0.4 < prior < 0.8
    for k, (i, _) in enumerate(rows):
        assert abs(got[i].score - want[k]) < 1e-6 and got[i].held_out == held[k]
