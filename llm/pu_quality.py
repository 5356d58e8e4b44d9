"""Text quality from positive and unlabelled texts: non-negative risk.

Only trusted positives are learned from; every text of the corpus is the unlabelled side. With
the logistic loss, a class prior p and the linear score z, the risk without bias is

    p * E_pos[loss(z)] + (E_all[loss(-z)] - p * E_pos[loss(-z)])

The bracket is the risk on negatives, which cannot be negative; steps that would make it so go along
the border instead (a model that crosses it fits the positives by heart). The prior is
estimated without negatives: a first model tells positives from all texts, and of the score
ranges that hold most positives, the one where positives are least diluted gives the prior.

A text is measured by shares of its words and characters, each bent by two saturating curves.
The sums for every step (gradient and curvature) run over all rows in Spark; the driver solves
a system with a few dozen unknowns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.host_rules import FOLLOWING, SYMBOLS, repeat_words
from llm.rows import crc_rest, on_workers, smaller, stored
from llm.text import texts_of

SHARES = (
    "symbols", "marks", "stops", "digits", "capitals", "accents", "controls", "lines", "same_lines", "same_word", "repeats",
    "once", "length", "short",
)
BENDS = (0.05, 0.5)
WIDTH = 2 + len(SHARES) * len(BENDS)
MARKS = b"!?;:\"'()[]{}_~^@=+/\\-"
DIGITS = b"0123456789"
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CONTROLS = bytes(set(range(32)) - {9, 10, 11, 12, 13}) + b"\x7f"
BINS = 2000
STEPS = 16
BORDER = 1e-3  # how far below zero a step may end, since the border is curved


def features(texts: list[bytes]) -> np.ndarray:
    """One row per text: 1, whether it has words, and the bent shares."""
    words = [t.split() for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    n = np.maximum(counts, 1)
    size = np.maximum(np.fromiter(map(len, texts), np.int64, len(texts)), 1)
    flat = pa.array([w for own in words for w in own], pa.binary()).dictionary_encode()
    ids = flat.indices.to_numpy(zero_copy_only=False)
    text = np.repeat(np.arange(len(texts)), counts)
    same = np.zeros(len(texts))
    if len(ids):
        equal = (ids[1:] == ids[:-1]) & (text[1:] == text[:-1])
        same = np.bincount(text[1:][equal], minlength=len(texts))
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    without = lambda drop: np.array([len(t) - len(t.translate(None, drop)) for t in texts])
    share = {
        "symbols": without(SYMBOLS) / n,
        "marks": without(MARKS) / n,
        "stops": without(b".,") / n,
        "digits": without(DIGITS) / size,
        "capitals": without(CAPITALS) / size,
        "accents": without(FOLLOWING) / size,
        "controls": without(CONTROLS) / size,
        "lines": np.array([len(x) for x in lines]) / n,
        "same_lines": np.array([len(x) - len(set(x)) for x in lines]) / np.array([max(1, len(x)) for x in lines]),
        "same_word": same / n,
        "repeats": repeat_words(ids, counts) / n,
        "once": np.array([len(set(w)) for w in words]) / n,
        "length": np.maximum(0, size / n - 4) / 4,
        "short": 20 / (20 + n),
    }
    bent = [share[k] / (share[k] + c) for k in SHARES for c in BENDS]
    return np.column_stack([np.ones(len(texts)), counts > 0, *bent]).astype(np.float32)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in smaller(batches, "text"):
        x = features(texts_of(batch.column("text")))
        lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float32()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), lists], ["doc_id", "held_out", "x"])


def _rows(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64)


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _sums(w: np.ndarray):
    """Per side: rows, sums of x, of loss(-z), of its gradient and of its curvature."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d = len(w)
        total = np.zeros((2, 2 + 2 * d + d * d))
        for batch in batches:
            side, x = batch.column("side").to_numpy(), _rows(batch)
            for s in (0, 1):
                own = x[side == s]
                if len(own):
                    z = own @ w
                    p = 1 / (1 + np.exp(-np.clip(z, -60, 60)))
                    curve = (own * (p * (1 - p))[:, None]).T @ own
                    total[s] += np.concatenate([[len(own), _softplus(z).sum()], own.sum(axis=0), own.T @ p, curve.ravel()])
        flat = total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["k", "v"])

    return of


class Risk:
    """Sums over all rows for a weight vector; one Spark job."""

    def __init__(self, sides: DataFrame, w: np.ndarray):
        d = len(w)
        summed = sides.mapInArrow(_sums(w), "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
        flat = np.zeros(2 * (2 + 2 * d + d * d))
        for r in summed:
            flat[r["k"]] = r["v"]
        both = flat.reshape(2, -1)
        self.n = both[:, 0]
        mean = both / np.maximum(self.n, 1)[:, None]
        self.loss_as_negative = mean[:, 1]
        self.x, self.gradient, self.curve = mean[:, 2 : 2 + d], mean[:, 2 + d : 2 + 2 * d], mean[:, 2 + 2 * d :].reshape(2, d, d)

    def negative(self, prior: float) -> float:
        return self.loss_as_negative[0] - prior * self.loss_as_negative[1]


def fit(sides: DataFrame, prior: float | None, width: int = WIDTH) -> np.ndarray:
    """Weights by Newton steps. ``prior`` None: positives against all texts, as two classes of
    equal weight, for the first model. ``sides`` (side, x): 1 positives, 0 all texts. What a
    feature's usual spread adds to a score is held back by a penalty that fades with the number
    of positives."""
    w = np.zeros(width)
    risk = Risk(sides, w)
    spread = np.maximum(4 * np.diag(risk.curve[0]) - risk.x[0] ** 2, 0)  # weights 0: a quarter of squares
    ridge = np.diag(spread / max(1.0, risk.n[1]) + 1e-6)
    for _ in range(STEPS):
        if prior is None:
            # loss(z) has gradient p - 1 where loss(-z) has p.
            slope = risk.gradient[0] + risk.gradient[1] - risk.x[1]
            curve = risk.curve[0] + risk.curve[1]
        else:
            # loss(z) - loss(-z) = -z: the positives add their mean alone.
            slope = risk.gradient[0] - prior * risk.x[1]
            curve = risk.curve[0]
        step = np.linalg.solve(curve + ridge, slope + ridge @ w)
        if prior is not None:
            # Where the step would make the risk on negatives negative, it goes along the border.
            falls = risk.gradient[0] - prior * risk.gradient[1]
            over = falls @ step - risk.negative(prior)
            if over > 0:
                aside = np.linalg.solve(curve + ridge, falls)
                step = step - over / (falls @ aside) * aside
        cut = 1.0
        while True:
            tried = w - cut * step
            risk = Risk(sides, tried)
            if prior is None or risk.negative(prior) >= -BORDER or cut < 0.05:
                break
            cut /= 2
        if prior is not None and risk.negative(prior) < -BORDER:
            break
        w = tried
        if np.abs(step).max() < 1e-2:
            break
    return w


def _score(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w, -60, 60)))


def _binned(w: np.ndarray):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BINS), dtype=np.int64)
        for batch in batches:
            bin_ = np.minimum((_score(_rows(batch), w) * BINS).astype(np.int64), BINS - 1)
            side = batch.column("side").to_numpy()
            for s in (0, 1):
                total[s] += np.bincount(bin_[side == s], minlength=BINS)
        at = np.flatnonzero(total.ravel())
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], ["k", "n"])

    return of


def estimate_prior(sides: DataFrame, w: np.ndarray, least: float = 0.3) -> float:
    """The smallest ratio of all texts to positives above a score, among scores above which at
    least a share of ``least`` of the positives lies. At most 2 * BINS counts reach the driver."""
    counts = np.zeros(2 * BINS)
    for r in sides.mapInArrow(_binned(w), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        counts[r["k"]] = r["n"]
    both = counts.reshape(2, BINS)[:, ::-1].cumsum(axis=1)
    if not both[:, -1].all():
        return 0.5
    share = both / both[:, -1:]
    # Small counts stray, and the smallest of many ratios strays downwards: two standard errors.
    some = share[1] >= least
    error = 2 * np.sqrt(share * (1 - share) / both[:, -1:])
    ratio = (share[0] + error[0])[some] / np.maximum(share[1] - error[1], 1e-3)[some]
    return float(np.clip(ratio.min(), 0.01, 0.99))


def _scored(w: np.ndarray, threshold: float):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = _score(_rows(batch), w)
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    return of


def classify(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.7, folds: int = 4, held: int = 2, id_col: str = "doc_id",
    text_col: str = "text", label_col: str = "quality",
) -> DataFrame:
    """One row per document: doc_id, held_out, score and predicted.

    Learns from rows of ``labels`` with label 1 and crc32(id as text) mod ``folds`` other than
    ``held``; other labels, and those of documents that are not there, are not used, and a document
    that has both labels is not trusted. A null id is
    the empty text and has no label. A null text is empty; texts without words share one score.
    Repeated rows are scored alike. Without positives every score is the prior 0.5 of a model
    that has seen nothing. Other columns of both tables are not read.
    """
    on_workers(docs.sparkSession)
    held_out = (crc_rest("doc_id", folds) == held).alias("held_out")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = own.select("doc_id", held_out, "text").mapInArrow(_featured, "doc_id long, held_out boolean, x array<float>")
    rows = stored(rows, "features")
    trusted = labels.groupBy(F.col("doc_id").alias("id")).agg(F.min(label_col).alias("low"), F.max(label_col).alias("high"))
    trusted = trusted.where("low = 1 AND high = 1").select("id")
    positives = rows.where(~F.col("held_out")).join(trusted, rows["doc_id"] == F.col("id"), "left_semi")
    positives = stored(positives.select("x"), "positives")
    if positives.isEmpty():
        w = np.zeros(WIDTH)
    else:
        both = rows.select(F.lit(0).alias("side"), "x").unionByName(positives.select(F.lit(1).alias("side"), "x"))
        w = fit(both, estimate_prior(both, fit(both, None)))
    return rows.mapInArrow(_scored(w, threshold), "doc_id long, held_out boolean, score double, predicted int")
