"""Periodic runs of words: where they lie, and texts with every run cut to its first period.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and
a length of at least ``least`` and 2 * q, that no neighbouring word extends keeping period q.

1. *Where runs can be.* Of a run of at least ``least`` words, more than half of its positions
   match the position one period on, so every word of it lies in a stretch of (``least`` + 1) // 2
   words that occurs again in the same text. Only what such stretches cover is looked at; a hash
   that collides makes that more, never less.
2. *Lyndon words.* Grouping, the first phase of Baier's suffix sorter, puts suffixes into groups
   by their longest Lyndon prefix, from the largest group down: a suffix of the group at hand is
   taken out and its left neighbour among those still in takes the group's word over, once or
   several times, and moves to a new group right above its own. What lies between a suffix and
   its right neighbour when it is taken out is the longest Lyndon word that begins there, so this
   phase alone gives the Lyndon array. It is done under the order of the words and its reverse.
3. *Runs.* Every run has as its period's length the longest Lyndon word of some place in it, under
   one of the two orders. Each word found is extended to both sides by the longest common
   extension of the places a period apart (polynomial hashes, binary search), all at once; every
   run found is then compared word by word, and extended plainly where hashes were wrong.

All steps take time in proportion to a text's words, but for the binary search and a sort.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.rows import on_workers, smaller, spans
from llm.text import texts_of

BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
BACK = pow(BASE, -1, 2**64)
RUN = "struct<start:bigint,length:bigint,period:bigint>"


def lyndon_lengths(symbols: np.ndarray) -> np.ndarray:
    """Length of the longest Lyndon word that begins at each place.

    ``symbols`` are whole numbers with 0 at both ends and wherever a stretch ends; words do not
    reach over a 0.
    """
    n = len(symbols)
    order = np.argsort(symbols, kind="stable")
    sorted_ = symbols[order]
    begin = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1]]))
    members = [part.tolist() for part in np.split(order, begin[1:])]
    ranks = np.empty(n, dtype=np.int64)
    ranks[order] = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, n)))
    group = ranks.tolist()
    below, above = list(range(-1, len(members) - 1)), list(range(1, len(members) + 1))
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    lengths = [0] * n
    now = len(members) - 1
    while now:
        taken: dict[int, int] = {}  # left neighbours, and how often each takes the word over
        for i in members[now]:
            if group[i] == now:
                a, b = left[i], right[i]
                lengths[i] = b - i
                right[a], left[b] = b, a
                taken[a] = taken.get(a, 0) + 1
        moved: dict[tuple[int, int], list[int]] = {}
        for i, times in taken.items():
            if group[i]:
                moved.setdefault((group[i], -times), []).append(i)
        # Of one group's suffixes those that took the word over more often are larger.
        for old, times in sorted(moved) if len(moved) > 1 else moved:
            new, over = len(members), above[old]
            own = moved[old, times]
            members.append(own)
            below.append(old)
            above.append(over)
            above[old], below[over] = new, new
            for i in own:
                group[i] = new
        now = below[now]
    return np.array(lengths, dtype=np.int64)


def _hashes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``values`` times powers of BASE, and the powers, modulo 2**64."""
    powers = np.full(len(values) + 1, BASE, dtype=np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers[:-1], out=sums[1:])
    return sums, powers


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _common(a: np.ndarray, b: np.ndarray, sums: np.ndarray, powers: np.ndarray, most: int, step: int) -> np.ndarray:
    """How many symbols from places ``a`` < ``b`` on are alike, forwards (step 1) or back from
    just before them (step -1)."""
    found = np.zeros(len(a), dtype=np.int64)
    shift = powers[b - a]
    size = 1 << max(0, int(most).bit_length() - 1)
    n = len(sums) - 1
    while size:
        x, y = a + step * found, b + step * found
        if step < 0:
            x, y = x - size, y - size
        inside = (x >= 0) & (y + size <= n)
        x, y = np.where(inside, x, 0), np.where(inside, y, 0)
        # Places outside compare as (0, 0) of size 0.
        width = np.where(inside, size, 0)
        same = (sums[x + width] - sums[x]) * shift == sums[y + width] - sums[y]
        found += np.where(inside & same, size, 0)
        size >>= 1
    return found


def runs_in(symbols: np.ndarray, least: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all runs, by start, then period. ``symbols`` as above."""
    n = len(symbols)
    place = np.arange(n)
    ends = symbols == 0
    values = _mixed(symbols.astype(np.uint64))
    values[ends] = _mixed(place[ends].astype(np.uint64) + np.uint64(1 << 40))  # alike with nothing
    sums, powers = _hashes(values)
    longest = int(np.diff(np.flatnonzero(ends)).max(initial=1))
    keys = []
    for order in (symbols, np.where(ends, 0, symbols.max(initial=0) + 1 - symbols)):
        period = lyndon_lengths(order)
        own = np.flatnonzero(~ends)
        period = period[own]
        ahead = own + period
        near = (symbols[own] == symbols[ahead]) | ((symbols[own - 1] == symbols[ahead - 1]) & ~ends[own - 1])
        own, ahead, period = own[near], ahead[near], period[near]
        more = _common(own, ahead, sums, powers, longest, 1)
        back = _common(own, ahead, sums, powers, longest, -1)
        length = back + period + more
        good = length >= np.maximum(least, 2 * period)
        keys.append(np.stack([own[good] - back[good], period[good], length[good]]))
    start, period, length = np.unique(np.concatenate(keys, axis=1), axis=1)
    match = spans(start, length - period)
    wrong = symbols[match] != symbols[match + np.repeat(period, length - period)]
    if wrong.any():  # a hash was wrong: plain extension from where the Lyndon words lie
        return _plainly(symbols, least)
    return start, length, period


def _plainly(symbols: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found = set()
    ends = symbols == 0
    for order in (symbols, np.where(ends, 0, symbols.max() + 1 - symbols)):
        for i, p in enumerate(lyndon_lengths(order).tolist()):
            if p:
                a, b = i, i + p
                while symbols[b] and symbols[b] == symbols[b - p]:
                    b += 1
                while symbols[a - 1] and symbols[a - 1] == symbols[a - 1 + p]:
                    a -= 1
                if b - a >= max(least, 2 * p):
                    found.add((a, p, b - a))
    columns = np.array(sorted(found), dtype=np.int64).reshape(-1, 3).T
    return columns[0], columns[2], columns[1]


def runs_of_texts(words: list[list[bytes]], least: int = 12) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of the runs of all texts, by text, start and period."""
    none = (np.zeros(0, dtype=np.int64),) * 4
    counts = np.fromiter(map(len, words), np.int64, len(words))
    gram = max(1, (least + 1) // 2)
    if not (counts >= least).any():
        return none
    flat = pa.array([w for own in words for w in own], pa.binary()).dictionary_encode().indices
    ids = flat.to_numpy(zero_copy_only=False).astype(np.int64) + 1
    stop = np.cumsum(counts)
    # Stretches of ``gram`` words that occur again in their text.
    sums, _ = _hashes(_mixed(ids.astype(np.uint64)))
    each = np.where(counts >= least, counts - gram + 1, 0)
    at = spans(stop - counts, each)
    text = np.repeat(np.arange(len(words)), each)
    inverse = np.full(len(ids) + 1, BACK, dtype=np.uint64)
    inverse[0] = 1
    hashes = (sums[at + gram] - sums[at]) * np.cumprod(inverse)[at]
    hashes = _mixed(hashes ^ _mixed(text.astype(np.uint64)))
    order = np.argsort(hashes)
    hashes = hashes[order]
    same = np.flatnonzero(hashes[1:] == hashes[:-1])
    if not len(same):
        return none
    again = at[np.union1d(order[same], order[same + 1])]
    edge = np.zeros(len(ids) + 1, dtype=np.int64)
    np.add.at(edge, again, 1)
    np.add.at(edge, again + gram, -1)
    covered = np.cumsum(edge[:-1]) > 0
    # Covered stretches, cut where texts end, each followed by a 0.
    own = np.flatnonzero(covered)
    text = np.searchsorted(stop, own, side="right")
    first = np.concatenate([[True], (own[1:] != own[:-1] + 1) | (text[1:] != text[:-1])])
    symbols = np.zeros(len(own) + int(first.sum()) + 1, dtype=np.int64)
    place = np.arange(len(own)) + np.cumsum(first)
    symbols[place] = np.unique(ids[own], return_inverse=True)[1] + 1
    start, length, period = runs_in(symbols, least)
    found = np.searchsorted(place, start)
    return text[found], own[found] - (stop - counts)[text[found]], length, period


def _collapsed(least: int, prepare: Callable[[object, list[bytes]], list[bytes]] | None):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in smaller(batches, "text"):
            words = [t.split() for t in texts_of(batch.column("text"))]
            if prepare:
                words = [prepare(i, w) for i, w in zip(batch.column("id").to_pylist(), words)]
            text, start, length, period = runs_of_texts(words, least)
            bounds = np.searchsorted(text, np.arange(len(words) + 1))
            kept = list(words)
            for t in np.unique(text).tolist():
                own = slice(bounds[t], bounds[t + 1])
                dropped = np.zeros(len(words[t]), dtype=bool)
                dropped[spans(start[own] + period[own], length[own] - period[own])] = True
                kept[t] = [w for w, gone in zip(words[t], dropped.tolist()) if not gone]
            runs = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], ["start", "length", "period"])
            columns = [
                batch.column("id"), pa.array(np.fromiter(map(len, words), np.int64, len(words))),
                pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), runs),
                pa.array([b" ".join(k) for k in kept], pa.binary()).cast(pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_words", "runs", "collapsed"])

    return of


def collapse_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: int = 12,
    prepare: Callable[[object, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """One row per document: doc_id, n_words, runs (start, length, period; by start, then period)
    and collapsed, the words that no run drops, joined by single spaces.

    A run drops all its words but its first ``period``. ``prepare(id, words)``, if given, may
    change a document's words before. A null text has no words. Ids may be null or repeated; every
    row is judged alone, so no column but these two is read and no row meets another. Texts of
    any length are taken whole.
    """
    on_workers(docs.sparkSession)
    own = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    kind = own.schema["id"].dataType.simpleString()
    out = own.mapInArrow(_collapsed(least, prepare), f"id {kind}, n_words long, runs array<{RUN}>, collapsed string")
    return out.select(F.col("id").alias("doc_id"), "n_words", "runs", "collapsed")


def run_digest(runs: DataFrame) -> DataFrame:
    """Columns that stand for the runs and the text of ``collapse_runs``: how many runs, the
    longest one (ties: smallest start, then period) and hashes of all."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    length, period = F.col("best.length"), -F.col("best.period")
    return runs.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.concat(F.lit(""), F.array_join(lines, "")).cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
