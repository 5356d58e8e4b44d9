"""Quality rules with host-level verdicts.

Every document is measured and held against rules. Hard rules reject it outright. Soft rules
are limits on averages, which good documents exceed now and then and bad ones by far: how often
a document has the worst of them is its excess (1 is the limit, 2 twice the limit). Failures of
any rule are summed by host, and the host's rate is shrunk towards the rate of all documents by
a beta prior, whose strength is fitted to how far hosts' rates lie apart beyond what chance
alone makes of their few documents. The verdict, a tolerance, is joined back to documents: an
average host's documents may exceed a limit ``TOLERANCE`` times, those of a host that fails
twice as often half as much, down to the limit itself, those of a better host more, up to twice
that. A document within all limits stays whatever its host.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from llm.rows import on_workers, smaller, spans, stored, unwrapped, wrapped
from llm.text import texts_of

SYMBOLS = b"#*$%&|<>"
FOLLOWING = bytes(range(0x80, 0xC0))  # bytes of a character behind its first
WINDOW = 8
TOLERANCE = 2.0  # times the limit of a soft rule that an average host's documents may have
STRONGEST = 1e6
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def repeat_words(ids: np.ndarray, counts: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Per text: words in a window of ``width`` words that the text holds more than once.

    ``ids`` numbers the words of all texts one after the other. A hash finds the windows that
    may repeat; those are then compared word by word.
    """
    n = len(ids)
    out = np.zeros(len(counts), dtype=np.int64)
    windows = np.maximum(counts - width + 1, 0)
    if not windows.sum():
        return out
    at = spans(np.cumsum(counts) - counts, windows)
    text = np.repeat(np.arange(len(counts)), windows)
    values = _mixed(ids.astype(np.uint64) + np.uint64(1))
    full = np.zeros(n - width + 1, dtype=np.uint64)
    for k in range(width):
        full = full * ODD + values[k : n - width + 1 + k]
    key = _mixed(full[at] + _mixed(text.astype(np.uint64) * ODD))
    order = np.sort(key)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if not len(twice):
        return out
    place = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    maybe = np.flatnonzero(twice[place] == key)
    at, text = at[maybe], text[maybe]
    rows = np.column_stack([text, *(ids[at + k] for k in range(width))])
    rank = np.lexsort(rows.T[::-1])
    same = (rows[rank[1:]] == rows[rank[:-1]]).all(axis=1)
    repeated = np.zeros(len(at), dtype=bool)
    repeated[rank[1:]] |= same
    repeated[rank[:-1]] |= same
    covered = np.zeros(n + 1, dtype=np.int64)
    np.add.at(covered, at[repeated], 1)
    np.add.at(covered, at[repeated] + width, -1)
    covered = np.cumsum(covered[:-1]) > 0
    np.add.at(out, np.repeat(np.arange(len(counts)), counts), covered)
    return out


def measure(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The measures of whole texts, as arrays."""
    words = [t.split() for t in texts]
    counts = np.fromiter(map(len, words), np.int64, len(words))
    flat = pa.array([w for own in words for w in own], pa.binary()).dictionary_encode()
    lines = [[x for x in t.split(b"\n") if x.strip()] for t in texts]
    return {
        "n_words": counts,
        "word_chars": np.array([len(b"".join(w).translate(None, FOLLOWING)) for w in words], np.int64),
        "n_symbols": np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": np.array([len(x) - len(set(x)) for x in lines], np.int64),
        "n_repeat_words": repeat_words(flat.indices.to_numpy(zero_copy_only=False), counts),
    }


def _measured(text_col: str, keep_text: bool):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in smaller(batches, text_col):
            found = measure(texts_of(batch.column(text_col)))
            names = [n for n in batch.schema.names if keep_text or n != text_col]
            columns = [batch.column(n) for n in names] + [pa.array(x) for x in found.values()]
            yield pa.RecordBatch.from_arrays(columns, [*names, *(PREFIX + k for k in found)])

    return of


PREFIX = "_rules_"


def with_measures(docs: DataFrame, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` and the measures of the text, named ``_rules_<measure>``; a null text has none."""
    on_workers(docs.sparkSession)
    fields = [f for f in docs.schema.fields if keep_text or f.name != text_col]
    fields += [T.StructField(PREFIX + m, T.LongType()) for m in MEASURES]
    return docs.mapInArrow(_measured(text_col, keep_text), T.StructType(fields))


def hard_failure() -> Column:
    words, repeated = F.col(f"{PREFIX}n_words"), F.col(f"{PREFIX}n_repeat_words")
    return (words < 20) | (100 * repeated > 30 * words)


def excess() -> Column:
    """How often a document has the limit of its worst soft rule: words of 2 to 14 characters on
    average, one symbol in ten words, one repeated line in thirty words. 0 without words."""
    words = F.col(f"{PREFIX}n_words").cast("double")
    chars, symbols, lines = (F.col(PREFIX + m) for m in ("word_chars", "n_symbols", "n_dup_lines"))
    worst = F.greatest(2 * words / chars, chars / (14 * words), 10 * symbols / words, 30 * lines / words)
    return F.when(words > 0, worst).otherwise(0.0)


def soft_failure() -> Column:
    return excess() > 1


def host_verdicts(measured: DataFrame, source_col: str) -> DataFrame:
    """One row per host: host, n, host_rate (shrunk) and tolerance. A null host is one of its own.

    The prior's mean is the failure rate of all documents. Its strength, in documents, is that
    of the beta distribution whose variance is the hosts' own: the variance of their rates,
    weighted by documents, less what drawing each host's documents by chance adds. Hosts no
    further apart than chance makes them get the prior (``STRONGEST``); the least strength is 1.
    """
    failed = F.when(hard_failure() | soft_failure(), 1).otherwise(0)
    hosts = measured.groupBy(F.col(source_col).alias("host")).agg(
        F.count("*").alias("n"), F.sum(failed).cast("long").alias("failures")
    )
    hosts = stored(hosts, "hosts")
    all_rows = hosts.agg(F.sum("n").alias("n"), F.sum("failures").alias("f"), F.count("*").alias("hosts")).first()
    total = all_rows["n"] or 0
    mean = (all_rows["f"] or 0) / total if total else 0.0
    apart = F.col("failures") / F.col("n") - F.lit(mean)
    spread = (hosts.agg(F.sum(F.col("n") * apart * apart)).first()[0] or 0.0) / max(1, total)
    chance = mean * (1 - mean) * all_rows["hosts"] / max(1, total)
    own = spread - chance
    strength = min(STRONGEST, max(1.0, mean * (1 - mean) / own - 1)) if own > 0 else STRONGEST
    rate = (F.lit(mean * strength) + F.col("failures")) / (F.lit(strength) + F.col("n"))
    ratio = F.when(rate > 0, TOLERANCE * F.lit(mean) / rate).otherwise(2 * TOLERANCE)
    tolerance = F.least(F.lit(2 * TOLERANCE), F.greatest(F.lit(1.0), ratio))
    return stored(hosts.select("host", "n", rate.alias("host_rate"), tolerance.alias("tolerance")), "host-verdicts")


def _decided(measured: DataFrame, hosts: DataFrame, source_col: str) -> DataFrame:
    verdicts = hosts.select(F.col("host").alias("_rules_host"), F.col("tolerance").alias("_rules_tolerance"))
    joined = measured.join(verdicts, F.col(f"`{source_col}`").eqNullSafe(F.col("_rules_host")), "left")
    kept = ~hard_failure() & (excess() <= F.col("_rules_tolerance"))
    return joined.withColumn("_rules_failed", hard_failure()).withColumn("_rules_kept", kept)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, the measures, base_failed (a hard rule), kept, and what the
    verdict came from: excess of the worst soft rule, and its host's tolerance and rate.

    A null or empty text has no words and fails; null ids and repeated rows are kept as they
    are, each judged alike. Other columns are not read. An empty table gives no rows.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    measured = stored(with_measures(own, keep_text=False), "measures")
    decided = _decided(measured, host_verdicts(measured, "source"), "source")
    names = [F.col(PREFIX + m).alias(m) for m in MEASURES]
    return decided.select(
        "doc_id", *names, F.col("_rules_failed").alias("base_failed"), F.col("_rules_kept").alias("kept"),
        excess().alias("excess"), F.col("_rules_tolerance").alias("tolerance"))


def keep(docs: DataFrame, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents that stay, with the columns of ``docs``.

    Texts are measured once and stored beside their measures; what is joined to them is a row
    per host.
    """
    own = wrapped(docs, text_col).withColumn("source", F.col(f"doc.`{source_col}`"))
    measured = stored(with_measures(own), "measured-documents")
    decided = _decided(measured, host_verdicts(measured, "source"), "source")
    return unwrapped(decided.where("_rules_kept"), docs, text_col)
