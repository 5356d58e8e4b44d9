"""Remove passages that occur more than once in the corpus: repeated-phrase automata.

A window is ``WINDOW`` consecutive words of one text; a word goes if it lies in a window whose
words also start anywhere else. The steps, all of them over all texts:

1. Anchors. Of the ``GRAM``-word grams inside a window, the one with the least hash is its
   anchor. Equal windows have equal anchors, and neighbouring windows mostly share theirs, so a
   text falls into runs of windows with one anchor. Runs are what travels, not windows: a few
   numbers each, among them a hash of the words that the run covers (its segment).
2. Candidates. A window can recur only if its anchor occurs twice; all other runs are dropped.
   Candidate runs with equal segments are counted and followed up once.
3. Confirmed windows. The windows of the distinct segments are hashed (128 bits) and their
   occurrences summed; those that occur twice are recurring passages. For each, one segment
   that holds it is named, and gives its words.
4. Automata. The confirmed windows are dealt by anchor into shards of bounded size. A shard's
   task numbers the words of its phrases, so that a word is one letter, compiles an
   Aho-Corasick automaton and streams the distinct segments of the shard's anchors through it.
   Every match is word for word, and every occurrence in a segment is found.
5. Cuts. Matches go back to all runs with that segment, and each text is cut once.

Hot groups: sums combine inside tasks; equal segments, of which a common passage has many, are
streamed once; a shard with many segments or patterns is split over several tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerwatch.session import scratch_path, scratch_table
from llm.rows import ROW, on_workers, parts_of, pieces_for, runs, smaller, spans, stored, wrapped
from llm.text import texts_of

WINDOW = 35
GRAM = 10
REACH = WINDOW - GRAM + 1  # grams in a window; also the most windows that a run may have
PATTERNS = 1_000  # windows of a shard
SEGMENTS = 5_000  # segments that one task streams through a shard's automaton
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Hashes:
    """Hashes of any stretches of a list of words, from sums of powers along the list."""

    def __init__(self, words: list[bytes], base: np.uint64 = BASES[0]):
        flat = pa.array(words, pa.binary()).dictionary_encode()
        own = [xxhash.xxh64_intdigest(w) for w in flat.dictionary.to_pylist()]
        value = np.array(own, dtype=np.uint64)[flat.indices.to_numpy(zero_copy_only=False)]
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(words), base)]))
        self.sums = np.concatenate([[np.uint64(0)], np.cumsum(value * power[:-1])])
        back = np.uint64(pow(int(base), -1, 1 << 64))
        self.back = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(words), back)]))

    def of(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return _mixed((self.sums[stop] - self.sums[start]) * self.back[start])


def _least_ahead(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[: len(x) - span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


RUN = "anchor long, segment long, row long, start int, windows int, weight int"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in smaller(batches, 1):
        words = [t.split() for t in texts_of(batch.column(1))]
        counts = np.fromiter(map(len, words), np.int64, len(words))
        keep = counts >= WINDOW
        if not keep.any():
            continue
        rows, counts = batch.column(0).to_numpy()[keep], counts[keep]
        hashes = Hashes([w for own, k in zip(words, keep) if k for w in own])
        total = int(counts.sum())
        at = np.arange(total - GRAM + 1)
        grams = hashes.of(at, at + GRAM)
        least = _least_ahead(grams, REACH)
        many = counts - WINDOW + 1
        first_word = np.cumsum(counts) - counts
        window = spans(first_word, many)
        text = np.repeat(np.arange(len(counts)), many)
        anchor = least[window]
        change = np.ones(len(anchor), dtype=bool)
        change[1:] = (anchor[1:] != anchor[:-1]) | (text[1:] != text[:-1])
        begin = np.flatnonzero(change)
        length = np.diff(np.append(begin, len(anchor)))
        # Runs over a text that repeats itself may be longer: cut them.
        pieces = -(-length // REACH)
        begin = spans(np.zeros(len(begin), np.int64), pieces) * REACH + np.repeat(begin, pieces)
        stop = np.append(begin[1:], len(anchor))
        length = stop - begin
        own = anchor[begin]
        ordered = np.sort(grams)
        twice = np.searchsorted(ordered, own, side="right") - np.searchsorted(ordered, own) > 1
        words_from = window[begin]
        segment = hashes.of(words_from, words_from + length + WINDOW - 1)
        columns = [
            pa.array(own.view(np.int64)), pa.array(segment.view(np.int64)), pa.array(rows[text[begin]]),
            pa.array((words_from - first_word[text[begin]]).astype(np.int32)), pa.array(length.astype(np.int32)),
            pa.array(np.where(twice, 2, 1).astype(np.int32)),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["anchor", "segment", "row", "start", "windows", "weight"])


SEGMENT = "anchor long, segment long, n long, phrase binary"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the segments of each text; ``parts``: anchor, segment, n, start, windows."""
    for batch in batches:
        out: list[tuple] = []
        for text, parts in zip(texts_of(batch.column("text")), batch.column("parts").to_pylist()):
            words = text.split()
            for p in parts:
                phrase = words[p["start"] : p["start"] + p["windows"] + WINDOW - 1]
                out.append((p["anchor"], p["segment"], p["n"], b" ".join(phrase)))
        yield pa.RecordBatch.from_arrays(
            [pa.array(x, k) for x, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            if out else [pa.array([], k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.binary())],
            ["anchor", "segment", "n", "phrase"],
        )


def _window_hashes(phrases: list[list[bytes]], bases: tuple = BASES) -> tuple[np.ndarray, ...]:
    """A hash by each base of every window of every phrase, and windows per phrase."""
    counts = np.fromiter(map(len, phrases), np.int64, len(phrases))
    words = [w for p in phrases for w in p]
    many = counts - WINDOW + 1
    at = spans(np.cumsum(counts) - counts, many)
    return *(Hashes(words, base).of(at, at + WINDOW).view(np.int64) for base in bases), many


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in smaller(batches, 2):
        one, two, many = _window_hashes([p.split(b" ") for p in batch.column(2).to_pylist()])
        # Equal windows of the batch are summed here; a window is named by its smallest segment.
        columns = [np.repeat(batch.column(k).to_numpy(), many) for k in (0, 1)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(one), pa.array(two), pa.array(columns[0]), pa.array(columns[1])], ["one", "two", "segment", "n"]
        )


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each phrase, where the confirmed windows (``ones``: their first hashes) start."""
    for batch in smaller(batches, 2):
        phrases = [p.split(b" ") for p in batch.column(2).to_pylist()]
        one, many = _window_hashes(phrases, BASES[:1])
        ends, one = np.cumsum(many).tolist(), one.tolist()
        starts = []
        for n, b, ones in zip(many.tolist(), ends, batch.column(3).to_pylist()):
            wanted = set(ones)
            starts.append([k for k, h in enumerate(one[b - n : b]) if h in wanted])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(starts, pa.list_(pa.int32()))],
            ["anchor", "segment", "phrase", "starts"],
        )


class Automaton:
    """Finds windows in phrases; a word that no pattern has is a letter that no pattern has.

    A state keeps its letters in a list, so an automaton should know few first words: shards
    are small.
    """

    def __init__(self):
        import ahocorasick

        self.found = ahocorasick.Automaton()
        self.letters: dict[bytes, str] = {}

    def _letter(self, word: bytes) -> str:
        letter = self.letters.get(word)
        if letter is None:
            code = len(self.letters) + 1
            letter = self.letters[word] = chr(code if code < 0xD800 else code + 0x800)
        return letter

    def add(self, phrase: bytes, starts: list[int]) -> None:
        spelled = "".join(map(self._letter, phrase.split(b" ")))
        for at in starts:
            self.found.add_word(spelled[at : at + WINDOW], True)

    def ready(self) -> None:
        self.found.make_automaton()

    def matches(self, phrase: bytes) -> list[int]:
        """Where windows start that the automaton holds."""
        if not len(self.found):
            return []
        known = self.letters.get
        spelled = "".join([known(w, "\0") for w in phrase.split(b" ")])
        return [last - WINDOW + 1 for last, _ in self.found.iter(spelled)]


def _located(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches of matched words in segments. Rows come by (shard, sub, salt), patterns first."""
    now, automaton, compiled = None, None, False
    for (shard, sub, salt, kind), rows in runs(batches, ["shard", "sub", "salt", "kind"]):
        if now != (shard, sub, salt):
            now, automaton, compiled = (shard, sub, salt), Automaton(), False
        phrases = rows.column("phrase").to_pylist()
        if kind == 0:
            for phrase, starts in zip(phrases, rows.column("starts").to_pylist()):
                automaton.add(phrase, starts)
            continue
        if not compiled:
            automaton.ready()
            compiled = True
        out = []
        for segment, phrase in zip(rows.column("segment").to_pylist(), phrases):
            begin = end = None
            for at in automaton.matches(phrase):
                if end is not None and at <= end:
                    end = at + WINDOW
                    continue
                if end is not None:
                    out.append((segment, begin, end))
                begin, end = at, at + WINDOW
            if end is not None:
                out.append((segment, begin, end))
        if out:
            kinds = (pa.int64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out), kinds)], ["segment", "first", "last"])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in smaller(batches, "text"):
        n_words, n_removed, kept = [], [], []
        for text, cuts in zip(texts_of(batch.column("text")), batch.column("cuts").to_pylist()):
            words = text.split()
            left, at = [], 0
            for cut in sorted((c["first"], c["last"]) for c in cuts or ()):
                left += words[at : cut[0]]
                at = max(at, cut[1])
            left += words[at:]
            n_words.append(len(words))
            n_removed.append(len(words) - len(left))
            kept.append(b" ".join(left))
        columns = [batch.column("doc"), batch.column("text"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())]
        columns.append(pa.array(kept, pa.binary()).cast(pa.string()))
        yield pa.RecordBatch.from_arrays(columns, ["doc", "text", "n_words", "n_removed", "kept"])


def bucketed(docs: DataFrame) -> DataFrame:
    """The rows, numbered and stored in buckets by number, so that later joins on it leave the
    texts where they are."""
    spark = docs.sparkSession
    parts = parts_of(spark)
    name = scratch_table("llm_rows")
    own = docs.withColumn(ROW, F.monotonically_increasing_id())
    writer = own.repartition(parts, ROW).write.format("parquet").option("compression", "zstd")
    writer.option("path", scratch_path(spark, "llm-rows")).bucketBy(parts, ROW).sortBy(ROW).saveAsTable(name)
    return spark.table(name)


def _by_row(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Texts of the numbered rows with their ``parts``."""
    texts = table.select(ROW, "text")
    return texts.join(rows, texts[ROW] == rows["row"]).select("text", "parts")


def repeated_stretches(table: DataFrame) -> DataFrame:
    """(row, cuts) of the numbered rows that hold repeated windows: stretches of word places."""
    spark = table.sparkSession
    found = stored(table.select(ROW, "text").mapInArrow(_runs, RUN), "runs")
    twice = found.groupBy("anchor").agg(F.sum("weight").alias("n")).where("n > 1").select("anchor")
    candidates = stored(found.drop("weight").join(stored(twice, "anchors"), "anchor", "left_semi"), "candidate-runs")
    place = F.min(F.struct("row", "start", "windows")).alias("place")
    distinct = candidates.groupBy("anchor", "segment").agg(F.count("*").alias("n"), place)
    part = F.struct("anchor", "segment", "n", F.col("place.start").alias("start"), F.col("place.windows").alias("windows"))
    wanted = distinct.groupBy(F.col("place.row").alias("row")).agg(F.collect_list(part).alias("parts"))
    segments = stored(_by_row(table, wanted).mapInArrow(_segments, SEGMENT), "segments")

    windows = segments.select("segment", "n", "phrase").mapInArrow(_windows, "one long, two long, segment long, n long")
    recurring = windows.groupBy("one", "two").agg(F.sum("n").alias("n"), F.min("segment").alias("segment")).where("n > 1")
    recurring = stored(recurring.groupBy("segment").agg(F.collect_list("one").alias("ones")), "recurring-windows")
    patterns = segments.join(recurring, "segment").select("anchor", "segment", "phrase", "ones")
    patterns = patterns.mapInArrow(_patterns, "anchor long, segment long, phrase binary, starts array<int>")
    patterns = stored(patterns, "patterns")

    count = patterns.agg(F.sum(F.size("starts"))).first()[0] or 0
    shard = F.pmod(F.xxhash64("anchor"), F.lit(pieces_for(count, PATTERNS))).cast("int").alias("shard")
    patterns = patterns.select(shard, "segment", "phrase", "starts")
    streamed = segments.select(shard, "segment", "phrase")
    by_shard = patterns.groupBy("shard").agg(F.ceil(F.sum(F.size("starts")) / (2 * PATTERNS)).cast("int").alias("subs"))
    streams = streamed.groupBy("shard").agg(F.ceil(F.count("*") / (2 * SEGMENTS)).cast("int").alias("salts"))
    cuts = stored(by_shard.join(streams, "shard"), "shards")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    deal = lambda n: F.pmod(F.xxhash64("segment"), F.col(n)).cast("int")
    index = patterns.join(cuts, "shard").withColumn("sub", deal("subs")).withColumn("salt", every("salts"))
    stream = streamed.join(cuts, "shard").withColumn("salt", deal("salts")).withColumn("sub", every("subs"))
    names = ["shard", "sub", "salt", "kind", "segment", "phrase", "starts"]
    both = index.withColumn("kind", F.lit(0)).select(*names).unionByName(
        stream.withColumn("kind", F.lit(1)).withColumn("starts", F.lit(None).cast("array<int>")).select(*names)
    )
    dealt = both.repartition(parts_of(spark), "shard", "sub", "salt").sortWithinPartitions("shard", "sub", "salt", "kind")
    matches = stored(dealt.mapInArrow(_located, "segment long, first int, last int"), "matches")

    stretch = F.struct((F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("last")).alias("last"))
    back = candidates.select("segment", "row", "start").join(matches, "segment")
    return back.groupBy("row").agg(F.collect_set(stretch).alias("cuts"))


def _removed(docs: DataFrame, text_col: str) -> DataFrame:
    """``doc`` and ``text`` of all rows, with n_words, n_removed and the words that are kept."""
    on_workers(docs.sparkSession)
    table = bucketed(wrapped(docs, text_col))
    cuts = repeated_stretches(table)
    joined = table.join(cuts, table[ROW] == cuts["row"], "left").select("doc", "text", "cuts")
    added = T.StructType().add("n_words", "long").add("n_removed", "long").add("kept", "string")
    schema = T.StructType([*joined.select("doc", "text").schema.fields, *added.fields])
    return joined.mapInArrow(_cut, schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the other words, joined by a space).

    Windows are judged on the texts as given. A null text has no words; texts shorter than a
    window lose none; of texts with the same words, repeated rows included, every one loses all
    of them. A text that repeats a window inside itself loses both. Null ids are kept.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    cut = _removed(own, "text")
    return cut.select("doc.doc_id", "n_words", "n_removed", "kept")


def without_repeats(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """``docs`` with repeated passages cut out of the text. A text that loses nothing stays as it
    is; of the others the kept words are joined by a space and ``length_col`` counts anew."""
    cut = _removed(docs, text_col)
    changed = F.col("n_removed") > 0
    columns = []
    for name in docs.columns:
        column = F.col(f"doc.`{name}`") if name != text_col else F.col("text")
        if name == text_col:
            column = F.when(changed, F.col("kept")).otherwise(column)
        elif name == length_col:
            column = F.when(changed, F.length("kept")).otherwise(column).cast(docs.schema[name].dataType)
        columns.append(column.alias(name))
    return cut.select(*columns)
