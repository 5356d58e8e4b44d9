"""Language-model scores by deleted interpolation of bigrams.

The probability of a word after another mixes three estimates: the bigram's relative frequency,
the word's relative frequency, and an even share for every known word and one unknown one. The
mixture weights depend on how often the context word was seen (one bucket per power of two),
and are learned by expectation-maximisation on counts of a part of the learning texts that the
frequencies leave out. Then frequencies are taken from all learning texts.

Words and bigrams are counted over all texts and each text needs the counts of its own, which
is far more data than one machine holds. Texts are dealt into chunks by a hash of their row. A
chunk sends each of its distinct words and bigrams once to the task that its hash names, as
sorted, packed arrays with its counts; that task adds up what the chunks sent and answers every
chunk in the order of its question. A chunk then has all counts for its texts. A word pair that
a third of all texts hold is one number per chunk. Words are known by 64-bit hashes, bigrams by
56-bit ones; equal hashes share their counts.

For the weights, the held-out tokens are summed by context bucket and by their two frequencies,
rounded to a quarter of an octave: a bounded table, which the driver fits.
"""

from __future__ import annotations

from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerwatch.session import scratch_path, scratch_table
from llm.rows import crc_rest, on_workers, parts_of, stored
from llm.text import texts_of

WORD, PAIR = 1, 2
PAIR_BITS = 56
END = b" "  # no word holds a space
BUCKETS = 48
STEPS_AN_OCTAVE = 4
NEVER = 1  # stands for the logarithm of a frequency of zero: true ones are not positive
ROUNDS = 50


def pack(x: np.ndarray) -> bytes:
    """Whole numbers by byte planes, those that are zero throughout left out."""
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T)
    used = max((k + 1 for k in range(8) if len(x) and planes[k].any()), default=0)
    return len(x).to_bytes(7, "little") + bytes([used]) + planes[:used].tobytes()


def unpack(data: bytes) -> np.ndarray:
    n, used = int.from_bytes(data[:7], "little"), data[7]
    planes = np.zeros((8, n), dtype=np.uint8)
    planes[:used] = np.frombuffer(data, dtype=np.uint8, offset=8).reshape(used, n)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Tokens:
    """The tokens of a chunk's texts: numbers of their words and of the words before, hashes of
    the distinct words, and hashes of the pairs."""

    def __init__(self, texts: list[bytes]):
        words = [t.lower().split() for t in texts]
        for own in words:
            own.append(END)
        self.counts = np.fromiter(map(len, words), np.int64, len(words))
        flat = pa.array(list(chain.from_iterable(words)), pa.binary()).dictionary_encode()
        self.word = flat.indices.to_numpy(zero_copy_only=False)
        self.digests = np.array([xxhash.xxh64_intdigest(w) for w in flat.dictionary.to_pylist()], dtype=np.uint64)
        self.text = np.repeat(np.arange(len(texts)), self.counts)
        # The word before; a text's first word follows an end.
        self.before = np.concatenate([self.word[-1:], self.word[:-1]])
        self.before[np.cumsum(self.counts) - self.counts] = self.word[-1]
        mixed = _mixed(self.digests) * np.uint64(0x9E3779B97F4A7C15)
        self.pair = _mixed(mixed[self.before] + self.digests[self.word]) >> np.uint64(64 - PAIR_BITS)


def _bounds(keys: np.ndarray, bits: int, parts: int) -> list[int]:
    """Where the keys of each part begin: parts are equal ranges of the hashes, so that sorted
    keys come part by part."""
    part = ((keys >> np.uint64(bits - 32)) * np.uint64(parts)) >> np.uint64(32)
    return [0, *np.cumsum(np.bincount(part.astype(np.int64), minlength=parts)).tolist()]


QUESTION = "kind int, part int, chunk long, keys binary, kept binary, held binary"


def _questions(parts: int):
    def of(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        tokens = Tokens(texts_of(_plain(table.column("text"))))
        fold = table.column("fold").to_numpy()[tokens.text]
        chunk = table.column("chunk")[0].as_py()
        # 0 takes no part, 1 is for the weights, 2 for the first counts.
        role = np.minimum(fold, 2).astype(np.uint64)
        order = np.argsort(tokens.digests)
        words = [np.bincount(tokens.word[role == k], minlength=len(order))[order] for k in (2, 1)]
        both = np.sort((tokens.pair << np.uint64(2)) | role)
        pairs = both >> np.uint64(2)
        begin = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
        sums = [np.add.reduceat((both & np.uint64(3)) == np.uint64(k), begin, dtype=np.int64) for k in (2, 1)]
        out: list[tuple] = []
        for kind, keys, bits, (kept, held) in (
            (WORD, tokens.digests[order], 64, words), (PAIR, pairs[begin], PAIR_BITS, sums),
        ):
            bounds = _bounds(keys, bits, parts)
            for part, (a, b) in enumerate(zip(bounds, bounds[1:])):
                if b > a:
                    out.append((kind, part, chunk, pack_sorted(keys[a:b]), pack(kept[a:b]), pack(held[a:b])))
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        columns = zip(*out) if out else [[]] * 6
        return pa.table([pa.array(x, k) for x, k in zip(columns, kinds)], names=["kind", "part", "chunk", "keys", "kept", "held"])

    return of


def _plain(column: pa.ChunkedArray) -> pa.Array:
    joined = column.combine_chunks()
    return joined if isinstance(joined, pa.Array) else pa.concat_arrays(joined.chunks)


ANSWER = "chunk long, kind int, part int, kept binary, full binary, sums array<long>"


def _answers(table: pa.Table) -> pa.Table:
    """Sums over all chunks, for each chunk in the order of its keys: ``full`` over all learning
    texts, and ``kept`` without those for the weights, for the keys that the chunk has in texts
    for the weights. Under chunk -1: how many keys and tokens this part has, in either."""
    kind, part = table.column("kind")[0].as_py(), table.column("part")[0].as_py()
    asked = [unpack_sorted(x) for x in table.column("keys").to_pylist()]
    keys, place = np.unique(np.concatenate(asked), return_inverse=True)
    kept = np.zeros(len(keys), dtype=np.int64)
    held = np.zeros(len(keys), dtype=np.int64)
    for sums, name in ((kept, "kept"), (held, "held")):
        sent = np.concatenate([unpack(x) for x in table.column(name).to_pylist()]).astype(np.int64)
        np.add.at(sums, place, sent)
    full = kept + held
    ends = np.cumsum([len(x) for x in asked]).tolist()
    own = [place[b - len(x) : b] for x, b in zip(asked, ends)]
    in_held = [place[b - len(x) : b][sent[b - len(x) : b] > 0] for x, b in zip(asked, ends)]
    chunks = [*table.column("chunk").to_pylist(), -1]
    totals = [int((kept > 0).sum()), int(kept.sum()), int((full > 0).sum()), int(full.sum())]
    return pa.table(
        {
            "chunk": pa.array(chunks, pa.int64()),
            "kind": pa.array([kind] * len(chunks), pa.int32()),
            "part": pa.array([part] * len(chunks), pa.int32()),
            "kept": pa.array([*(pack(kept[x]) for x in in_held), None], pa.binary()),
            "full": pa.array([*(pack(full[x]) for x in own), None], pa.binary()),
            "sums": pa.array([*[None] * len(own), totals], pa.list_(pa.int64())),
        }
    )


def _counts(tokens: Tokens, answers: pa.Table, which: str) -> tuple[np.ndarray, ...]:
    """Per token: counts of its pair, its context and its word."""
    by: dict[int, list[tuple[int, np.ndarray]]] = {WORD: [], PAIR: []}
    for kind, part, data in zip(*(answers.column(c).to_pylist() for c in ("kind", "part", which))):
        by[kind].append((part, unpack(data)))
    words, pairs = (np.concatenate([c for _, c in sorted(by[k], key=lambda x: x[0])]).astype(np.int64) for k in (WORD, PAIR))
    count = np.empty(len(words), dtype=np.int64)
    count[np.argsort(tokens.digests)] = words
    order = np.argsort(tokens.pair)
    ascending = tokens.pair[order]
    begin = np.flatnonzero(np.concatenate([[True], ascending[1:] != ascending[:-1]]))
    pair = np.empty(len(order), dtype=np.int64)
    pair[order] = np.repeat(pairs, np.diff(np.append(begin, len(order))))
    return pair, count[tokens.before], count[tokens.word]


def _bucket(context: np.ndarray) -> np.ndarray:
    """0 for unseen contexts, then one bucket per power of two."""
    return np.minimum(np.frexp(context.astype(np.float64))[1], BUCKETS - 1)


def _step(frequency: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        steps = np.round(STEPS_AN_OCTAVE * np.log2(frequency))
    return np.where(frequency > 0, steps, NEVER).astype(np.int64)


def _estimates(pair: np.ndarray, context: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.where(context > 0, pair / np.maximum(context, 1), 0.0), word / max(n, 1)


def _cells(n_kept: int):
    def of(texts: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["bucket", "pair", "word", "n"]
        texts = texts.filter(pc.equal(texts.column("fold"), 1))
        if not texts.num_rows:
            return pa.table([pa.array([], pa.int64())] * 4, names=names)
        pair, context, word = _counts(Tokens(texts_of(_plain(texts.column("text")))), answers, "kept")
        by_pair, by_word = _estimates(pair, context, word, n_kept)
        rows = np.column_stack([_bucket(context), _step(by_pair), _step(by_word)])
        cells, n = np.unique(rows, axis=0, return_counts=True)
        return pa.table([*(pa.array(c) for c in cells.T), pa.array(n.astype(np.int64))], names=names)

    return of


def fit_weights(cells: list[tuple[int, int, int, int]], even: float, rounds: int = ROUNDS) -> np.ndarray:
    """Mixture weights of pair, word and even share per bucket, by expectation-maximisation.

    ``cells``: bucket, steps of the two frequencies, how many held-out tokens. A bucket starts
    from even weights (none for a frequency that is zero throughout) plus one token's worth.
    """
    weights = np.tile(np.array([1.0, 1.0, 1.0]) / 3, (BUCKETS, 1))
    weights[0] = (0.0, 0.5, 0.5)  # an unseen context has no pairs
    table = np.array(cells, dtype=np.int64).reshape(-1, 4)
    for bucket in range(BUCKETS):
        own = table[table[:, 0] == bucket]
        if not len(own):
            continue
        n = own[:, 3].astype(float)
        p = np.column_stack(
            [*(np.where(own[:, k] == NEVER, 0.0, 2.0 ** (own[:, k] / STEPS_AN_OCTAVE)) for k in (1, 2)), np.full(len(own), even)]
        )
        w = weights[bucket]
        prior = w.copy()
        for _ in range(rounds):
            share = p * w
            share /= share.sum(axis=1, keepdims=True)
            w = prior + (share * n[:, None]).sum(axis=0)
            w = w / w.sum()
        weights[bucket] = w
    return weights


SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scores(n: int, v: int, weights: np.ndarray):
    def of(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return _score_schema.empty_table()
        tokens = Tokens(texts_of(_plain(texts.column("text"))))
        pair, context, word = _counts(tokens, answers, "full")
        by_pair, by_word = _estimates(pair, context, word, n)
        w = weights[_bucket(context)]
        mixed = w[:, 0] * by_pair + w[:, 1] * by_word + w[:, 2] / (v + 1)
        base = np.log10((word + 0.1) / (n + 0.1 * (v + 1)))
        many = texts.num_rows
        add = lambda x: np.bincount(tokens.text, weights=x, minlength=many)
        return pa.table(
            [
                _plain(texts.column("doc_id")), pa.array(texts.column("fold").to_numpy() == 0), pa.array(tokens.counts),
                pa.array(add(word > 0).astype(np.int64)), pa.array(np.full(many, n, np.int64)), pa.array(add(base)), pa.array(add(np.log10(mixed))),
            ],
            schema=_score_schema,
        )

    return of


_score_schema = pa.schema(
    [
        ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
        ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()),
    ]
)


def _labels(spark: SparkSession, parts: int) -> list[int]:
    """Chunk numbers that Spark's hash deals to ``parts`` different partitions."""
    labels = spark.range(0, 40 * parts, 1, 1).groupBy(F.pmod(F.hash("id"), F.lit(parts)).alias("at"))
    return [r["id"] for r in labels.agg(F.min("id").alias("id")).collect()]


def _chunked(docs: DataFrame, parts: int) -> DataFrame:
    """Texts with their chunk, stored in buckets by chunk: later steps read them in place."""
    labels = F.array(*[F.lit(x).cast("long") for x in _labels(docs.sparkSession, parts)])
    deal = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.size(labels)).cast("int")
    own = docs.withColumn("chunk", F.get(labels, deal))
    name = scratch_table("llm_chunks")
    writer = own.repartition(parts, "chunk").write.format("parquet").option("compression", "zstd")
    path = scratch_path(docs.sparkSession, "llm-chunks")
    writer.option("path", path).bucketBy(parts, "chunk").sortBy("chunk").saveAsTable(name)
    return docs.sparkSession.table(name)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A document's fold is crc32 of its id as text modulo ``folds``. Fold 0 is held out from
    everything, fold 1 serves for the mixture weights and then for the counts as well, the
    others for both. A null id is the empty text, which is fold 0. A null or empty text is its
    end alone. Repeated rows count as often as they stand there. Without learning texts all
    tokens are unknown. Other columns are not read.
    """
    spark = docs.sparkSession
    on_workers(spark)
    parts = parts_of(spark)
    fold = crc_rest("doc_id", folds).cast("long").alias("fold")
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    texts = _chunked(own.select("doc_id", "text", fold), parts)
    questions = texts.groupBy("chunk").applyInArrow(_questions(parts), QUESTION)
    answers = stored(questions.groupBy("kind", "part").applyInArrow(_answers, ANSWER), "counts")
    # One row a part.
    sums = answers.where(f"chunk = -1 AND kind = {WORD}").select("sums").collect()
    v_kept, n_kept, v, n = reduce(lambda a, b: [x + y for x, y in zip(a, b)], [r["sums"] for r in sums], [0] * 4)
    replies = answers.where("chunk >= 0").drop("sums")
    grouped = texts.groupBy("chunk").cogroup(replies.groupBy("chunk"))
    cells = grouped.applyInArrow(_cells(n_kept), "bucket long, pair long, word long, n long")
    table = cells.groupBy("bucket", "pair", "word").agg(F.sum("n").alias("n")).collect()
    weights = fit_weights([tuple(r) for r in table], 1.0 / (v_kept + 1))
    again = texts.groupBy("chunk").cogroup(replies.groupBy("chunk"))
    return again.applyInArrow(_scores(n, v, weights), SCORE)
