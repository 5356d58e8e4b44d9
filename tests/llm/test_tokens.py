import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from llm import packing, simple8b
from llm.queries import QUERIES
from llm.tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
PLAIN = Tokenizer.from_file(PATH)
ENCODER = Encoder(PATH)


def plain_ids(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab1,.'s \n\t é字😀<|>")), max_size=30), max_size=6))
def test_pieces_give_what_the_library_gives(texts):
    texts = [*texts, "<|endoftext|> a<|endoftext|>b", " it's  ours\n", None]
    ids, counts = ENCODER.encode(pa.array(texts, pa.string()))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [plain_ids(t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**60 - 1) | st.integers(0, 60_000) | st.integers(0, 3), max_size=600), max_size=5))
def test_coding_is_undone_by_decoding(documents):
    counts = np.array([len(d) for d in documents], dtype=np.int64)
    ids = np.array([x for d in documents for x in d], dtype=np.uint64)
    lengths, blocks = simple8b.block_lengths(counts)
    words, sizes = simple8b.encode_blocks(ids, lengths)
    assert blocks.sum() == len(lengths) == len(sizes) and sizes.sum() == len(words)
    assert (simple8b.decode_blocks(words, np.cumsum(sizes) - sizes, lengths) == ids).all()


def test_an_id_that_needs_a_word_of_its_own_escapes():
    words, _ = simple8b.encode_blocks(np.array([5, 2**59, 7], dtype=np.uint64), np.array([3]))
    assert [int(w >> np.uint64(60)) for w in words][1] == 0
    with pytest.raises(ValueError):
        simple8b.encode_blocks(np.array([2**61], dtype=np.uint64), np.array([1]))


def digest(ids):
    return zlib.crc32(np.array(ids, dtype="<u4"))


def expected_files(rows):
    coded = [(r[0], [*plain_ids(r[1]), 0]) for r in rows]
    coded.sort(key=lambda c: (c[0] is not None, c[0]))
    out, start = [], 0
    for doc, ids in coded:
        out.append((doc, start, len(ids), digest(ids)))
        start += len(ids)
    return out


def test_file_query_against_the_library(spark, sf_docs):
    rows = sf_docs(spark)
    got = [tuple(r) for r in QUERIES["op3_token_files"](spark, "/root/testdata/sf0.001").orderBy("start").collect()]
    assert got == expected_files(rows)


def test_files_of_odd_rows_in_many_parts(spark, documents, odd_rows, folder):
    rows = [*odd_rows, *[(7, f"copy {k} of a frequent id") for k in range(40)]]
    path = folder("ids")
    simple8b.write_ids(documents(rows), path, PATH, parts=6)
    got = simple8b.read_digests(spark, path).orderBy("start", "n_tokens").collect()
    assert [r.doc_id for r in got] == [e[0] for e in expected_files(rows)]
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()
    assert sorted((r.n_tokens, r.ids_crc32) for r in got) == sorted(e[2:] for e in expected_files(rows))
    ids = {r.doc_id: r.ids for r in simple8b.read_ids(spark, path).collect()}
    assert ids[5] == [*plain_ids(odd_rows[6][1]), 0]


def test_files_of_an_empty_table(spark, documents, folder):
    path = folder("ids")
    simple8b.write_ids(documents([]), path, PATH)
    assert simple8b.read_digests(spark, path).count() == 0


def check_packing(rows, placed, capacity):
    by_doc, sequences = {}, {}
    for r in placed:
        by_doc.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    wanted = {}
    for doc, text, *_ in rows:
        wanted.setdefault(doc, []).append([*plain_ids(text), 2])
    for doc, texts in wanted.items():
        pieces = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in by_doc.pop(doc))
        expect = []
        for ids in texts:
            first = (len(ids) - 1) % capacity + 1
            cuts = [0, *range(first, len(ids) + 1, capacity)]
            expect += [(k, a, b - a, digest(ids[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        assert pieces == sorted(expect)
    assert not by_doc
    return len(sequences)


def test_packing_query(spark, sf_docs):
    rows = sf_docs(spark)
    placed = QUERIES["op8_best_fit_packing"](spark, "/root/testdata/sf0.001").collect()
    used = check_packing(rows, placed, 1024)
    assert used <= 1.02 * sum(r.length for r in placed) / 1024 + 1


def test_packing_of_odd_rows(documents, odd_rows):
    check_packing(odd_rows, packing.pack(documents(odd_rows), PATH).collect(), 1024)
    assert packing.pack(documents([]), PATH).count() == 0


def test_packed_sequences_hold_the_ids(documents, odd_rows):
    placed = packing.pack(documents(odd_rows), PATH, capacity=64, keep_ids=True)
    check_packing(odd_rows, placed.collect(), 64)
    for row in packing.sequences(placed).collect():
        assert len(row.ids) // 4 == row.ends[-1] <= 64


def best_fit_decreasing(lengths, capacity):
    gaps = []
    for x in sorted(lengths, reverse=True):
        fitting = [g for g in gaps if g >= x]
        gap = min(fitting) if fitting else capacity
        if fitting:
            gaps.remove(gap)
        gaps.append(gap - x)
    return len(gaps)


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 12), max_size=20))
def test_plan_places_every_piece_once(counts):
    plan = packing.Plan(counts, 100)
    filled, ranks = {}, {}
    for length, rank, many, sequence, offset in plan.runs:
        for k in range(many):
            ranks.setdefault(length, []).append(rank + k)
            filled.setdefault(sequence + k, []).append((offset, length))
    assert {x: sorted(r) for x, r in ranks.items()} == {x: list(range(n)) for x, n in counts.items()}
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 100
    lengths = [x for x, n in counts.items() for _ in range(n)]
    assert len(filled) == plan.sequences
    assert len(filled) <= best_fit_decreasing(lengths, 100) + 1
