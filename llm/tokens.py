"""Token ids of whole texts by the tokenizers library, a batch of texts at a time.

Most words of a batch occur in it many times. A byte-level tokenizer cuts before a space that
stands between two other characters whatever is around it, so the texts are split there, Arrow
numbers the distinct pieces, and the library's model runs once per distinct piece. Texts where
white space meets a space, and tokenizers of another kind, go whole through the library.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from llm.rows import spans

KNOWN_PIECES = 500_000  # about 200 bytes each, and as much again while a worker grows
# Fixed value: how byte-level tokenizers of this family cut a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary writes each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        kind = self.tokenizer.pre_tokenizer
        self.by_piece = (
            isinstance(kind, pre_tokenizers.ByteLevel)
            and not kind.add_prefix_space
            and kind.use_regex
            and self.tokenizer.normalizer is None
        )
        added = self.tokenizer.get_added_tokens_decoder().values()
        self.special = [t.content for t in added]
        if any(t.lstrip or t.rstrip or t.single_word for t in added) or any(" " in s for s in self.special):
            self.by_piece = False
        self.letters = _letters()
        self.pattern = regex.compile(PATTERN)
        self.known: dict[str, bytes] = {}

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        done = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, dtype=np.uint32) for x in done]

    def _piece(self, piece: str) -> bytes:
        found = self.known.get(piece)
        if found is None:
            spelled = piece.encode().decode("latin-1").translate(self.letters)
            tokens = self.tokenizer.model.tokenize(spelled)
            found = np.array([t.id for t in tokens], dtype=np.uint32).tobytes()
            if len(self.known) < KNOWN_PIECES:
                self.known[piece] = found
        return found

    def _part(self, part: str, special: bool) -> bytes:
        # Letters behind a space are one piece, a mark behind them the next.
        if part[1:].isalpha() and (part[0] == " " or part[0].isalpha()):
            return self.known.get(part) or self._piece(part)
        if part[-1:] in (",", ".") and part[1:-1].isalpha() and (part[0] == " " or part[0].isalpha()):
            return self._piece(part[:-1]) + self._piece(part[-1])
        if special and any(s in part for s in self.special):
            return self.whole([part])[0].tobytes()
        return b"".join(map(self._piece, self.pattern.findall(part)))

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and how many each text has. Null is empty."""
        column = pc.fill_null(column, "")
        if not len(column):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if not self.by_piece:
            return _joined(self.whole(column.to_pylist()))
        odd = pc.or_(pc.match_substring(column, "  "), pc.ends_with(column, " ")).to_numpy(False)
        plain = column if not odd.any() else pc.if_else(pa.array(odd), "", column)
        lists = pc.split_pattern(plain, " ")
        parts = lists.flatten()
        per_text = pc.list_value_length(lists).to_numpy(False).astype(np.int64)
        first = np.zeros(len(parts), dtype=bool)
        starts = np.cumsum(per_text) - per_text
        first[starts[per_text > 0]] = True
        # A text's first part has no space before it; the others have one.
        spaced = pc.if_else(pa.array(first), parts, pc.binary_join_element_wise(" ", parts, ""))
        numbers = spaced.dictionary_encode()
        special = any(pc.any(pc.match_substring(column, s)).as_py() for s in self.special)
        coded = [self._part(p, special) for p in numbers.dictionary.to_pylist()]
        size = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        flat = np.frombuffer(b"".join(coded), dtype=np.uint32)
        index = numbers.indices.to_numpy(False)
        ids = flat[spans((np.cumsum(size) - size)[index], size[index])]
        counts = np.zeros(len(column), dtype=np.int64)
        np.add.at(counts, np.repeat(np.arange(len(column)), per_text), size[index])
        if not odd.any():
            return ids, counts
        at = np.flatnonzero(odd)
        split = np.split(ids, np.cumsum(counts)[:-1])
        for k, own in zip(at.tolist(), self.whole(column.take(pa.array(at)).to_pylist())):
            split[k] = own
        return _joined(split)


def _joined(each: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, each), np.int64, len(each))
    return np.concatenate(each) if each else np.zeros(0, np.uint32), counts


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per worker process: its pieces serve the tasks that follow."""
    return Encoder(path)


def with_end(ids: np.ndarray, counts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end`` after each text."""
    longer = counts + 1
    out = np.full(int(longer.sum()), end, dtype=np.uint32)
    out[spans(np.cumsum(longer) - longer, counts)] = ids
    return out, longer
