"""Words of a text, as all operators take them: runs of bytes without space, \\t, \\n, \\v, \\f, \\r.

``bytes.split`` and ``bytes.lower`` know ASCII only, so they cut at exactly these six
characters and change A-Z alone.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa

WORD = r"[^\x20\x09-\x0D]+"


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; a null text is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def word_ends(words: list[bytes]) -> np.ndarray:
    """Where each word ends once the words are joined by single spaces."""
    return np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1


def shingles(words: list[bytes], width: int) -> list[bytes]:
    """All runs of ``width`` words joined by a space; fewer words give the whole sequence."""
    if not words:
        return []
    joined = b" ".join(words)
    if len(words) <= width:
        return [joined]
    ends = word_ends(words)
    starts = np.concatenate([[0], ends[:-1] + 1])
    return [joined[a:b] for a, b in zip(starts[: -width + 1].tolist(), ends[width - 1 :].tolist())]


def with_periodic_tail(doc_id: object, words: list[bytes]) -> list[bytes]:
    """The words, or for one id in ten with a tail that repeats some of them 3 to 10 times.

    With h the crc32 of the id as text (a null id: the empty text), g = h // 10 and h % 10 = 0,
    word i from a = g % n on becomes word a + (i - a) % p, where p = 1 + (n - a) // (3 + g % 8).
    """
    h, n = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    a = h // 10 % n
    p = 1 + (n - a) // (3 + h // 10 % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]
