"""Content-hash identifiers.

One rule everywhere: values as text, NULL as the empty string so that it keeps its
place, joined by ``|``, SHA-256 in hex. Skipping NULLs instead would give (NULL, x) and
(x) the same id.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the separator is part of the id.
SEPARATOR = "|"


def content_id(values: Iterable[Column]) -> Column:
    parts = [F.coalesce(value.cast("string"), F.lit("")) for value in values]
    return F.sha2(F.concat_ws(SEPARATOR, *parts), 256)


def id_or_content(existing: Column | None, values: Iterable[Column]) -> Column:
    derived = content_id(values)
    return derived if existing is None else F.coalesce(existing, derived)


def packed_id(value: Column) -> Column:
    """An id as bytes, for shuffles that only compare it: hex takes half its length.

    The first byte tells hex from any other text, so different ids stay different.
    """
    in_hex = value.rlike(r"^[0-9a-f]+\z") & (F.length(value) % 2 == 0)
    return F.when(in_hex, F.concat(F.unhex(F.lit("01")), F.unhex(value))).otherwise(
        F.concat(F.unhex(F.lit("00")), value.cast("binary"))
    )


def raw_event_key(transaction_id: Column, partition: Column, offset: Column) -> Column:
    """Key of one delivered event. The partition is included: offsets repeat across partitions."""
    return content_id([transaction_id, partition, offset])
