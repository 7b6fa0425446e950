"""Texts dealt into slices, and hashes exchanged between slices and buckets.

An operator that needs to know which hashes of a text occur elsewhere sends them, packed, to the
bucket of the hash, and gets the answer back at its slice. A slice sends a hash once or twice at most,
however often it holds it, so a passage or word that fills a third of all texts adds one
entry per slice to its bucket.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20
BUCKET_ENTRIES = 1 << 20
_BYTES_PER_WORD = 6


@dataclass(frozen=True)
class Layout:
    """How many slices and buckets a corpus is dealt into; results do not depend on it."""

    slices: int
    bits: int  # of a hash that name its bucket

    @property
    def buckets(self) -> int:
        return 1 << self.bits


def layout(docs: DataFrame, text_col: str) -> Layout:
    """Slices of a few MB and buckets of about a million words; both grow with the root of the
    input beyond 50 GB, so that the number of packed messages stays in proportion to it."""
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")).cast("long"))).first()[0] or 0
    grow = min(32.0, max(1.0, (total / 50e9) ** 0.5))
    buckets = total / _BYTES_PER_WORD / BUCKET_ENTRIES / grow
    return Layout(max(8, int(total / SLICE_BYTES / grow) + 1), max(3, int(np.ceil(np.log2(max(buckets, 1))))))


def sliced(docs: DataFrame, id_col: str, text_col: str, plan: Layout, *more, by_text: bool = False) -> DataFrame:
    """(slice, doc_id, t, ...): rows of one id share a slice; rows without id are dealt by their texts.

    With ``by_text`` all rows are dealt by id and text, for work that needs no row of an id beside another.
    """
    doc_id, text = F.col(id_col).cast("long"), F.col(text_col).cast("string")
    dealt = F.xxhash64(doc_id, text if by_text else F.when(doc_id.isNull(), text))
    return docs.select(
        F.pmod(dealt, F.lit(plan.slices)).cast("int").alias("slice"),
        doc_id.alias("doc_id"),
        text.alias("t"),
        *more,
    )


def by_bucket(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, edges) of entries sorted by bucket."""
    if not len(bucket):
        return bucket, np.zeros(1, np.int64)
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    return bucket[starts], np.r_[starts, len(bucket)]


def flags(mask: np.ndarray) -> bytes:
    return np.packbits(mask).tobytes()


def read_flags(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)
