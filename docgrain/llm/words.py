"""Words of a batch of texts as numpy arrays.

All work is on the UTF-8 bytes. Separators of both word rules are ASCII, so multi-byte characters
are never cut, and a whole batch is split and hashed with array operations.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

_BYTES = np.arange(256)
# [^\x20\x09-\x0D]+
NOT_SPACE = ~((_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D)))
# [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ : digits, a-z and every byte of a non-ASCII character
ALNUM = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
_LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)

PIECE_BYTES = 1 << 20

_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xBF58476D1CE4E5B9)
_C = np.uint64(0x94D049BB133111EB)
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """64-bit finalizer: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h *= _B
    h ^= h >> np.uint64(27)
    h *= _C
    h ^= h >> np.uint64(31)
    return h


def text_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string or binary column; a null has no bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_binary())
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.buffers()[2] is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """Words of consecutive texts. Word i is ``data[starts[i]:ends[i]]``; text d owns the words
    ``first[d]:first[d + 1]``."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text_of(self) -> np.ndarray:
        """The text that each word belongs to."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        """A 64-bit hash per word, injective for words of up to eight bytes of one length."""
        length = self.ends - self.starts
        if not len(length):
            return np.zeros(0, np.uint64)
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        at = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
        out = mix((at[self.starts] & _MASKS[np.minimum(length, 8)]) ^ (length.astype(np.uint64) * _A))
        more, done = np.flatnonzero(length > 8), 8
        while len(more):
            tail = at[self.starts[more] + done] & _MASKS[np.minimum(length[more] - done, 8)]
            out[more] = mix(out[more] * _A + tail + np.uint64(1))
            done += 8
            more = more[length[more] > done]
        return out

    def window_hashes(self, word_hashes: np.ndarray, size: int) -> np.ndarray:
        """Hash of the ``size`` words from each word on. Only meaningful where ``fits`` holds."""
        return windows(word_hashes, size)

    def fits(self, size: int) -> np.ndarray:
        """Whether ``size`` words of the same text start at each word."""
        stop = np.repeat(self.first[1:], self.counts())
        return np.arange(len(self.starts)) + size <= stop


def windows(values: np.ndarray, size: int) -> np.ndarray:
    """Order-sensitive hash of every run of ``size`` values, built from runs of powers of two.

    The last ``size - 1`` entries have no whole run and hold no meaning.
    """
    n = len(values)
    out, covered, run, length = None, 0, values, 1
    while True:
        if size & length:
            if out is None:
                out = run.copy()
            else:
                joined = out * _A
                joined[: max(0, n - covered)] += run[covered:]
                out = mix(joined + np.uint64(covered))
            covered += length
        length *= 2
        if length > size:
            return out
        paired = run * _C
        paired[: max(0, n - length // 2)] += run[length // 2 :]
        run = mix(paired + np.uint64(length))


def split(data: np.ndarray, offsets: np.ndarray, member: np.ndarray, lower: bool) -> Words:
    """Split texts into maximal runs of member bytes, after lower-casing A-Z if asked."""
    if lower:
        data = _LOWER[data]
    inside = member[data]
    begin, stop = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    stop[:-1] &= ~inside[1:]
    edges = offsets[(offsets > 0) & (offsets < len(data))]
    begin[edges] = inside[edges]
    stop[edges - 1] = inside[edges - 1]
    starts = np.flatnonzero(begin)
    first = np.searchsorted(starts, offsets)
    first[-1] = len(starts)
    return Words(data, starts, np.flatnonzero(stop) + 1, first)


def pieces(offsets: np.ndarray, size: int = PIECE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``size`` bytes, so that working arrays stay small."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        to = min(to, n)
        yield at, to
        at = to


def split_pieces(column, member: np.ndarray, lower: bool) -> Iterator[tuple[int, int, Words]]:
    """(first text, end, words) of each piece of an Arrow text column."""
    data, offsets = text_bytes(column)
    for at, to in pieces(offsets):
        part = data[offsets[at] : offsets[to]]
        yield at, to, split(part, offsets[at : to + 1] - offsets[at], member, lower)
