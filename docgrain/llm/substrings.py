"""Removal of repeated passages by fixed-block anchors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .slices import Layout, by_bucket, flags, layout, read_flags, sliced

WINDOW = 20
_REST = np.uint64(32)  # bits of a probe's hash that are sent besides its bucket
_OTHER = np.uint64(0xD6E8FEB86659FD93)

_PROBES = "bucket int, slice int, hashes binary, anchor binary, twice binary"
_HITS = "slice int, kind int, bucket int, data binary"
_WINDOWS = "bucket int, slice int, hashes binary, ids binary, named binary"
RESULT = "doc_id long, n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept_text string"


class _Texts:
    """Texts as bytes, made when they are asked for."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def __iter__(self):
        for a, b in zip(self.offsets[:-1], self.offsets[1:], strict=True):
            yield self.data[a:b].tobytes()


class Slice:
    """The words of one slice, its documents in their order, with block and window hashes."""

    def __init__(self, table: pa.Table, window: int, bits: int, full: bool):
        ids = table.column("doc_id").to_pylist()
        keys = table.column("key").to_pylist()
        order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, keys[i]))
        if len(set(keys)) < len(ids):  # rows of one key are told apart by their text
            texts = table.column("t").to_pylist()
            order.sort(key=lambda i: (ids[i] is not None, keys[i], texts[i] is not None, texts[i] or ""))
        table = table.take(pa.array(order, pa.int64()))
        self.ids = table.column("doc_id").combine_chunks()
        self.keys = table.column("key").to_numpy()
        self.named = self.ids.is_valid().to_numpy(zero_copy_only=False)
        data, offsets = W.text_bytes(table.column("t"))
        self.texts = _Texts(data, offsets)
        self.window, block = window, window // 2
        low, firsts, parts = 0, [np.zeros(1, np.int64)], []
        for _, _, words in W.split_pieces(table.column("t"), W.NOT_SPACE, False):
            h = words.hashes()
            place = np.arange(len(h)) - np.repeat(words.first[:-1], words.counts())
            probe = W.windows(h, block) >> (np.uint64(64) - np.uint64(bits) - _REST)
            part = [words.fits(block), probe, place % block == 0]
            if full:
                part += [words.fits(window), W.windows(h, window), W.windows(W.mix(h ^ _OTHER), window)]
            parts.append(part)
            firsts.append(words.first[1:] + low)
            low += len(h)
        joined = [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.zeros(0, np.uint64)] * 6
        self.first = np.concatenate(firsts)
        self.has_block, self.probe, self.aligned = joined[0].astype(bool), joined[1], joined[2].astype(bool)
        if full:
            self.has_window, self.hash, self.other = joined[3].astype(bool), joined[4], joined[5]

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def candidates(self, hits: np.ndarray) -> np.ndarray:
        """First words of the windows that hold a block that also occurs elsewhere."""
        n = len(self.probe)
        hit = np.zeros(n, bool)
        if len(hits) and n:
            place = np.minimum(np.searchsorted(hits, self.probe), len(hits) - 1)
            hit = self.has_block & (hits[place] == self.probe)
        seen = np.r_[0, np.cumsum(hit)]
        to = np.minimum(np.arange(n) + self.window // 2, n)
        return np.flatnonzero(self.has_window & (seen[to] > seen[:-1]))


def _unique_windows(s: Slice, hits: np.ndarray, bits: int) -> tuple[np.ndarray, ...]:
    """(window, bucket, number, first): candidate windows sorted by hash and place; ``number`` counts the distinct
    hashes, ``first`` marks the first window of each."""
    at = s.candidates(hits)
    bucket = (s.other[at] >> np.uint64(64 - bits)).astype(np.int64)
    order = np.lexsort((s.hash[at], bucket))  # stable: windows of one hash stay in order
    at, bucket = at[order], bucket[order]
    h = s.hash[at]
    first = np.ones(len(at), bool)
    first[1:] = (h[1:] != h[:-1]) | (bucket[1:] != bucket[:-1])
    return at, bucket, np.cumsum(first) - 1, first


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, plan: Layout | None = None
) -> DataFrame:
    """(doc_id, n_words, n_removed, spans, kept_text): texts without passages that start earlier.

    Words are runs of other characters than white space. A word goes if a window of ``window``
    (an even number) consecutive words that covers it also starts earlier, in a document with a smaller id or
    earlier in its own. ``spans`` are the removed stretches of words, end exclusive; ``kept_text``
    joins the kept words by single spaces.

    1. Every document is cut into non-overlapping blocks of half a window, the anchors; a window
       holds at least one whole anchor of any earlier place it repeats. Every rolling block is
       probed against the anchors; those found elsewhere are hits.
    2. Windows around hits are compared by a hash of the whole window, which extends a hit to
       both sides; runs of repeated windows are the maximal repeats. Of equal windows all but the
       first are removed. The hash has 64 bits and those of the bucket, which follow a second hash.

    Texts are shuffled once, by slice; hashes go to their buckets packed, at most two of a kind from a slice,
    see :mod:`.slices`. The answers come back by slice, and both later passes read the same shuffle of the texts.

    Null, empty and wordless texts have no words and an empty ``kept_text``. Documents without id
    come before all others, in the order of a hash of their texts, by which they are also dealt into slices. Rows that
    share an id come in the order of their texts; a repeated row repeats the one before it. An empty table gives no rows. Only the two named columns are read.
    """
    plan = plan or layout(docs, text_col)
    bits = plan.bits
    # What rows are ordered by: the id, without one a hash of the text.
    key = F.coalesce(F.col(id_col).cast("long"), F.xxhash64(F.col(text_col).cast("string")))
    rows = sliced(docs, id_col, text_col, plan, key.alias("key"))

    def probes(table: pa.Table) -> pa.Table:
        s = Slice(table, window, bits, False)
        # Sorting puts the anchor first among equal hashes.
        key = (s.probe << np.uint64(1) | (~s.aligned).astype(np.uint64))[s.has_block]
        key.sort()
        value = key >> np.uint64(1)
        new = np.ones(len(key), bool)
        new[1:] = value[1:] != value[:-1]
        at = np.flatnonzero(new)
        value, anchor = value[at], (key[at] & np.uint64(1)) == 0
        twice = np.diff(np.r_[at, len(key)]) > 1
        names, edges = by_bucket((value >> _REST).astype(np.int64))
        cuts = list(zip(edges[:-1], edges[1:], strict=True))
        return pa.table(
            {
                "bucket": pa.array(names, pa.int32()),
                "slice": pa.array([_slice(table)] * len(names), pa.int32()),
                "hashes": pa.array([value[a:b].astype(np.uint32).tobytes() for a, b in cuts], pa.binary()),
                "anchor": pa.array([flags(anchor[a:b]) for a, b in cuts], pa.binary()),
                "twice": pa.array([flags(twice[a:b]) for a, b in cuts], pa.binary()),
            }
        )

    def match(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint32) for x in table.column("hashes").to_pylist()]
        size = [len(p) for p in parts]
        marks = [
            np.concatenate([read_flags(x, n) for x, n in zip(table.column(c).to_pylist(), size, strict=True)])
            for c in ("anchor", "twice")
        ]
        h = np.concatenate(parts)
        order = np.argsort(h, kind="stable")
        sorted_h = h[order]
        starts = np.flatnonzero(np.r_[True, sorted_h[1:] != sorted_h[:-1]])
        n = np.diff(np.r_[starts, len(h)])
        anchored = np.maximum.reduceat(marks[0][order], starts)
        several = (n > 1) | np.maximum.reduceat(marks[1][order], starts)
        hit = np.zeros(len(h), bool)
        hit[order] = np.repeat(anchored & several, n)
        ends = np.cumsum(size)
        return _hits(
            0,
            table.column("slice").to_pylist(),
            table.column("bucket")[0].as_py(),
            [h[e - k : e][hit[e - k : e]].tobytes() for e, k in zip(ends, size, strict=True)],
        )

    def candidates(texts: pa.Table, answers: pa.Table) -> pa.Table:
        s = Slice(texts, window, bits, True) if texts.num_rows else None
        if s is None or not answers.num_rows:
            kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            return pa.table([pa.array([], t) for t in kinds], names=["bucket", "slice", "hashes", "ids", "named"])
        at, bucket, _, first = _unique_windows(s, _read_hits(answers), bits)
        at, bucket = at[first], bucket[first]
        doc = s.doc_of()[at]
        doc, named = s.keys[doc], s.named[doc]
        names, edges = by_bucket(bucket)
        cuts = list(zip(edges[:-1], edges[1:], strict=True))
        return pa.table(
            {
                "bucket": pa.array(names, pa.int32()),
                "slice": pa.array([_slice(texts)] * len(names), pa.int32()),
                "hashes": pa.array([s.hash[at[a:b]].tobytes() for a, b in cuts], pa.binary()),
                "ids": pa.array([_pack_ids(doc[a:b]) for a, b in cuts], pa.binary()),
                # Nothing where all rows have ids.
                "named": pa.array([None if named[a:b].all() else flags(named[a:b]) for a, b in cuts], pa.binary()),
            }
        )

    def earliest(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
        size = [len(p) for p in parts]
        doc = np.concatenate([_read_ids(x) for x in table.column("ids").to_pylist()])
        told = zip(table.column("named").to_pylist(), size, strict=True)
        named = np.concatenate([np.ones(n, bool) if x is None else read_flags(x, n) for x, n in told])
        h = np.concatenate(parts)
        order = np.lexsort((doc, named, h))
        first = np.zeros(len(h), bool)
        first[order[np.r_[True, h[order][1:] != h[order][:-1]]]] = True
        ends = np.cumsum(size)
        return _hits(
            1,
            table.column("slice").to_pylist(),
            table.column("bucket")[0].as_py(),
            [flags(first[e - k : e]) for e, k in zip(ends, size, strict=True)],
        )

    def cut(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.table([pa.array([], f.type) for f in _RESULT], schema=_RESULT)
        kind = answers.column("kind").to_numpy()
        s = Slice(texts, window, bits, True)
        at, bucket, number, first = _unique_windows(s, _read_hits(answers.filter(pa.array(kind == 0))), bits)
        names, edges = by_bucket(bucket[first])
        told = answers.filter(pa.array(kind == 1))
        said = dict(zip(told.column("bucket").to_pylist(), told.column("data").to_pylist(), strict=True))
        here = [read_flags(said[b], int(n)) for b, n in zip(names.tolist(), np.diff(edges), strict=True)]
        stays = first & (np.concatenate(here)[number] if here else first)
        cover = np.zeros(len(s.probe) + 1, np.int64)
        np.add.at(cover, at[~stays], 1)
        np.add.at(cover, at[~stays] + window, -1)
        return _kept(s, np.cumsum(cover)[:-1] > 0)

    sent = rows.groupBy("slice").applyInArrow(probes, _PROBES)
    hits = sent.groupBy("bucket").applyInArrow(match, _HITS)
    seen = rows.groupBy("slice").cogroup(hits.groupBy("slice")).applyInArrow(candidates, _WINDOWS)
    firsts = seen.groupBy("bucket").applyInArrow(earliest, _HITS)
    answers = hits.union(firsts)
    return rows.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(cut, RESULT)


_RESULT = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_words", pa.int64()),
        ("n_removed", pa.int64()),
        ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        ("kept_text", pa.string()),
    ]
)


def _slice(table: pa.Table) -> int:
    return table.column("slice")[0].as_py()


def _pack_ids(ids: np.ndarray) -> bytes:
    """The smallest id and the distances from it, in four bytes where they fit."""
    low = ids.min()
    far = (ids - low).view(np.uint64)
    kind = np.uint32 if far.max() < 1 << 32 else np.uint64
    return bytes([kind().itemsize]) + low.tobytes() + far.astype(kind).tobytes()


def _read_ids(data: bytes) -> np.ndarray:
    far = np.frombuffer(data, np.uint32 if data[0] == 4 else np.uint64, offset=9)
    return far.astype(np.uint64).view(np.int64) + np.frombuffer(data, np.int64, 1, 1)


def _hits(kind: int, slices: list[int], bucket: int, data: list[bytes]) -> pa.Table:
    some = [i for i, d in enumerate(data) if d]
    return pa.table(
        {
            "slice": pa.array([slices[i] for i in some], pa.int32()),
            "kind": pa.array([kind] * len(some), pa.int32()),
            "bucket": pa.array([bucket] * len(some), pa.int32()),
            "data": pa.array([data[i] for i in some], pa.binary()),
        }
    )


def _read_hits(answers: pa.Table) -> np.ndarray:
    """Sorted probes that were found elsewhere."""
    parts = [
        np.uint64(b) << _REST | np.frombuffer(d, np.uint32)
        for b, d in zip(answers.column("bucket").to_pylist(), answers.column("data").to_pylist(), strict=True)
    ]
    return np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def _kept(s: Slice, gone: np.ndarray) -> pa.Table:
    """Result rows of a slice, in the order of its documents."""
    count = np.r_[0, np.cumsum(gone)]
    spans, kept = [], []
    for d, text in enumerate(s.texts):
        low, high = s.first[d], s.first[d + 1]
        mine = gone[low:high]
        words = text.split()
        if not mine.any():
            spans.append([])
        else:
            edge = np.flatnonzero(np.diff(np.r_[False, mine, False].astype(np.int8)))
            spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)])
            words = [words[i] for i in np.flatnonzero(~mine).tolist()]
        kept.append(b" ".join(words))
    return pa.table(
        [
            s.ids,
            pa.array(np.diff(s.first), pa.int64()),
            pa.array(count[s.first[1:]] - count[s.first[:-1]], pa.int64()),
            pa.array(spans, _RESULT.field("spans").type),
            pa.array(kept, pa.binary()).cast(pa.string()),
        ],
        schema=_RESULT,
    )


def kept_digest(result: DataFrame) -> DataFrame:
    """The contract's columns: the kept text as SHA-256."""
    return result.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))

