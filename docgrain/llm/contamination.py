"""Benchmark passages in training text, found by suffix arrays over shards of the text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

WINDOW = 10
SHARD_BYTES = 4 << 20  # text under one suffix array
BENCH_BYTES = 32 << 20  # benchmark text that is sent to the executors at a time

MATCH = "struct<start:long,length:long,item_id:string,item_start:long>"
RESULT = (
    "doc_id long, n_words long, n_hit long, n_items long, longest long, items array<string>, "
    f"matches array<{MATCH}>"
)


@dataclass
class Tests:
    """Suffixes of the benchmark items that can start a match, as keys for the binary search."""

    vocab: np.ndarray  # sorted word hashes; a word's symbol is its place
    needs: np.ndarray  # symbol -> words in the shortest window that starts with it
    keys: np.ndarray  # key of the first words of each suffix, missing words as 0
    tops: np.ndarray  # the same, missing words as the highest symbol
    size: np.ndarray  # words in the window of each suffix
    item: np.ndarray  # number of the suffix's item
    at: np.ndarray  # first word of the suffix in its item
    ids: list[str | None]
    window: int


def _keys(symbols: np.ndarray, size: np.ndarray, starts: np.ndarray, window: int, missing: int) -> np.ndarray:
    """Order-preserving keys: ``window`` big-endian symbols of each suffix in one byte string."""
    place = starts[:, None] + np.arange(window)
    cells = symbols[np.minimum(place, len(symbols) - 1)] + 1
    cells = np.where(np.arange(window) < size[:, None], cells, missing).astype(">u4")
    return np.ascontiguousarray(cells).view(f"S{4 * window}").ravel()


def prepare(ids: list, texts: pa.Array, window: int) -> Tests | None:
    """Tests of some benchmark items; None if they hold no word."""
    data, offsets = W.text_bytes(texts)
    words = W.split(data, offsets, W.ALNUM, True)
    if not len(words.starts):
        return None
    vocab, symbols = np.unique(words.hashes(), return_inverse=True)
    item = words.text_of()
    at = np.arange(len(item)) - words.first[item]
    size = np.minimum(words.counts(), window)[item]
    opens = at + size <= words.counts()[item]
    needs = np.full(len(vocab), np.iinfo(np.int64).max)
    np.minimum.at(needs, symbols[opens], size[opens])
    starts, size = np.flatnonzero(opens), size[opens]
    keys = _keys(symbols, size, starts, window, 0)
    tops = _keys(symbols, size, starts, window, 0xFFFFFFFF)
    names = [None if i is None else str(i) for i in ids]
    return Tests(vocab, needs, keys, tops, size, item[opens], at[opens], names, window)


def shard_matches(words: W.Words, tests: Tests) -> tuple[np.ndarray, ...]:
    """Maximal verbatim matches (first word, length, item, word in item) of one shard.

    The shard's suffix array holds the suffixes that can start a window: all words of the
    window are benchmark words and lie in one text. Every benchmark suffix is looked up in it by two
    binary searches, which bound the suffixes that start with its window. Windows that follow
    one another in both text and item are one match.
    """
    none = (np.zeros(0, np.int64),) * 4
    hashes = words.hashes()
    if not len(hashes):
        return none
    place = np.minimum(np.searchsorted(tests.vocab, hashes), len(tests.vocab) - 1)
    known = tests.vocab[place] == hashes
    n = len(hashes)
    stops = np.unique(np.concatenate([np.flatnonzero(~known), words.first[1:]]))
    opens = np.flatnonzero(known)
    room = stops[np.searchsorted(stops, opens, "right")] - opens if len(opens) else opens
    fits = room >= tests.needs[place[opens]]
    opens, room = opens[fits], room[fits]
    if not len(opens):
        return none
    keys = _keys(place, np.minimum(room, tests.window), opens, tests.window, 0)
    order = np.argsort(keys, kind="stable")
    array, keys = opens[order], keys[order]  # the suffix array and its keys
    low, high = np.searchsorted(keys, tests.keys, "left"), np.searchsorted(keys, tests.tops, "right")
    found = np.maximum(high - low, 0)
    test = np.repeat(np.arange(len(found)), found)
    if not len(test):
        return none
    step = np.arange(len(test)) - np.repeat(np.cumsum(found) - found, found)
    start = array[np.repeat(low, found) + step]
    # Windows on one diagonal of (text, item) that follow each other.
    item, at, size = tests.item[test], tests.at[test], tests.size[test]
    order = np.lexsort((start, start - at, item))
    start, item, at, size = start[order], item[order], at[order], size[order]
    text = np.searchsorted(words.first, start, "right")
    new = np.ones(len(start), bool)
    new[1:] = (
        (item[1:] != item[:-1])
        | (start[1:] != start[:-1] + 1)
        | (at[1:] != at[:-1] + 1)
        | (text[1:] != text[:-1])
    )
    head = np.flatnonzero(new)
    tail = np.r_[head[1:], len(start)] - 1
    return start[head], start[tail] + size[tail] - start[head], item[head], at[head]


def scan(column, tests: Tests | None) -> Iterator[dict]:
    """Result columns of consecutive rows, shard by shard."""
    data, offsets = W.text_bytes(column)
    for lo, hi in W.pieces(offsets, SHARD_BYTES):
        words = W.split(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], W.ALNUM, True)
        start, length, item, at = (np.zeros(0, np.int64),) * 4 if tests is None else shard_matches(words, tests)
        cover = np.zeros(len(words.starts) + 1, np.int64)
        np.add.at(cover, start, 1)
        np.add.at(cover, start + length, -1)
        hit = np.r_[0, np.cumsum(np.cumsum(cover)[:-1] > 0)]
        n_hit = hit[words.first[1:]] - hit[words.first[:-1]]
        text = np.searchsorted(words.first, start, "right") - 1
        order = np.lexsort((at, start, text))
        edges = np.searchsorted(text[order], np.arange(hi - lo + 1))
        matches: list[list[dict]] = [[] for _ in range(hi - lo)]
        for d in np.flatnonzero(np.diff(edges)):
            for m in order[edges[d] : edges[d + 1]].tolist():
                matches[d].append(
                    {
                        "start": int(start[m] - words.first[d]),
                        "length": int(length[m]),
                        "item_id": tests.ids[item[m]],
                        "item_start": int(at[m]),
                    }
                )
        yield {"rows": (lo, hi), "n_words": words.counts(), "n_hit": n_hit, "matches": matches}


def _items(matches: list[dict]) -> list[str]:
    return sorted({m["item_id"] for m in matches} - {None})


def bench_blocks(bench: DataFrame, id_col: str, text_col: str, limit: int) -> int:
    """Blocks into which the benchmark is cut, so that one holds about ``limit`` bytes."""
    total = bench.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    return max(1, -(-total // limit))


def _block(bench: DataFrame, id_col: str, text_col: str, no: int, blocks: int, window: int) -> Tests | None:
    part = bench.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).cast("string").alias("t"))
    rows = part.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == no).toArrow()
    texts = rows.column("t").combine_chunks()
    return prepare(rows.column("i").to_pylist(), texts, window)


def find_contamination(
    docs: DataFrame,
    bench: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    bench_bytes: int = BENCH_BYTES,
) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, longest, items, matches) per row of ``docs``.

    A window is ``window`` consecutive words of an item, or all of a shorter item. ``n_hit``
    counts document words inside any occurrence of a window, ``items`` are the items that have
    one, ``matches`` the maximal verbatim matches with their places, ``longest`` the longest.

    Nothing is shuffled: each task builds suffix arrays over shards of its own rows and looks all
    benchmark suffixes up. The benchmark is sent to the executors, up to ``bench_bytes`` of text at a
    time; a larger one is taken in blocks, one pass over the texts each, and the passes' results
    are merged by document.

    Null or wordless text: no words, no hits. Wordless items match nothing. Items that repeat an id count
    once; an item without id hits words but is not listed. Repeated documents get the same result
    each. An empty benchmark hits nothing; an empty table gives no rows.
    """
    spark = docs.sparkSession
    blocks = bench_blocks(bench, item_col, item_text_col, bench_bytes)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))

    def one(no: int) -> DataFrame:
        shared = spark.sparkContext.broadcast(_block(bench, item_col, item_text_col, no, blocks, window))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in scan(batch.column(1), shared.value):
                    lo, hi = r["rows"]
                    items = [_items(m) for m in r["matches"]]
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(lo, hi - lo),
                            pa.array(r["n_words"], pa.int64()),
                            pa.array(r["n_hit"], pa.int64()),
                            pa.array([len(i) for i in items], pa.int64()),
                            pa.array([max((m["length"] for m in ms), default=0) for ms in r["matches"]], pa.int64()),
                            pa.array(items, pa.list_(pa.string())),
                            pa.array(r["matches"], _MATCHES),
                            *([batch.column(2).slice(lo, hi - lo)] if blocks > 1 else []),
                        ],
                        names=[*_NAMES, *(["h"] if blocks > 1 else [])],
                    )

        source = rows.withColumn("h", F.xxhash64("t")) if blocks > 1 else rows
        return source.mapInArrow(run, RESULT + (", h long" if blocks > 1 else ""))

    if blocks == 1:
        return one(0)
    parts = one(0)
    for no in range(1, blocks):
        parts = parts.union(one(no))
    merged = parts.groupBy("doc_id", "h").applyInArrow(_merge, RESULT + ", h long")
    return rows.select(F.col("doc_id").alias("i"), F.xxhash64("t").alias("k")).join(
        merged, F.col("i").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("h"))
    ).drop("i", "k", "h")


_NAMES = ["doc_id", "n_words", "n_hit", "n_items", "longest", "items", "matches"]
_MATCHES = pa.list_(
    pa.struct([("start", pa.int64()), ("length", pa.int64()), ("item_id", pa.string()), ("item_start", pa.int64())])
)


def _merge(table: pa.Table) -> pa.Table:
    """One row from the rows of one text that the blocks of the benchmark gave."""
    seen = {tuple(m.values()): m for ms in table.column("matches").to_pylist() for m in ms}
    matches = [seen[k] for k in sorted(seen, key=lambda k: (k[0], k[1], str(k[2]), k[3]))]
    n_words, end, hit = table.column("n_words")[0].as_py(), 0, 0
    for m in matches:
        to = m["start"] + m["length"]
        hit += max(0, to - max(end, m["start"]))
        end = max(end, to)
    items = _items(matches)
    values = [n_words, hit, len(items), max((m["length"] for m in matches), default=0)]
    return pa.table(
        [table.column("doc_id").slice(0, 1)]
        + [pa.array([v], pa.int64()) for v in values]
        + [pa.array([items], pa.list_(pa.string())), pa.array([matches], _MATCHES), table.column("h").slice(0, 1)],
        names=[*_NAMES, "h"],
    )


def decontaminate(
    docs: DataFrame,
    bench: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    bench_bytes: int = BENCH_BYTES,
) -> DataFrame:
    """Rows of ``docs`` without an occurrence of a benchmark window, all columns unchanged.

    Each block of the benchmark (see :func:`find_contamination`) is one filter over the rows;
    nothing is shuffled. Null and wordless texts stay.
    """
    blocks = bench_blocks(bench, item_col, item_text_col, bench_bytes)
    at = docs.columns.index(text_col)
    for no in range(blocks):
        shared = docs.sparkSession.sparkContext.broadcast(_block(bench, item_col, item_text_col, no, blocks, window))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                column = batch.column(at)
                hits = [r["n_hit"] for r in scan(column, shared.value)]
                yield batch.filter(pa.array(np.concatenate(hits) == 0)) if hits else batch

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def contamination_digest(found: DataFrame) -> DataFrame:
    """The contract's columns: the listed items as one SHA-256."""
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        "n_items",
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "longest",
    )

