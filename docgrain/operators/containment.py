"""Which short texts stand inside which long texts, by grams instead of pairs.

``contains`` has no key to join on. A gram (six bytes of UTF-8) of the short text is one: a long text that
contains the short one has all its grams, so the pairs to test are those that share the short text's rarest
gram. Short texts of fewer bytes are their own gram, and the empty text is in every text.

Grams are cut in Arrow batches with array operations. Built-in functions can cut them, at fifty times the
cost: higher-order functions and regular expressions make an object for every character.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import stage

GRAM = 6  # bytes
PIECE = 1 << 18  # bytes worked on at a time
SENT = 16 << 20  # bytes of short texts that go to every task
FILTER_BITS = 24  # a gram filter has 2**24 bits: 2 MB, whatever it is made of
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _positions(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, position, gram) of every gram of one size; a gram is its bytes with its size above them."""
    starts = np.maximum(np.diff(offsets) - size + 1, 0)
    row = np.repeat(np.arange(len(starts)), starts)
    at = np.repeat(offsets[:-1] - np.r_[0, np.cumsum(starts)[:-1]], starts) + np.arange(len(row)) if len(row) else row
    value = np.full(len(row), size, np.int64)
    for k in range(size):
        value = value << 8 | data[at + k]
    return row, at, value


def _slots(gram: np.ndarray) -> np.ndarray:
    return ((gram.astype(np.uint64) * _SPREAD) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def filter_passes(gram: np.ndarray, only: np.ndarray) -> np.ndarray:
    """Which grams pass a filter made by :func:`gram_filter`."""
    slot = _slots(gram)
    return (only[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 > 0


def _joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum([len(t) for t in texts], dtype=np.int64)]


# ---- inside a task ---------------------------------------------------------------------------------


def occurrences(small: list[bytes], large: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): ``small[i]`` stands in ``large[j]``; a pair may be named more than once. No empty texts in ``small``."""
    data, offsets = _joined(large)
    raw = data.tobytes()
    own, own_offsets = _joined(small)
    length = np.diff(own_offsets)
    out_i, out_j = [], []
    for size in np.unique(np.minimum(length, GRAM)).tolist():
        mine = np.flatnonzero(np.minimum(length, GRAM) == size)
        row, at, gram = _positions(data, offsets, size)
        order = np.argsort(gram, kind="stable")
        gram = gram[order]
        which, spot, asked = _positions(own, own_offsets, size)
        keep = np.isin(which, mine)
        which, spot, asked = which[keep], spot[keep], asked[keep]
        low = np.searchsorted(gram, asked)
        times = np.searchsorted(gram, asked, "right") - low
        best = np.lexsort((times, which))
        best = best[np.r_[True, which[best][1:] != which[best][:-1]]]
        for k in best[times[best] > 0].tolist():  # one gram per short text: its rarest
            i = int(which[k])
            hits = order[low[k] : low[k] + times[k]]
            start = at[hits] - (spot[k] - own_offsets[i])
            j = row[hits]
            inside = (start >= offsets[j]) & (start + length[i] <= offsets[j + 1])
            text, n = small[i], int(length[i])
            found = [b for s, b in zip(start[inside].tolist(), j[inside].tolist(), strict=True) if raw[s : s + n] == text]
            out_i += [i] * len(found)
            out_j += found
    return np.array(out_i, np.int64), np.array(out_j, np.int64)


# ---- over tables -----------------------------------------------------------------------------------


def _pieces(text: pa.Array, kept: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    """(bytes, offsets, rows) of stretches of about PIECE bytes; nulls are out."""
    there = text.is_valid()
    text, kept = text.filter(there).cast(pa.large_binary()), kept.filter(there)
    ends, at = np.r_[0, np.cumsum(np.asarray(pc.binary_length(text), np.int64))], 0
    data = np.zeros(0, np.uint8)
    if ends[-1]:
        _, starts, raw = text.buffers()
        data = np.frombuffer(raw, np.uint8)[np.frombuffer(starts, np.int64)[text.offset] :]
    while at < len(text):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + PIECE, "right")) - 1)
        yield data[ends[at] : ends[to]], ends[at : to + 1] - ends[at], kept.slice(at, to - at)
        at = to


def _spots(data: np.ndarray, offsets: np.ndarray, sizes: list[int], only: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, gram) of every place of a gram that passes the filter, one size after another.

    The bytes are read as one text, each size from the one before; a gram that reaches into the next row goes afterwards,
    when few are left.
    """
    value = np.zeros(len(data), np.int64)
    for size in range(max(sizes, default=0) + 1):
        if size:
            value = value[: max(len(data) - size + 1, 0)]
            value <<= 8
            value |= data[size - 1 :]
        if size not in sizes:
            continue
        if size == 0:
            yield np.arange(len(offsets) - 1), np.zeros(len(offsets) - 1, np.int64)
        else:
            gram = value | size << 8 * size
            at = np.arange(len(gram)) if only is None else np.flatnonzero(filter_passes(gram, only))
            row = np.searchsorted(offsets, at, "right") - 1
            inside = at + size <= offsets[row + 1]
            yield row[inside], gram[at[inside]]


def _distinct_grams(data: np.ndarray, offsets: np.ndarray, sizes: list[int], only: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, gram) of the distinct grams of each row that pass the filter, one size after another."""
    for row, gram in _spots(data, offsets, sizes, only):
        order = np.lexsort((gram, row))
        row, gram = row[order], gram[order]
        first = np.r_[True, (row[1:] != row[:-1]) | (gram[1:] != gram[:-1])][: len(row)]
        yield row[first], gram[first]


def gram_rows(
    rows: DataFrame, keep: list[str], text: str, sizes: list[int], only: np.ndarray | None = None, whole: bool = False
) -> DataFrame:
    """(keep..., gram): one row per distinct gram of each text that is not null; with ``only``, of the grams that
    pass this filter; with ``whole``, each text gives the grams of one size, its own length if that is below six bytes."""
    given = rows.select(*keep, F.col(text).alias("__text"))
    out = T.StructType([*given.drop("__text").schema.fields, T.StructField("gram", T.LongType())])
    sent = rows.sparkSession.sparkContext.broadcast(only)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, offsets, few in _pieces(batch.column(len(keep)), batch.select(keep)):
                own = np.minimum(np.diff(offsets), GRAM)
                for row, gram in _distinct_grams(data, offsets, sizes, sent.value):
                    if whole:
                        mine = own[row] == gram >> 8 * own[row]
                        row, gram = row[mine], gram[mine]
                    yield few.take(pa.array(row)).append_column("gram", pa.array(gram, pa.int64()))

    return given.mapInArrow(run, out)


def gram_counts(rows: DataFrame, text: str, sizes: list[int], only: np.ndarray) -> DataFrame:
    """(gram, n): how often each gram stands in the texts that passes the filter, added up per task before the shuffle."""
    sent = rows.sparkSession.sparkContext.broadcast(only)

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        grams, at = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
        return grams, np.bincount(at, np.concatenate([n for _, n in parts]), len(grams)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
        for batch in batches:
            for data, offsets, _ in _pieces(batch.column(0), batch):
                for _, gram in _spots(data, offsets, sizes, sent.value):
                    parts.append(np.unique(gram, return_counts=True))
                if len(parts) > 16:
                    parts = [merged(parts)]
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in merged(parts)], names=["gram", "n"])

    return rows.select(text).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("__n"))


def gram_filter(grams: DataFrame) -> np.ndarray:
    """Bits of all values of ``gram``, as bytes: of a fixed size, so it may go to every task. It passes all of these
    grams and few others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << FILTER_BITS, bool)
        for batch in batches:
            bits[_slots(batch.column(0).to_numpy())] = True
        words = np.packbits(bits, bitorder="little").view(np.int64)
        at = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(words[at])], names=["w", "bits"])

    parts = grams.select("gram").mapInArrow(run, "w int, bits long").groupBy("w").agg(F.expr("bit_or(bits)").alias("bits"))
    out = np.zeros((1 << FILTER_BITS) // 64, np.int64)
    table = parts.toArrow()
    out[table.column("w").to_numpy()] = table.column("bits").to_numpy()
    return out.view(np.uint8)


def choices(needles: DataFrame, hays: DataFrame, needle: str, carried: str, hay: str) -> tuple[DataFrame, list[int]]:
    """(carried, gram): the rarest gram of each short text that may stand in a long one, staged, and the sizes of grams.

    ``needles``: the text, none twice, and a value for each; ``hays``: the long texts, read once to count the grams of the
    short ones. A filter of 2 MB lets only such grams leave a task. Short texts are told apart by their SHA-256, so that
    no text travels with each of its grams.
    """
    keyed = stage(needles.withColumn("__key", F.unhex(F.sha2(F.col(needle).cast("binary"), 256))), "gram-needles")
    own = F.least(F.octet_length(needle), F.lit(GRAM))
    sizes = sorted(r[0] for r in keyed.select(own.alias("n")).distinct().collect() if r[0] is not None)
    asked = gram_rows(keyed, ["__key"], needle, sizes, whole=True)
    # Staged, so that the joins below are planned by the size of the counts and not by that of the long texts.
    often = stage(gram_counts(hays, hay, sizes, gram_filter(asked)), "gram-counts")
    # A gram that no long text has ends the search for its short text: it is not in ``often`` and its count is zero.
    rarest = asked.join(often, "gram", "left").groupBy("__key").agg(F.min(F.struct(F.coalesce("__n", F.lit(0)).alias("n"), "gram")).alias("__g"))
    choice = rarest.filter("__g.n > 0").select("__key", F.col("__g.gram").alias("gram"))
    return stage(choice.join(keyed, "__key").select(carried, "gram"), "gram-choices"), sizes


def candidates(choice: DataFrame, sizes: list[int], hays: DataFrame, carried: str, hay_id: str, hay: str) -> DataFrame:
    """(hay_id, needles): for each long text the values ``carried`` by the short texts that may stand in it.

    ``hays``: an id and the text. A pair is named if the long text has the gram chosen by :func:`choices`, so every true pair
    is among them; the caller tests the text itself. Rows of one id are taken together, so ids may be hashes.

    What is shuffled follows the matches and not the length of the texts. Whether the
    choices are small enough to be sent to all tasks is left to the optimizer's size check; beyond, they meet
    in a join on the gram, which the adaptive plan splits.
    """
    pairs = gram_rows(hays, [hay_id], hay, sizes, gram_filter(choice)).join(choice, "gram")
    return pairs.groupBy(hay_id).agg(F.collect_set(carried).alias("needles"))


def lookup(choice: DataFrame, sizes: list[int], carried: str) -> Callable[[Column], Column] | None:
    """The same as a function of the text, for choices of up to 16 MB, which go to every task; None beyond.

    ``carried`` is an array of strings; the function gives one array of all that may stand in its text, which is not null. Rows
    stay where they are.
    """
    size = choice.agg(F.sum(F.aggregate(carried, F.lit(32), lambda n, t: n + F.octet_length(t) + 16).cast("long"))).first()[0] or 0
    if size > SENT:
        return None
    table = choice.orderBy("gram").toArrow()
    values = pa.concat_arrays([c.cast(pa.list_(pa.string())) for c in table.column(carried).chunks] or [pa.array([], pa.list_(pa.string()))])
    sent = choice.sparkSession.sparkContext.broadcast((gram_filter(choice), table.column("gram").to_numpy(), values))

    @F.arrow_udf("array<string>")
    def run(text: pa.Array) -> pa.Array:
        only, grams, values = sent.value
        at, pairs = 0, [np.zeros(0, np.int64)]
        for data, offsets, _ in _pieces(text, pa.RecordBatch.from_arrays([text], names=["text"])):
            for row, gram in _spots(data, offsets, sizes, only):
                first = np.searchsorted(grams, gram)
                n = np.searchsorted(grams, gram, "right") - first
                each = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
                pairs.append(np.unique((np.repeat(row, n) + at) * len(grams) + each))
            at += len(offsets) - 1
        row, each = np.divmod(np.sort(np.concatenate(pairs)), max(len(grams), 1))
        found = values.take(pa.array(each))
        lengths = np.bincount(row, np.asarray(pc.list_value_length(found)), len(text)).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lengths)], pa.int32()), found.flatten())

    return run
