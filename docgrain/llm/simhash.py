"""SimHash fingerprints and near-duplicate components by pigeonhole blocks."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import stage
from . import words as W
from .components import components

SEED = 42
SHINGLE = 4  # words
BITS = 64
# Members of one bucket that a task compares with each other; a larger bucket is cut into chunks.
CHUNK = 4096
# Runs of up to this many members are compared pair by pair in one array operation per distance.
SHORT_RUN = 8
_NO = np.zeros(0, np.int64)


# ---- fingerprints ---------------------------------------------------------------------------------


def fingerprint(text: bytes | None, shingle: int, seed: int = SEED) -> int:
    """Majority of the bits of the XXH64 of all word shingles, repeats counted; no words: 0."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    if len(words) <= shingle:
        hashes = [xxhash.xxh64_intdigest(joined, seed)]
    else:
        lows = [0, *(ends[: len(words) - shingle] + 1).tolist()]
        hashes = [
            xxhash.xxh64_intdigest(joined[a:b], seed)
            for a, b in zip(lows, ends[shingle - 1 :].tolist(), strict=True)
        ]
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = np.array(hashes[at : at + (1 << 16)], dtype="<u8").view(np.uint8)
        counts += np.unpackbits(block, bitorder="little").reshape(-1, BITS).sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(doc_id, fp): one fingerprint per row, as a signed long. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _prints(batch.column(1), shingle)], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def with_fingerprint(docs: DataFrame, name: str, text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Rows and columns of ``docs`` and the fingerprint in a last column. No shuffle."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column(name, _prints(batch.column(at), shingle))

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, LongType())]))


def _prints(texts: pa.Array, shingle: int) -> pa.Array:
    data, offsets = W.text_bytes(texts)
    raw = data.tobytes()
    prints = [fingerprint(raw[a:b], shingle) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
    return pa.array(np.array(prints, dtype=np.uint64).view(np.int64))


# ---- pairs within a Hamming distance ---------------------------------------------------------------


def block_count(n: int, distance: int) -> int:
    """Blocks to cut 64 bits into, so that a random bucket holds about one of ``n`` fingerprints.

    Of b blocks, two fingerprints within ``distance`` bits share b - distance, so every choice
    of that many blocks is one key. More blocks mean longer keys and more of them; the result is
    the same for any number above ``distance``.
    """
    b = distance + 2
    while BITS * (b - distance) // b < np.log2(max(n, 1)) and b < 2 * distance + 4:
        b += 1
    return b


def block_keys(fp: Column, blocks: int, distance: int) -> list[Column]:
    """One struct (choice of blocks, their bits) per choice of ``blocks - distance`` blocks."""
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    keys = []
    for no, chosen in enumerate(combinations(range(blocks), blocks - distance)):
        mask = sum(((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in chosen)
        signed = mask - (1 << BITS) if mask >> (BITS - 1) else mask
        keys.append(F.struct(F.lit(no).alias("choice"), fp.bitwiseAND(F.lit(signed)).alias("bits")))
    return keys


def _near(x: np.ndarray, y, distance: int) -> np.ndarray:
    return np.bitwise_count(x ^ y) <= distance


def _forest(fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of the graph of fingerprints within ``distance``.

    Each member is compared with those not reached yet, so a dense group costs one pass, and
    one edge per member leaves the task, not one per pair.
    """
    left = np.arange(len(fp))
    a, b = [], []
    while len(left):
        frontier, left = [left[0]], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            hit = _near(fp[left], fp[at], distance)
            if hit.any():
                reached = left[hit]
                a.append(np.full(len(reached), at))
                b.append(reached)
                frontier.extend(reached.tolist())
                left = left[~hit]
    return (np.concatenate(a), np.concatenate(b)) if a else (_NO, _NO)


def _run_edges(run: np.ndarray, fp: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges inside runs of equal ``run`` numbers."""
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    sizes = np.diff(np.r_[starts, len(run)])
    short = np.repeat(sizes <= SHORT_RUN, sizes)
    a, b = [], []
    for gap in range(1, min(SHORT_RUN, len(run))):
        i = np.flatnonzero((run[gap:] == run[:-gap]) & short[gap:])
        i = i[_near(fp[i], fp[i + gap], distance)]
        a.append(i)
        b.append(i + gap)
    for s, n in zip(starts[sizes > SHORT_RUN], sizes[sizes > SHORT_RUN], strict=True):
        x, y = _forest(fp[s : s + n], distance)
        a.append(x + s)
        b.append(y + s)
    return (np.concatenate(a), np.concatenate(b)) if a else (_NO, _NO)


def near_edges(prints: DataFrame, distance: int, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that connect all pairs within ``distance``.

    ``prints``: one row (fp) per distinct fingerprint. Inside a bucket only a spanning
    forest is put out, so a bucket of n members gives fewer than n edges (at most seven times
    as many where it has eight members or fewer). A bucket of more than
    ``chunk`` members is cut into chunks and each pair of chunks is a task of its own: nothing
    is dropped, and no task holds more than two chunks.
    """
    blocks = block_count(prints.count(), distance)
    keyed = prints.select("fp", F.explode(F.array(*block_keys(F.col("fp"), blocks, distance))).alias("k"))
    keyed = keyed.select("k.choice", "k.bits", "fp")
    sizes = keyed.groupBy("choice", "bits").agg(F.count("*").alias("n")).filter(F.col("n") > chunk)
    hot = stage(sizes.withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int")), "hot-blocks")
    at = ["choice", "bits"]

    def cold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the run that the next batch may continue; no longer than a chunk
        for batch in batches:
            t = pa.Table.from_batches([batch])
            if held is not None:
                t = pa.concat_tables([held, t])
            c, bits, fp = (t.column(i).to_numpy() for i in range(3))
            new = np.r_[True, (c[1:] != c[:-1]) | (bits[1:] != bits[:-1])] if len(c) else np.zeros(0, bool)
            last = int(np.flatnonzero(new)[-1]) if len(c) else 0
            held = t.slice(last).combine_chunks()
            yield edges(np.cumsum(new[:last]), fp[:last])
        if held is not None and held.num_rows:
            yield edges(np.zeros(held.num_rows), held.column(2).to_numpy())

    def edges(run: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        a, b = _run_edges(run, fp.view(np.uint64), distance) if len(run) else (_NO, _NO)
        return pa.RecordBatch.from_arrays([pa.array(fp[a], pa.int64()), pa.array(fp[b], pa.int64())], names=["a", "b"])

    def chunk_pair(table: pa.Table) -> pa.Table:
        fp = table.column("fp").to_numpy()
        a, b = _forest(fp.view(np.uint64), distance)
        return pa.table({"a": pa.array(fp[a], pa.int64()), "b": pa.array(fp[b], pa.int64())})

    few = keyed.join(hot, at, "left_anti").repartition(*at).sortWithinPartitions(*at)
    quiet = few.select("choice", "bits", "fp").mapInArrow(cold, "a long, b long")
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    pairs = (
        keyed.join(hot, at)
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select(*at, "fp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    )
    loud = pairs.groupBy(*at, "i", "j").applyInArrow(chunk_pair, "a long, b long")
    return quiet.union(loud)


def simhash_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    distance: int = 4,
    chunk: int = CHUNK,
) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row: near-duplicate groups by SimHash.

    Fingerprints within ``distance`` bits are linked; ``component_id`` is the smallest doc_id that
    can be reached over links, the row's own included. Copies share a fingerprint and are
    represented by one row of it, so a large group of copies costs no pairs.

    Null or empty text: fingerprint zero, linked like any other. Repeated rows get the same
    result each. Rows that share an id and differ in text lie in the components of their own
    fingerprints. A row without id links like any other but names no component; one that reaches
    no id has a null component. An empty table gives no rows. Only the two named columns are read.
    """
    return simhash_groups(docs, id_col, text_col, shingle, distance, chunk).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def simhash_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    distance: int = 4,
    chunk: int = CHUNK,
) -> DataFrame:
    """(doc_id, fp, place, component_id) per row, as :func:`simhash_components`. ``place`` is one of the
    fingerprints of the component and names it, also where components have the same smallest id or none."""
    prints = stage(fingerprints(docs, id_col, text_col, shingle), "simhash")
    distinct = stage(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-distinct")
    found = components(near_edges(distinct.select("fp"), distance, chunk))
    placed = distinct.join(found, F.col("fp") == F.col("node"), "left").select(
        "fp", "rep", F.coalesce("component", "fp").alias("place")
    )
    names = placed.groupBy("place").agg(F.min("rep").alias("component_id"))
    named = placed.join(names, "place").select("fp", "place", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "place", "component_id")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, distance: int = 4) -> DataFrame:
    """One row of each group of near duplicates, columns unchanged: of the rows with the group's smallest id the one with the
    smallest text; of a group without any id, the one with the smallest text.

    Rows that share an id and lie in different groups do not touch each other. See :func:`simhash_components`.
    """
    spare = lambda name: next(n for k in range(len(docs.columns) + 1) if (n := name + "_" * k) not in docs.columns)
    first, mark, group, own, kept = (spare(x) for x in ("first_id", "first_print", "group", "own_print", "row"))
    firsts = (
        simhash_groups(docs, id_col, text_col, shingle, distance)
        .filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .select(F.col("doc_id").alias(first), F.col("fp").alias(mark), F.col("place").alias(group))
        .distinct()
    )
    rows = with_fingerprint(docs, own, text_col, shingle)
    there = rows.join(firsts, rows[id_col].cast("long").eqNullSafe(firsts[first]) & (rows[own] == firsts[mark]))
    row = F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.struct(F.col(text_col).isNull(), text_col))
    return there.groupBy(group).agg(row.alias(kept)).select(f"{kept}.*")
