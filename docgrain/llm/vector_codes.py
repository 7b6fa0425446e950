"""Vector codes by product quantisation, trained by dual-tree Lloyd in integers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage

PARTS = 16
ENTRIES = 64
ROUNDS = 2
BLOCK = 4096  # vectors under one set of trees
LEAF = 16  # part vectors, at most about twice as many
# Components up to here keep all distances and box bounds in 64 bits; beyond, Python integers.
NARROW = 1 << 27

_BLOCKS = "ids array<long>, labels array<string>, wide boolean, vectors binary, orders binary"
_TOP = (1 << 63) - 1


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, label_col: str | None) -> DataFrame:
    """(vec_id, label, v): floor(256 x) of every component; null vectors and those with a null or
    non-finite component are left out."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    label = F.lit(None).cast("string") if label_col is None else F.col(label_col).cast("string")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), label.alias("label"), x.alias("x")).filter(F.col("x").isNotNull() & finite)
    return rows.select("vec_id", "label", F.transform("x", lambda c: F.floor(c * 256.0)).alias("v"))


# ---- trees -----------------------------------------------------------------------------------------


def levels(n: int, leaf: int) -> list[np.ndarray]:
    """Bounds of the nodes of each level over ``n`` ordered points: node k of a level is cut in the middle."""
    out = [np.array([0, n])]
    while n and np.diff(out[-1]).max() > leaf:
        e = out[-1]
        cut = np.empty(2 * len(e) - 1, np.int64)
        cut[::2], cut[1::2] = e, (e[:-1] + e[1:]) // 2
        out.append(cut)
    return out


def tree_order(x: np.ndarray, leaf: int) -> np.ndarray:
    """Order of points so that the nodes of :func:`levels` are cut along their widest component."""
    order = np.arange(len(x))
    for bounds in levels(len(x), leaf)[:-1]:
        sizes = np.diff(bounds)
        y = x[order]
        wide = (np.maximum.reduceat(y, bounds[:-1], 0) - np.minimum.reduceat(y, bounds[:-1], 0)).argmax(1)
        node = np.repeat(np.arange(len(sizes)), sizes)
        by = y[np.arange(len(y)), wide[node]]
        order = order[np.lexsort((by, node))] if by.dtype != object else order[sorted(range(len(by)), key=lambda i: (node[i], by[i]))]
    return order


class Tree:
    """Boxes and sums of the nodes of each level over ordered points."""

    def __init__(self, x: np.ndarray, leaf: int):
        self.x = x
        self.bounds = levels(len(x), leaf)
        self.low = [np.minimum.reduceat(x, b[:-1], 0) for b in self.bounds]
        self.high = [np.maximum.reduceat(x, b[:-1], 0) for b in self.bounds]
        self.sums = [np.add.reduceat(x, b[:-1], 0) for b in self.bounds]


def box_bounds(low_a, high_a, low_b, high_b) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest squared distance between points of two boxes, row by row."""
    gap = np.maximum(np.maximum(low_a - high_b, low_b - high_a), 0)
    span = np.maximum(high_a - low_b, high_b - low_a)
    return (gap * gap).sum(1), (span * span).sum(1)


def assign(points: Tree, entries: np.ndarray, entry_order: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
    """(nearest entry of each ordered point, sums and counts per entry, points that met integers).

    Both trees are walked level by level over pairs of nodes. Of the entry nodes paired with a point node, those
    go whose least distance is above the smallest greatest distance of another: none of their entries is nearest, nor tied, for any
    point of the node. A node left with one entry is assigned whole, with its cached sum. What is left at the leaves is compared
    in integers; a tie goes to the lower index.
    """
    x, k = points.x, len(entries)
    tree = Tree(entries[entry_order], 1)
    code = np.full(len(x), -1, np.int64)
    sums = np.zeros((k, x.shape[1]), x.dtype)
    counts = np.zeros(k, np.int64)
    exact = 0
    node, other = np.zeros(1, np.int64), np.zeros(1, np.int64)
    p_level = e_level = 0
    while len(node):
        e_bounds, p_bounds = tree.bounds[e_level], points.bounds[p_level]
        least, most = box_bounds(points.low[p_level][node], points.high[p_level][node], tree.low[e_level][other], tree.high[e_level][other])
        starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
        sizes = np.diff(np.r_[starts, len(node)])
        keep = least <= np.repeat(np.minimum.reduceat(most, starts), sizes)
        node, other = node[keep], other[keep]
        at_entries = e_level == len(tree.bounds) - 1
        if at_entries:
            new = np.r_[True, node[1:] != node[:-1]]
            single = new & np.r_[new[1:], True]
            for i, e in zip(node[single].tolist(), entry_order[e_bounds[other[single]]].tolist(), strict=True):
                a, b = p_bounds[i], p_bounds[i + 1]
                code[a:b] = e
                counts[e] += b - a
                sums[e] += points.sums[p_level][i]
            node, other = node[~single], other[~single]
            if not len(node):
                break
        if at_entries and p_level == len(points.bounds) - 1:
            starts = np.flatnonzero(np.r_[True, node[1:] != node[:-1]])
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(node)], strict=True):
                lo, hi = p_bounds[node[a]], p_bounds[node[a] + 1]
                those = np.sort(entry_order[e_bounds[other[a:b]]])
                gap = x[lo:hi, None, :] - entries[those][None]
                near = those[(gap * gap).sum(2).argmin(1)]
                code[lo:hi] = near
                exact += hi - lo
                np.add.at(sums, near, x[lo:hi])
                counts += np.bincount(near, minlength=k)
            break
        if not at_entries:
            e_level += 1
            node, other = _children(node, other, e_bounds, tree.bounds[e_level])
        if p_level < len(points.bounds) - 1:
            p_level += 1
            other, node = _children(other, node, p_bounds, points.bounds[p_level])
            order = np.argsort(node, kind="stable")
            node, other = node[order], other[order]
    return code, sums, counts, exact


def _children(fixed: np.ndarray, parent: np.ndarray, bounds: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs with each parent replaced by its children; children without points are left out."""
    child = np.stack([2 * parent, 2 * parent + 1], 1).reshape(-1)
    keep = below[child + 1] > below[child]
    return np.repeat(fixed, 2)[keep], child[keep]


# ---- blocks of vectors -----------------------------------------------------------------------------


def pack(vectors: DataFrame, dim: int, parts: int, block: int, leaf: int) -> DataFrame:
    """One row per block of vectors: ids, labels, integers and, per part, their order in the tree. No shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, block):
                rows = batch.slice(at, block)
                flat = rows.column(2).flatten()
                x = np.asarray(flat, np.int64).reshape(rows.num_rows, dim)
                wide = bool(len(x)) and (int(x.max()) >= NARROW or int(x.min()) <= -NARROW)
                y = x.astype(object) if wide else x
                orders = [tree_order(p, leaf).astype(np.int32) for p in np.split(y, parts, 1)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([rows.column(0)], pa.list_(pa.int64())),
                        pa.array([rows.column(1)], pa.list_(pa.string())),
                        pa.array([wide]),
                        pa.array([(x if wide else x.astype(np.int32)).tobytes()], pa.binary()),
                        pa.array([np.stack(orders).tobytes()], pa.binary()),
                    ],
                    names=["ids", "labels", "wide", "vectors", "orders"],
                )

    return vectors.select("vec_id", "label", "v").mapInArrow(run, _BLOCKS)


def blocks_of(batches: Iterator[pa.RecordBatch], dim: int):
    """(ids, labels, integers, orders) of each packed block."""
    for batch in batches:
        for i in range(batch.num_rows):
            ids, labels = batch.column(0)[i].values, batch.column(1)[i].values
            n, wide = len(ids), batch.column(2)[i].as_py()
            x = np.frombuffer(batch.column(3)[i].as_buffer(), np.int64 if wide else np.int32).reshape(n, dim)
            orders = np.frombuffer(batch.column(4)[i].as_buffer(), np.int32).reshape(-1, n)
            yield ids, labels, x.astype(object if wide else np.int64), orders


def _fitting(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points and entries as one kind of integers that holds their squared distances."""
    small = x.dtype != object and int(np.abs(book).max(initial=0)) < NARROW
    return (x, book.astype(np.int64)) if small else (x.astype(object), book)


def encode_block(x: np.ndarray, orders: np.ndarray, books: list[np.ndarray], entry_orders: list[np.ndarray], leaf: int):
    """Per part: (codes in row order, sums, counts, part vectors)."""
    for part, order, book, entry_order in zip(np.split(x, len(books), 1), orders, books, entry_orders, strict=True):
        part, entries = _fitting(part, book)
        code = np.empty(len(part), np.int64)
        code[order], sums, counts, _ = assign(Tree(part[order], leaf), entries, entry_order)
        yield code, sums, counts, part, entries


def partial_sums(packed: DataFrame, books: list[np.ndarray], dim: int, leaf: int) -> DataFrame:
    """(part, entry, n, sums) per task: counts and component sums of the parts assigned to each entry."""
    entry_orders = [tree_order(b, 1) for b in books]
    width = dim // len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(books), len(books[0]), width), object)
        n = np.zeros((len(books), len(books[0])), np.int64)
        for _, _, x, orders in blocks_of(batches, dim):
            for p, (_, sums, counts, _, _) in enumerate(encode_block(x, orders, books, entry_orders, leaf)):
                total[p] += sums
                n[p] += counts
        at = [(p, e) for p, e in zip(*np.nonzero(n), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([p for p, _ in at], pa.int32()),
                pa.array([e for _, e in at], pa.int32()),
                pa.array([n[a] for a in at], pa.int64()),
                pa.array([[str(s) for s in total[a]] for a in at], pa.list_(pa.string())),
            ],
            names=["part", "entry", "n", "sums"],
        )

    return packed.mapInArrow(run, "part int, entry int, n long, sums array<string>")


def updated(packed: DataFrame, books: list[np.ndarray], dim: int, leaf: int) -> list[np.ndarray]:
    """Codebooks after one round: floor of the mean of each entry's parts; unused entries stay."""
    width = dim // len(books)
    of = [F.sum(F.get("sums", F.lit(c)).cast("decimal(38,0)")).alias(f"s{c}") for c in range(width)]
    rows = partial_sums(packed, books, dim, leaf).groupBy("part", "entry").agg(F.sum("n").alias("n"), *of)
    out = [b.copy() for b in books]
    for r in rows.collect():  # one row per entry of a codebook
        for c in range(width):
            out[r.part][r.entry, c] = int(r[f"s{c}"]) // r.n
    return out


def encoded(packed: DataFrame, books: list[np.ndarray], dim: int, leaf: int) -> DataFrame:
    """(vec_id, label, code, error) of every packed vector."""
    entry_orders = [tree_order(b, 1) for b in books]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, labels, x, orders in blocks_of(batches, dim):
            error = np.zeros(len(x), object)
            codes = np.empty((len(x), len(books)), np.uint8 if len(books[0]) <= 256 else np.uint16)
            for p, (code, _, _, part, entries) in enumerate(encode_block(x, orders, books, entry_orders, leaf)):
                codes[:, p] = code
                gap = part - entries[code]
                error += (gap * gap).sum(1)
            yield pa.RecordBatch.from_arrays(
                [
                    ids,
                    labels,
                    pa.array([c.tobytes().hex() if codes.dtype == np.uint8 else c.astype(">u2").tobytes().hex() for c in codes], pa.string()),
                    pa.array([min(int(e), _TOP) for e in error], pa.int64()),
                ],
                names=["vec_id", "label", "code", "error"],
            )

    return packed.mapInArrow(run, "vec_id long, label string, code string, error long")


class Codebooks:
    """Trained codebooks: one array of entries per part position."""

    def __init__(self, books: list[np.ndarray]):
        self.books = books

    def digest(self) -> str:
        """SHA-256 of all components, by part, entry and position, comma-joined."""
        return hashlib.sha256(",".join(str(int(c)) for b in self.books for e in b for c in e).encode()).hexdigest()


def compress(
    df: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str | None = "label",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
    block: int = BLOCK,
    leaf: int = LEAF,
) -> tuple[DataFrame, Codebooks]:
    """((vec_id, label, code, error) per usable vector, codebooks).

    Components are floor(256 x); vectors are cut into ``parts`` equal parts. The codebook of a part position starts
    as that part of the vectors with the smallest ids and is refined by ``rounds`` rounds of Lloyd over all vectors;
    then every part gets the index of its nearest entry, ties to the lower index. ``error`` is the squared distance summed over
    parts. The code is hexadecimal, two digits a part (four with more than 256 entries).

    Vectors are packed into blocks with a tree per part, written once to the shared folder, and each round is one scan of the blocks: a task keeps
    sums per entry, a few kilobytes, whatever it reads. Codebooks go to the tasks with the plan; their size is a
    parameter. Results do not depend on blocks, leaves or tasks: all bounds and sums are integers.

    Null vectors and those with a null, NaN or infinite component are left out. Rows without id take part and come last in the order of ids; rows that repeat an
    id take part each, in the order of their components. The row with the smallest id fixes the dimension; vectors of
    another length, or all if ``parts`` does not divide it, have null code and error and take no part in training. With fewer
    vectors than ``entries`` codebooks are smaller. An empty table gives no rows and empty codebooks. Components
    beyond 2**27 are computed as Python integers; those beyond a long, and errors beyond it, are clipped to it.
    """
    rows = integer_vectors(df, id_col, vector_col, label_col)
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "v").select("v").limit(1).collect()
    dim = len(first[0].v) if first else 0
    fits = (F.size("v") == dim) if dim and dim % parts == 0 else F.lit(False)
    seed = rows.filter(fits).orderBy(F.asc_nulls_last("vec_id"), "v").select("v").limit(entries).collect()
    odd = rows.filter(~fits).select("vec_id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    if not seed:
        return odd, Codebooks([])
    start = np.array([r.v for r in seed], object).reshape(len(seed), dim)
    books = np.split(start, parts, 1)
    packed = stage(pack(rows.filter(fits), dim, parts, block, leaf), "vector-blocks")
    for _ in range(rounds):
        books = updated(packed, books, dim, leaf)
    return encoded(packed, books, dim, leaf).union(odd), Codebooks(books)


def codes_digest(coded: DataFrame, books: Codebooks) -> DataFrame:
    """Codes with the error summed over equal labels, nulls together, and the digest of the codebooks."""
    kept = stage(coded, "vector-codes")
    total: Column = F.sum(F.col("error").cast("decimal(38,0)"))
    sums = kept.groupBy(F.col("label").alias("of")).agg(F.when(total > _TOP, F.lit(_TOP)).otherwise(total.cast("long")).alias("label_error"))
    return kept.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))
