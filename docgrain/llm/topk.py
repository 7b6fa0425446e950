"""Exact top-k search by inner product, with pivot-table elimination."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as Win

PIVOTS = 32
BLOCK = 8192  # candidates under one pivot table
QUERY_BLOCK = 1024
_EXACT = 1 << 53  # integers up to here are exact as doubles

_INDEX = "dim int, c_block int, c_ids binary, c_vectors binary, pivots binary, distances binary"
_QUERIES = "dim int, q_block int, q_ids binary, q_vectors binary"
RESULT = "query_id long, vec_id long, score long"


def quantized(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): floor(256 x) of every component, as long; unusable vectors are left out."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).filter(
        F.col("vec_id").isNotNull() & F.col("x").isNotNull() & finite
    )
    return rows.select("vec_id", F.transform("x", lambda c: F.floor(c * 256.0)).alias("v"))


def _matrix(table: pa.Table, dim: int) -> np.ndarray:
    column = table.column("v").combine_chunks()
    return np.asarray(column.flatten(), np.int64).reshape(table.num_rows, dim)


def _sorted(table: pa.Table) -> pa.Table:
    return table.sort_by("vec_id")


def build_index(vectors: DataFrame, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """One packed row per block of candidates: ids, vectors, pivots and the distances to them.

    The distances are computed once here and serve every query. Pivots are taken from the block itself,
    each the member farthest from those before it.
    """

    def pack(table: pa.Table) -> pa.Table:
        dim, no = table.column("dim")[0].as_py(), table.column("c_block")[0].as_py()
        table = _sorted(table)
        x = _matrix(table, dim)
        f = x.astype(float)
        norms = (f * f).sum(1)
        chosen, nearest, rows, near = 0, np.full(len(f), np.inf), [], []
        for _ in range(min(pivots, len(f))):
            squares = np.maximum(norms + norms[chosen] - 2 * (f @ f[chosen]), 0)
            rows.append(chosen)
            near.append(np.sqrt(squares))
            nearest = np.minimum(nearest, squares)
            chosen = int(nearest.argmax())
        return pa.table(
            {
                "dim": pa.array([dim], pa.int32()),
                "c_block": pa.array([no], pa.int32()),
                "c_ids": pa.array([table.column("vec_id").to_numpy().tobytes()], pa.binary()),
                "c_vectors": pa.array([x.tobytes()], pa.binary()),
                "pivots": pa.array([f[rows].tobytes()], pa.binary()),
                "distances": pa.array([np.stack(near).tobytes()], pa.binary()),
            }
        )

    return vectors.groupBy("dim", "c_block").applyInArrow(pack, _INDEX)


def _pack_queries(vectors: DataFrame) -> DataFrame:
    def pack(table: pa.Table) -> pa.Table:
        dim, no = table.column("dim")[0].as_py(), table.column("q_block")[0].as_py()
        table = _sorted(table)
        return pa.table(
            {
                "dim": pa.array([dim], pa.int32()),
                "q_block": pa.array([no], pa.int32()),
                "q_ids": pa.array([table.column("vec_id").to_numpy().tobytes()], pa.binary()),
                "q_vectors": pa.array([_matrix(table, dim).tobytes()], pa.binary()),
            }
        )

    return vectors.groupBy("dim", "q_block").applyInArrow(pack, _QUERIES)


def search_block(q_ids, q, c_ids, c, pivots, near, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best candidates of one block for each query: (query, candidate, score).

    Triangle inequality: |q - c| is at least the largest |d(q, p) - d(c, p)| over the pivots p,
    and the inner product is (|q|^2 + |c|^2 - |q - c|^2) / 2, so each candidate has an upper
    bound. Candidates are evaluated in falling order of the bound until it is below the k-th
    best score found; equal bounds are still evaluated, since a tie goes to the smaller id.
    """
    n, dim = len(c), q.shape[1]
    most = max(int(np.abs(q).max(initial=0)), 1) * max(int(np.abs(c).max(initial=0)), 1) * max(dim, 1)
    exact = 4 * most < _EXACT and np.abs(c).max(initial=0) ** 2 * max(dim, 1) < _EXACT
    if not exact:  # components beyond double precision: plain integers, every candidate
        scores = q.astype(object) @ c.astype(object).T if dim else np.zeros((len(q), n), object)
        return _best_of_all(q_ids, c_ids, scores, k)
    qf, cf = q.astype(float), c.astype(float)
    cn = (cf * cf).sum(1)
    pn = (pivots * pivots).sum(1)
    out_q, out_c, out_s = [], [], []
    for i in range(len(q)):
        qn = float(qf[i] @ qf[i])
        to_pivots = np.sqrt(np.maximum(qn + pn - 2 * (pivots @ qf[i]), 0))
        gap = np.zeros(n)
        for j in range(len(to_pivots)):
            np.maximum(gap, np.abs(near[j] - to_pivots[j]), out=gap)
        bound = (qn + cn - gap * gap) / 2
        bound += 1e-6 * (1 + np.abs(bound))  # rounding of the square roots
        bound[c_ids == q_ids[i]] = -np.inf
        kept_at, kept = np.zeros(0, np.int64), np.zeros(0)
        low, left, size = -np.inf, np.flatnonzero(bound > -np.inf), max(64, 4 * k)
        while len(left):
            if len(left) > size:
                part = np.argpartition(-bound[left], size - 1)
                now, left = left[part[:size]], left[part[size:]]
            else:
                now, left = left, left[:0]
            kept_at, kept = np.r_[kept_at, now], np.r_[kept, cf[now] @ qf[i]]
            order = np.lexsort((c_ids[kept_at], -kept))[:k]
            kept_at, kept = kept_at[order], kept[order]
            if len(kept) == k:
                low = kept[-1]
                left = left[bound[left] >= low]
            size *= 4
        out_q.append(np.full(len(kept), q_ids[i]))
        out_c.append(c_ids[kept_at])
        out_s.append(kept.astype(np.int64))
    if not out_q:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(out_q), np.concatenate(out_c), np.concatenate(out_s)


def _best_of_all(q_ids, c_ids, scores, k: int):
    rows = []
    top = (1 << 63) - 1
    for i, row in enumerate(scores):
        pairs = sorted((-int(s), int(v)) for s, v in zip(row, c_ids, strict=True) if v != q_ids[i])[:k]
        rows += [(int(q_ids[i]), v, max(-top - 1, min(top, -s))) for s, v in pairs]
    cells = np.array(rows, np.int64).reshape(-1, 3)
    return cells[:, 0], cells[:, 1], cells[:, 2]


def exact_top_k(
    df: DataFrame,
    is_query: Column | None = None,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    block: int = BLOCK,
    query_block: int = QUERY_BLOCK,
    pivots: int = PIVOTS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query.

    Components are floor(256 x). Queries are the rows where ``is_query`` (over ``vec_id``) holds, by default ids divisible
    by 50; candidates are all rows of another id. Ties go to the smaller id; a query with
    fewer candidates returns them all.

    Candidates are dealt into blocks with a pivot table each, queries into blocks, and each pair of blocks is
    one row of an equi-join, searched in one step: blocks are of bounded size, and each pair
    leaves at most k rows per query, merged by rank.

    Null vectors and those with a null, NaN or infinite component take no part, nor do rows without id. Vectors of
    other lengths are not compared. Empty vectors score zero. Rows that repeat an id are one
    candidate each time they occur, and one query. Components so large that sums leave the double range are
    computed as integers, and scores beyond a long are clipped to it. An empty table gives no rows.
    """
    rows = quantized(df, id_col, vector_col).withColumn("dim", F.size("v"))
    n = rows.agg(F.count("*"), F.sum(F.when(_query(is_query), 1).otherwise(0))).first()
    c_blocks, q_blocks = max(1, -(-n[0] // block)), max(1, -(-(n[1] or 0) // query_block))
    deal = lambda salt, m: F.pmod(F.xxhash64("vec_id", "v", F.lit(salt)), F.lit(m)).cast("int")
    index = build_index(rows.withColumn("c_block", deal("candidate", c_blocks)), block, pivots)
    asked = rows.filter(_query(is_query)).dropDuplicates(["vec_id", "v"])
    queries = _pack_queries(asked.withColumn("q_block", deal("query", q_blocks)))
    left = index.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))))
    right = queries.withColumnRenamed("dim", "q_dim")
    pairs = left.join(right, (F.col("q") == F.col("q_block")) & (F.col("dim") == F.col("q_dim")))

    def search(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                dim = row["dim"]
                read = lambda c, kind=np.int64: np.frombuffer(row[c], kind)  # noqa: B023, E731
                q_ids, c_ids = read("q_ids"), read("c_ids")
                piv, near = read("pivots", float), read("distances", float).reshape(-1, len(c_ids))
                found = search_block(
                    q_ids,
                    read("q_vectors").reshape(len(q_ids), dim),
                    c_ids,
                    read("c_vectors").reshape(len(c_ids), dim),
                    piv.reshape(len(near), dim),
                    near,
                    k,
                )
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["query_id", "vec_id", "score"])

    keep = ["dim", "q_ids", "q_vectors", "c_ids", "c_vectors", "pivots", "distances"]
    found = pairs.select(*keep).mapInArrow(search, RESULT)
    order = Win.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order).cast("int"))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def _query(is_query: Column | None) -> Column:
    return F.col("vec_id") % 50 == 0 if is_query is None else is_query
