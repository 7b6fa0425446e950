import math

import numpy as np
import pytest

from docgrain.llm import topk


def brute(rows, k=5):
    """rows: (id, vector) -> (query, rank, id, score)."""
    good = [
        (i, [math.floor(256.0 * x) for x in v])
        for i, v in rows
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for q, qv in {(i, tuple(v)) for i, v in good if i % 50 == 0}:
        scores = sorted((-sum(a * b for a, b in zip(qv, v, strict=True)), i) for i, v in good if i != q and len(v) == len(qv))
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize(("block", "query_block", "pivots"), [(8192, 1024, 32), (60, 3, 4), (1, 1, 1)])
def test_equals_brute_force(spark, sf, block, query_block, pivots):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    if block == 1:
        df = df.filter("vec_id < 120")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert result(topk.exact_top_k(df, block=block, query_block=query_block, pivots=pivots)) == brute(rows)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.25]), (1, [0.5, -0.25]), (2, [0.5, -0.25]), (3, [0.1, 0.1]), (4, None), (5, [None, 1.0])]
    rows += [(6, [nan, 1.0]), (7, [1.0, inf]), (None, [1.0, 1.0]), (50, [0.0, 0.0]), (100, [1.0, 2.0, 3.0])]
    rows += [(150, []), (151, []), (3, [0.1, 0.1]), (200, [-1e-9, 1e-9]), (250, [nan, nan])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", topk.F.lit(1)).withColumn("dim", topk.F.lit(2))
    want = brute(rows)
    assert result(topk.exact_top_k(df)) == want
    assert [r for r in want if r[0] == 100] == []  # no candidate of its length
    assert result(topk.exact_top_k(df.limit(0))) == []


def test_large_components_are_exact(spark):
    rows = [(i, [float(2**22 + i * 3), float(2**21 - i), 0.5]) for i in range(0, 120, 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert result(topk.exact_top_k(df)) == brute(rows)


def test_elimination_evaluates_few_clustered_candidates():
    rng = np.random.default_rng(3)
    centres = rng.normal(0, 40, (30, 16))
    c = np.floor(np.repeat(centres, 100, 0) + rng.normal(0, 1, (3000, 16))).astype(np.int64)
    ids = np.arange(3000)
    f = c.astype(float)
    pivots = f[::100]
    near = np.sqrt(np.maximum(((f[None] - pivots[:, None]) ** 2).sum(2), 0))
    got = topk.search_block(ids[:5], c[:5], ids, c, pivots, near, 5)
    for q in range(5):
        scores = sorted((-int(c[q] @ c[i]), i) for i in range(3000) if i != q)[:5]
        mine = [(-int(s), int(i)) for a, i, s in zip(*got, strict=True) if a == q]
        assert mine == scores
