import hashlib
import math
import random

import numpy as np
import pytest

from docgrain.llm import vector_codes as V


def brute(rows, parts=16, entries=64, rounds=2):
    """rows: (id, vector, label) -> sorted (id, code, error, label_error, digest), every distance computed."""
    kept = [
        (i, [math.floor(256.0 * x) for x in v], label)
        for i, v, label in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[1]) if r[0] is not None else (True, 0, r[1]))
    if not kept:
        return []
    dim = len(kept[0][1])
    fits = [r for r in kept if len(r[1]) == dim and dim and dim % parts == 0]
    odd = [r for r in kept if len(r[1]) != dim or not dim or dim % parts]
    w = dim // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(v, p) for _, v, _ in fits[:entries]] for p in range(parts)] if fits else []

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            of = [nearest(cut(v, p), book)[1] for _, v, _ in fits]
            for e in range(len(book)):
                mine = [cut(v, p) for (_, v, _), o in zip(fits, of, strict=True) if o == e]
                if mine:
                    book[e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    out, total = [], {}
    for i, v, label in fits:
        near = [nearest(cut(v, p), books[p]) for p in range(parts)]
        error = sum(d for d, _ in near)
        total[label] = total.get(label, 0) + error
        out.append((i, "".join(f"{e:02x}" for _, e in near), error, label))
    out = [(i, c, e, total[label], digest) for i, c, e, label in out]
    out += [(i, None, None, total.get(label), digest) for i, _, label in odd]
    return sorted(out, key=repr)


def result(df, **more):
    return sorted((tuple(r) for r in V.codes_digest(*V.compress(df, **more)).collect()), key=repr)


@pytest.mark.parametrize(("block", "leaf"), [(4096, 16), (37, 1), (64, 1000)])
def test_equals_brute_force(spark, sf, block, leaf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet").repartition(3)
    rows = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    assert result(df, block=block, leaf=leaf) == brute(rows)


def test_ties_go_to_the_lower_index(spark):
    rng = random.Random(1)
    rows = [(i, [rng.randrange(-2, 3) / 256 for _ in range(8)], rng.choice([1, 2, None])) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(5)
    assert result(df, parts=4, entries=7, rounds=3) == brute(rows, 4, 7, 3)


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [i * 0.1, -i * 0.3, 0.5, 1.0], i % 3) for i in range(20)]
    rows += [(3, [9.0, 9.0, 9.0, 9.0], None), (3, [9.0, 9.0, 9.0, 9.0], None), (None, [1.0, 2.0, 3.0, 4.0], None)]
    rows += [(50, None, 1), (51, [1.0, None, 0.0, 0.0], 1), (52, [nan, 0.0, 0.0, 0.0], 1), (53, [0.0, inf, 0.0, 0.0], 1)]
    rows += [(54, [1.0, 2.0], 1), (55, [], 2), (56, [1.0] * 8, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for c in ("v", "x", "code", "error", "of", "ids", "part"):
        df = df.withColumn(c, V.F.lit(1))
    assert result(df, parts=2, entries=4) == brute(rows, 2, 4)
    assert result(df, parts=3, entries=4) == brute(rows, 3, 4)
    assert result(df.limit(0)) == []
    coded, books = V.compress(df.drop("label"), label_col=None, parts=2)
    assert coded.count() == 26 and len(books.books) == 2


def test_large_components_are_exact(spark):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) * 2.0 ** rng.choice([1, 20, 40]) for _ in range(4)], None) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    top = (1 << 63) - 1
    want = [(i, c, min(e, top), min(t, top), d) for i, c, e, t, d in brute(rows, 2, 8)]
    got = result(df, parts=2, entries=8)
    assert [r[:2] for r in got] == [r[:2] for r in sorted(want, key=repr)]
    assert got == sorted(want, key=repr)


def test_most_points_of_clusters_are_assigned_by_nodes():
    rng = np.random.default_rng(0)
    centres = rng.integers(-4000, 4000, (64, 4))
    x = np.repeat(centres, 200, 0) + rng.integers(-20, 20, (12800, 4))
    order = V.tree_order(x, 16)
    code, sums, counts, exact = V.assign(V.Tree(x[order], 16), centres, V.tree_order(centres, 1))
    brute_code = ((x[order][:, None] - centres[None]) ** 2).sum(2).argmin(1)
    assert (code == brute_code).all()
    assert (counts == np.bincount(brute_code, minlength=64)).all()
    assert (sums == np.array([x[order][brute_code == e].sum(0) for e in range(64)])).all()
    assert exact < len(x) / 4
