import re
from itertools import combinations

import numpy as np
import pytest
import xxhash
from edge_cases import edge_docs
from pyspark.sql import functions as F

from docgrain.llm import components, simhash


def brute_fingerprint(text, size=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, distance=4):
    """prints: [(id, fingerprint)] -> component per entry, the smallest id that can be reached."""
    up = list(range(len(prints)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in combinations(range(len(prints)), 2):
        if (prints[i][1] ^ prints[j][1]).bit_count() <= distance:
            up[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return [low.get(root(i)) for i in range(len(prints))]


def result(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=repr)


def expected(rows):
    prints = [(d, brute_fingerprint(t)) for d, t in rows]
    return sorted(((d, f"{f:016x}", c) for (d, f), c in zip(prints, brute_components(prints), strict=True)), key=repr)


def test_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert result(simhash.simhash_components(docs)) == expected(rows)


def test_edges(spark):
    docs = edge_docs(spark)
    assert result(simhash.simhash_components(docs)) == expected([(r.doc_id, r.text) for r in docs.collect()])
    assert result(simhash.simhash_components(docs.limit(0))) == []


@pytest.mark.parametrize("chunk", [3, 4096])
def test_near_edges_lose_no_link(spark, chunk):
    """Chains, dense groups and noise; small chunks make every bucket hot."""
    rng = np.random.default_rng(5)
    prints = {0, 2**63, 2**64 - 1}
    for _ in range(12):
        at = int(rng.integers(0, 2**63)) * 2 + 1
        for _ in range(30):  # a walk: neighbours are close, ends are not
            for b in rng.choice(64, int(rng.integers(1, 5)), replace=False):
                at ^= 1 << int(b)
            prints.add(at)
    prints |= {int(x) for x in rng.integers(0, 2**63, 100)}
    prints = sorted(prints)
    signed = [p - 2**64 if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p,) for p in signed], "fp long")
    edges = simhash.near_edges(df, 4, chunk)
    got = {r.node: r.component for r in components.components(edges).collect()}
    want = brute_components(list(zip(signed, prints, strict=True)))
    assert [got.get(p, p) for p in signed] == want
    for r in edges.collect():
        assert ((r.a ^ r.b) & (2**64 - 1)).bit_count() <= 4


def test_any_number_of_blocks_finds_every_close_pair(spark):
    for blocks in (5, 6, 7, 8):
        rng = np.random.default_rng(blocks)
        base = rng.integers(0, 2**63, 200)
        near = [int(b) ^ sum(1 << int(x) for x in rng.choice(63, 4, replace=False)) for b in base]
        df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(base, near, strict=True)], "a long, b long")
        keys = list(zip(simhash.block_keys(F.col("a"), blocks, 4), simhash.block_keys(F.col("b"), blocks, 4), strict=True))
        shared = sum((x == y).cast("int") for x, y in keys)
        assert df.filter(shared == 0).count() == 0


def test_components_of_a_long_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 180)]
    star = [(5000, i) for i in range(5001, 5400)]
    df = spark.createDataFrame([*chain, *star, (7, 7), (None, 8), (120, 100), (101, 100)], "a long, b long")
    got = {r.node: r.component for r in components.components(df).collect()}
    assert got == {i: 100 for i in range(100, 181)} | {i: 5000 for i in range(5000, 5400)}
    assert components.components(df.limit(0)).count() == 0
