import zlib

import pytest
from edge_cases import edge_docs
from pyspark.sql import functions as F

from docgrain.llm import sharding


def check(docs, got, shards, largest_twice=2):
    rows = [(r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in docs.select("doc_id", "text").collect()]
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in got), key=repr) == sorted(rows, key=repr)
    assert {r.law for r in got} <= {"bytes"} and {r.grown_shard for r in got} <= {None}
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r)
    assert set(by) <= set(range(shards))
    for s in by.values():
        assert sorted(r.slot for r in s) == list(range(len(s)))
    most, target = max(r[1] for r in rows), sum(r[1] for r in rows) / shards
    for s in range(shards):
        assert abs(sum(r["size"] for r in by.get(s, [])) - target) <= largest_twice * most
    return by


@pytest.mark.parametrize("shards", [1, 3, 40])
def test_sizes_are_near_equal(spark, shards):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    by = check(docs, sharding.balanced_shards(docs, shards=shards).collect(), shards)
    # Copies that are small together lie in one shard.
    text = {r.doc_id: r.text for r in docs.collect()}
    most = max(len(t.encode()) for t in text.values())
    homes = {}
    for s, rows in by.items():
        for r in rows:
            homes.setdefault(text[r.doc_id], []).append(s)
    for t, where in homes.items():
        if (len(t.encode()) + 16) * len(where) <= most:
            assert len(set(where)) == 1


def test_one_group_of_copies_may_be_most_of_the_rows(spark):
    rows = [(i, "copy " * 20 if i % 2 else f"text {i} " * (i % 37)) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    check(docs, sharding.balanced_shards(docs, shards=10).collect(), 10)


def test_edges(spark):
    docs = edge_docs(spark)
    check(docs, sharding.balanced_shards(docs, shards=4).collect(), 4)
    assert sharding.balanced_shards(docs.limit(0)).count() == 0


def test_a_given_order_is_kept(spark):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), (F.col("id") % 50).cast("int")).alias("text"))
    got = sharding.balanced_shards(docs, shards=7, order=[-F.col("doc_id")]).collect()
    ordered = [r.doc_id for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert ordered == list(range(999, -1, -1))
    check(docs, got, 7, 1)


def test_groups_that_cross_range_partitions(spark):
    """Eight range partitions, and three groups of copies that no partition holds alone."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = [(i, f"group {i % 3}" if i % 10 else f"own {i}") for i in range(3000)]
        rows += [(5000 + i, "x" * 30_000) for i in range(2)]
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        by = check(docs, sharding.balanced_shards(docs, shards=5).collect(), 5)
        homes = {s for s, rs in by.items() for r in rs if r.doc_id < 5000 and r.doc_id % 10 and r.doc_id % 3 == 0}
        assert len(homes) == 1  # 900 copies, smaller together than the largest document
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
