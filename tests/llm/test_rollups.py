import base64

import pytest
from edge_cases import edge_docs
from pyspark.sql import functions as F

from docgrain.llm import rollups

TOTALS = "source string, lang string, tokenizer string, docs long, tokens long"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_batches_apply_once_in_any_order(spark, tmp_path):
    docs = edge_docs(spark)
    counted = rollups.count_tokens(docs)
    more = counted.withColumn("tokens", F.col("tokens") + 3)
    moved = more.withColumn("source", F.lit("z"))
    batches = {
        "a": rollups.inserts(counted),
        "b": rollups.revisions(counted, more),
        "c": rollups.revisions(more, moved),
        "d": rollups.deletes(moved.filter("doc_id = 5")),
    }
    want = rows(moved.filter("doc_id <> 5 OR doc_id IS NULL").groupBy("source", "lang", "tokenizer").agg(F.count("*"), F.sum("tokens")))
    for order, compact_after in (("abcd", None), ("dcba", 1), ("badc", 2)):
        store = rollups.TokenRollup(spark, f"{tmp_path}/{order}")
        assert rows(store.totals()) == []
        for i, b in enumerate(order):
            assert store.commit(b, batches[b])
            assert not store.commit(b, batches[b])
            if i == compact_after:
                store.compact()
                assert not store.commit(b, batches[b])
        assert rows(store.totals()) == want
        store.compact()
        store.compact()
        assert rows(store.totals()) == want
        assert store.batches() == ["a", "b", "c", "d"]


def test_broken_batches_do_not_count_and_can_be_retried(spark, tmp_path):
    store = rollups.TokenRollup(spark, str(tmp_path))
    one = spark.createDataFrame([("s", None, "t", 1, 5), ("s", None, "t", None, None)], TOTALS)
    assert store.commit("x", one)
    (tmp_path / "deltas" / "batch=x" / "_SUCCESS").unlink()
    assert rows(store.totals()) == []
    assert store.commit("x", one)
    assert rows(store.totals()) == [("s", None, "t", 1, 5)]
    store.compact()
    (tmp_path / "base" / "v000000001" / "_SUCCESS").unlink()
    assert rows(store.totals()) == [("s", None, "t", 1, 5)]


def test_emptied_keys_go_and_empty_batches_count_as_applied(spark, tmp_path):
    store = rollups.TokenRollup(spark, str(tmp_path))
    one = spark.createDataFrame([("s", "l", "t", 1, 5)], TOTALS)
    assert store.commit("none", one.limit(0))
    assert not store.commit("none", one)
    store.commit("in", one)
    store.commit("out", one.select("source", "lang", "tokenizer", (-F.col("docs")).alias("docs"), (-F.col("tokens")).alias("tokens")))
    assert rows(store.totals()) == []
    with pytest.raises(ValueError):
        store.commit("../x", one)


def test_counts(spark):
    docs = edge_docs(spark)
    counted = {(r.doc_id, r.tokenizer): r.tokens for r in rollups.count_tokens(docs).collect()}
    for r in docs.collect():
        assert counted[r.doc_id, "words-1"] == len((r.text or "").split())
    assert counted[8, "alnum-1"] == 2
    assert counted[11, "alnum-1"] == 2 + 6 + 5
    assert rollups.count_tokens(docs.limit(0)).count() == 0


def test_byte_pair_counts_equal_the_tokenizer(spark, sf):
    tiktoken = pytest.importorskip("tiktoken")
    public = pytest.importorskip("public_tokenizers")
    path = str(public.path("byte_bpe_50k.tiktoken"))
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    coder = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(30).union(edge_docs(spark, clashing=False))
    got = rollups.count_bpe_tokens(docs, path, public.PATTERN, "bpe-1")
    want = [(r.doc_id, r.source, r.lang, "bpe-1", len(coder.encode_ordinary(r.text or ""))) for r in docs.collect()]
    assert rows(got) == sorted(want, key=repr)
