import zlib

import pytest
from edge_cases import edge_docs
from pyspark.sql import functions as F
from test_contamination import BENCH
from test_contamination import brute as contaminated
from test_langid import letters
from test_simhash import brute_components, brute_fingerprint

import corpus_pipeline
from docgrain.llm import langid, mixing

NAMES = ["language_id", "simhash_near_dedup", "decontamination", "source_mix", "sharding"]


def staged(spark, docs, sf_dir, folder):
    """Rows after each stage, the way the stages are run: written and read again."""
    out = []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        out.append(docs)
    return out


def check(docs, bench, stages):
    columns = docs.columns
    rows = [r.asDict() for r in docs.collect()]
    known, unique, clean, mixed, shards = stages
    # The predictions themselves are tested against brute force in test_langid.
    sure = {r.doc_id for r in langid.identify(docs).filter("score >= 0.5").collect()}
    want = [r for r in rows if letters(r["text"]) and r["doc_id"] in sure]
    assert known.columns == columns and sorted(map(repr, (r.asDict() for r in known.collect()))) == sorted(map(repr, want))

    prints = [(r["doc_id"], brute_fingerprint(r["text"])) for r in want]
    first, kept = brute_components(prints), {}
    for r, c in zip(want, first, strict=True):
        if c == r["doc_id"]:
            kept[c] = r
    got = [r.asDict() for r in unique.collect()]
    assert unique.columns == columns
    assert sorted(map(repr, got)) == sorted(map(repr, kept.values()))

    bad = {r[0] for r in contaminated([(r["doc_id"], r["text"]) for r in kept.values()], bench) if r[-1]}
    want = sorted(map(repr, (r for r in kept.values() if r["doc_id"] not in bad)))
    assert clean.columns == columns and sorted(map(repr, (r.asDict() for r in clean.collect()))) == want
    assert mixed.columns == columns and sorted(map(repr, (r.asDict() for r in mixed.collect()))) == want

    # Shards are contiguous in the order of the mix.
    got = sorted(shards.collect(), key=lambda r: (r.shard, r.slot))
    assert [r.doc_id for r in got] == [r.doc_id for r in sorted(mixing.mix_order(clean).collect(), key=lambda r: r.position)]
    text = {r.doc_id: r.text for r in mixed.collect()}
    for r in got:
        data = (text[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(data) + 16, zlib.crc32(data))


def test_stages_equal_brute_force(spark, sf, tmp_path):
    assert [n for n, _ in corpus_pipeline.STAGES] == NAMES
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    stages = staged(spark, docs, sf, tmp_path)
    assert docs.count() > stages[1].count() > stages[2].count() > 100
    check(docs, bench, stages)
    ran = corpus_pipeline.run(spark, sf).collect()
    assert sorted(map(repr, ran)) == sorted(map(repr, stages[-1].collect()))


def test_edges(spark, tmp_path):
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{tmp_path}/in/benchmark.parquet")
    docs = edge_docs(spark)
    check(docs, BENCH, staged(spark, docs, f"{tmp_path}/in", tmp_path / "a"))
    empty = staged(spark, docs.limit(0), f"{tmp_path}/in", tmp_path / "b")
    assert [s.count() for s in empty] == [0] * 5


@pytest.mark.parametrize("stage", range(5))
def test_each_stage_takes_rows_that_no_stage_before_it_has_seen(spark, tmp_path, stage):
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    name, fn = corpus_pipeline.STAGES[stage]
    docs = edge_docs(spark).withColumn("extra", F.create_map(F.lit("a"), F.lit(1)))
    out = fn(spark, docs, str(tmp_path))
    if stage < 4:
        assert out.columns == docs.columns
    assert out.count() > 0


def test_rows_without_id_and_different_texts_of_one_id_stay(spark, tmp_path):
    text = lambda k, n=60: " ".join(f"t{k}w{i}" for i in range(n))
    rows = [
        (None, text(0), "en", "a", 1),  # a copy of the document with id 1
        (1, text(0), "en", "a", 1),
        (None, text(1), "en", "a", 1),
        (None, text(2), "en", "b", 1),
        (None, text(2), "en", "b", 1),  # copies without id: one stays
        (None, text(3), None, None, 1),
        (5, text(4), "en", "a", 1),  # one id, two texts
        (5, text(5), "en", "a", 1),
        (6, text(5), "en", "a", 1),
        (7, text(4), "en", "a", 1),
        (8, text(6), "en", "a", 1),
        (8, text(6).upper(), "en", "a", 1),  # one id, one fingerprint
    ]
    out = corpus_pipeline.drop_near_duplicates(spark, edge_docs(spark, rows), str(tmp_path))
    got = sorted((repr(r.doc_id), r.text) for r in out.collect())
    want = [(None, text(1)), (None, text(2)), (None, text(3)), (1, text(0)), (5, text(4)), (5, text(5)), (8, text(6).upper())]
    assert got == sorted((repr(i), t) for i, t in want)


def test_near_copies_without_id_leave_one_row(spark, tmp_path):
    base = [f"common{i}" for i in range(400)]
    rows = [(None, " ".join([*base[:200], f"change{k}", *base[200:]]), "en", "a", k) for k in range(6)]
    out = corpus_pipeline.drop_near_duplicates(spark, edge_docs(spark, rows), str(tmp_path))
    assert out.count() == 1
