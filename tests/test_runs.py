import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from docgrain.operators import runs as H
from docgrain.operators.ingest import ingest_by_hash, record_pages
from docgrain.operators.ranking import mark_latest, split_row_number

RUN = "document_id string, extraction_run_id long, doc_type string, is_current boolean"


def flags(df):
    return {r.extraction_run_id: r.is_current for r in df.collect()}


def test_append_is_idempotent_in_effect(spark):
    docs = spark.createDataFrame([("a", None, "reviewed"), ("b", None, "uploaded")], "document_id string, doc_type string, status string")
    empty = spark.createDataFrame([], RUN)
    first = spark.createDataFrame([("a", 1, "invoice", None), ("a", 2, "petrol_bill", None), ("b", 3, "invoice", None)], RUN)
    runs, docs = H.append_extraction_run(empty, first, docs)
    assert flags(runs) == {1: False, 2: True, 3: True}
    runs, docs = H.append_extraction_run(runs, spark.createDataFrame([("a", 4, "invoice", None)], RUN), docs)
    assert flags(runs) == {1: False, 2: False, 3: True, 4: True}
    assert {r.document_id: (r.doc_type, r.status) for r in docs.collect()} == {
        "a": ("invoice", "extracted"), "b": ("invoice", "extracted"),
    }
    assert H.current_violations(runs, "document_id").count() == 0
    versioned = runs.withColumn("schema_version", F.lit("old"))
    grown, _ = H.append_extraction_run(versioned, spark.createDataFrame([("b", 9, "invoice", None)], RUN), docs)
    assert grown.filter("extraction_run_id = 9").first().schema_version == "extraction.v1"
    again, _ = H.append_extraction_run(runs, empty, docs)
    assert flags(again) == flags(runs)
    assert {r.extraction_run_id for r in H.current_runs(runs).collect()} == {3, 4}


@pytest.mark.parametrize("bucketed", [True, False])
def test_row_number_of_a_hot_key(spark, bucketed):
    rows = spark.range(30_000).select(
        F.when(F.col("id") < 10_000, 0).otherwise(F.col("id") % 97).alias("k"),
        (F.col("id") * 7919 % 30_011).alias("o"),
    )
    bucket = F.floor(F.col("o") / 500) if bucketed else None
    got = split_row_number(rows, ["k"], [F.col("o").asc()], bucket=bucket)
    rows.createOrReplaceTempView("hot_rows")
    want = spark.sql("SELECT k, o, row_number() OVER (PARTITION BY k ORDER BY o) AS rn FROM hot_rows")
    assert got.count() == 30_000
    assert got.exceptAll(want.select(*[F.col(c).cast(got.schema[c].dataType) for c in got.columns])).count() == 0


def test_hot_join_key_is_split(spark):
    """A document with a third of all runs: its join partition is split, not left to one task."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "64KB")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64KB")
    try:
        pages = spark.range(300_000).select(
            F.when(F.col("id") < 200_000, 7).otherwise(F.col("id")).alias("document_id"),
            F.sha2(F.col("id").cast("string"), 256).alias("blob_key"),
        )
        docs = spark.range(300_000).select(F.col("id").alias("document_id"), F.lit("x").alias("filename"))
        joined = pages.join(docs, "document_id").groupBy("filename").agg(
            F.count("*").alias("n"), F.max("blob_key")
        )
        assert joined.collect()[0].n == 300_000
        assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for key in (
            "spark.sql.autoBroadcastJoinThreshold",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes",
        ):
            spark.conf.unset(key)


def test_mark_latest_moves_no_hot_rows(spark):
    rows = spark.range(1000).select(F.lit("one").alias("document_id"), F.col("id").alias("extraction_run_id"))
    out = mark_latest(rows, "document_id", "extraction_run_id")
    assert out.filter("is_current").first().extraction_run_id == 999
    assert out.count() == 1000


def test_lookups(spark):
    pages = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "document_id string, page_no int")
    assert H.page_lookup(pages, "a", 2).count() == 1
    assert [r.page_no for r in H.list_pages(pages, "a").collect()] == [1, 2]
    asked = spark.createDataFrame([("b", 1), ("b", 1), ("z", 1)], "document_id string, page_no int")
    assert [r.document_id for r in H.pages_for(pages, asked).collect()] == ["b"]
    runs = spark.createDataFrame([("a", 1), ("b", 2)], "document_id string, extraction_run_id long")
    assert H.run_by_id(runs, 2).first().document_id == "b"
    assert H.runs_for(runs, runs.filter("document_id = 'a'")).count() == 1


def test_listing(spark, monkeypatch):
    day = dt.datetime(2024, 1, 1)
    docs = spark.createDataFrame([(i, day + dt.timedelta(days=i // 2)) for i in range(25)], "document_id long, created_at timestamp")
    page = H.list_documents(docs, page=2, size=10).collect()
    assert [r.document_id for r in page] == list(range(14, 4, -1))
    assert {(r.total, r.pages) for r in page} == {(25, 3)}
    assert H.page_request(0, 11) == (1, 20)
    monkeypatch.setattr(H, "DEEP", 5)
    deep = H.list_documents(docs, page=2, size=10).collect()
    assert sorted(map(repr, deep)) == sorted(map(repr, page))
    after = H.documents_after(docs, page[-1].created_at, page[-1].document_id, 10).collect()
    assert [r.document_id for r in after] == [4, 3, 2, 1, 0]


def test_constraints(spark):
    rows = spark.createDataFrame([(1, -1, "x", "[]"), (2, 0, "invoice", ' {"a":1}'), (3, None, "invoice", None)], "id int, duration_ms int, doc_type string, extracted string")
    out = H.check_constraints(rows, H.rules("extraction_run"))
    assert {(r.id, r.rule) for r in out.collect()} == {
        (1, "duration_nonneg"), (1, "doc_type_known"), (1, "extracted_is_object"),
        (3, "duration_nonneg"), (3, "extracted_is_object"),
    }
    refs = H.check_constraints(
        spark.createDataFrame([(0, "{}", "x", "[]")], "duration_ms int, scaffold_in string, scaffold_out string, patches string"),
        H.rules("refinement_run"),
    )
    assert [r.rule for r in refs.collect()] == ["scaffold_out_is_object"]
    with pytest.raises(ValueError):
        H.rules("nothing")


def test_ingest(spark):
    def name(content):
        return hashlib.sha256(content).hexdigest()[:32]

    ups = spark.createDataFrame(
        [(1, "a.pdf", "m", 1, b"x"), (2, "b.pdf", "m", 1, b"y"), (3, "c.pdf", "m", 1, b"x"), (4, "d.pdf", "m", 1, b"z")],
        "upload_ord long, filename string, mime_type string, size_bytes long, content binary",
    )
    known = spark.createDataFrame([("old", b"z")], "document_id string, content binary").select(
        "document_id", F.sha2("content", 256).alias("sha256")
    )
    docs, outcome = ingest_by_hash(ups, known)
    assert {r.upload_ord: (r.document_id, r.is_new) for r in outcome.collect()} == {
        1: (name(b"x"), True), 2: (name(b"y"), True), 3: (name(b"x"), False), 4: ("old", False),
    }
    names = {r.document_id: r.filename for r in docs.collect()}
    assert names == {"old": None, name(b"x"): "a.pdf", name(b"y"): "b.pdf"}
    again, second = ingest_by_hash(ups, docs)
    assert again.count() == 3 and second.filter("is_new").count() == 0


def test_record_pages(spark):
    ddl = "document_id string, page_no int, width_px int, height_px int"
    stored = spark.createDataFrame([("d", 1, 1, 1), ("d", 3, 3, 3)], ddl).withColumn("blob_key", F.lit("k"))
    new = spark.createDataFrame([("d", 1, 9, 9), ("d", 1002, 2, 2)], ddl)
    pages, counts = record_pages(stored, new)
    assert {r.page_no: (r.width_px, r.blob_key) for r in pages.collect()} == {
        1: (9, "pages/d/001.png"), 3: (3, "k"), 1002: (2, "pages/d/1002.png"),
    }
    assert counts.first().page_count == 2


def test_rows_named_by_two_columns(spark):
    """Turn numbers start anew in every conversation, however long the conversations are."""
    rows = [(1, 100_001), (1, 5), (2, 1), (2, 0)]
    runs = spark.createDataFrame([(*r, True) for r in rows[1:]], "extraction_run_id long, refinement_run_id long, is_current boolean")
    new = spark.createDataFrame(rows[:1], "extraction_run_id long, refinement_run_id long")
    stored = mark_latest(runs, "extraction_run_id", ["extraction_run_id", "refinement_run_id"])
    out = H.append_refinement_run(stored, new, ["extraction_run_id", "refinement_run_id"])
    assert {(r[0], r[1]) for r in out.filter("is_current").collect()} == {(1, 100_001), (2, 1)}
    assert out.count() == 4
