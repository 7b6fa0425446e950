import datetime as dt
import json
import pathlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docgrain.functions.values import as_variant
from docgrain.operators import blocks as B
from docgrain.operators.evaluate import fixture_health
from docgrain.schemas import TABLES
from docgrain.sources import tables as S
from docgrain.sources import uploads as U


def test_scan_and_validate(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF")
    (tmp_path / "b.PNG").write_bytes(b"png")
    (tmp_path / "empty.pdf").write_bytes(b"")
    rows = U.scan_uploads(spark, str(tmp_path))
    seen = {r.filename: (r.mime_type, r.size_bytes) for r in rows.collect()}
    assert seen == {"a.pdf": ("application/pdf", 4), "b.PNG": ("image/png", 3)}
    # Spark's file source skips empty files; from another source they are refused.
    empty = spark.createDataFrame([("empty.pdf", "application/pdf", 0), (None, "application/pdf", 1)], "filename string, mime_type string, size_bytes long")
    ok, bad = U.validate_uploads(rows.drop("path", "content", "uploaded_at").unionByName(empty))
    assert [r.filename for r in ok.collect()] == ["a.pdf"]
    assert {r.filename: r.reject_reason for r in bad.collect()} == {
        "b.PNG": "not a pdf", "empty.pdf": "empty file", None: "missing filename",
    }
    assert U.scan_uploads(spark, str(tmp_path), "*.PNG").count() == 1


def test_blobs(spark, tmp_path):
    ddl = "key string, content binary"
    store = spark.createDataFrame([("a/1", b"x"), ("a/2", b"y")], ddl)
    puts = spark.createDataFrame(
        [("a/2", b"z", 1), ("a/2", b"w", 2), ("a/../b", b"q", 3), ("a/..b", b"q", 4)], ddl + ", put_ord long"
    )
    after, refused = U.blob_put(store, puts)
    assert {r.key: bytes(r.content) for r in after.collect()} == {"a/1": b"x", "a/2": b"w", "a/..b": b"q"}
    assert [r.key for r in refused.collect()] == ["a/../b"]
    gone = U.blob_delete(after, spark.createDataFrame([("a/1",), ("nope",)], "key string"))
    assert gone.count() == 2
    U.write_blobs(gone, str(tmp_path / "blobs"), files_per_shard=2)
    one = U.read_blobs(spark, str(tmp_path / "blobs"), "a/2")
    assert bytes(one.first().content) == b"w"
    assert "PartitionFilters: [isnotnull(shard" in one._jdf.queryExecution().executedPlan().toString()
    asked = spark.createDataFrame([("a/2",), ("no",)], "key string")
    assert {r.key: r.exists for r in U.blob_exists(gone, asked).collect()} == {"a/2": True, "no": False}
    assert U.blob_get(gone, asked).count() == 1
    assert [r.key for r in U.blob_missing(gone, asked).collect()] == ["no"]


def test_blobs_are_replaced_shard_by_shard(spark, tmp_path):
    path = str(tmp_path / "blobs")
    rows = [(f"k{i}", str(i).encode()) for i in range(600)]
    U.write_blobs(spark.createDataFrame(rows, "key string, content binary"), path)
    want = dict(rows)

    def state():
        return {r.key: bytes(r.content) for r in U.read_blobs(spark, path).collect()}

    def files():
        return {f.name for f in (tmp_path / "blobs").glob("shard=*/*.parquet")}

    before = files()
    puts = spark.createDataFrame([("k1", b"new"), ("fresh", b"f"), ("../x", b"no")], "key string, content binary")
    refused = U.update_blobs(spark, path, puts, spark.createDataFrame([("k2",), ("nope",)], "key string"))
    want |= {"k1": b"new", "fresh": b"f"}
    del want["k2"]
    assert [r.key for r in refused.collect()] == ["../x"]
    assert state() == want
    assert len(before - files()) <= 5  # the shards of five keys, of 200 and more
    # A shard that runs empty is empty afterwards.
    shards = {r.key: r.s for r in U.read_blobs(spark, path).select("key", U.shard(F.col("key")).alias("s")).collect()}
    gone = [k for k, s in shards.items() if s == shards["k7"]]
    U.update_blobs(spark, path, deletes=spark.createDataFrame([(k,) for k in gone], "key string"))
    assert state() == {k: v for k, v in want.items() if k not in gone}
    U.update_blobs(spark, path)
    assert len(state()) == len(want) - len(gone)


def test_table_versions(spark, tmp_path):
    root = str(tmp_path)
    assert S.read_table(spark, root, "extraction_run").count() == 0
    row = spark.createDataFrame([(1, "d", True, dt.datetime(2024, 1, 1)), (2, "d", False, dt.datetime(2024, 1, 2))], "extraction_run_id long, document_id string, is_current boolean, created_at timestamp")
    S.write_table(row, root, "extraction_run")
    S.write_table(row.filter("is_current"), root, "extraction_run")
    (tmp_path / "extraction_run" / "v=99999999999999999999-half").mkdir()
    back = S.read_table(spark, root, "extraction_run")
    assert [r.extraction_run_id for r in back.collect()] == [1]
    assert back.filter("is_current").count() == 1


@pytest.mark.parametrize("name", sorted(TABLES))
def test_every_table_round_trips(spark, tmp_path, name):
    schema = T.StructType.fromDDL(TABLES[name])

    def value(kind, i):
        if isinstance(kind, T.StringType):
            return f"s{i % 7}"
        if isinstance(kind, T.BooleanType):
            return i % 2 == 0
        if isinstance(kind, T.TimestampType):
            return dt.datetime(2024, 1, 1) + dt.timedelta(hours=i)
        if isinstance(kind, (T.IntegerType, T.LongType, T.ShortType)):
            return i
        if isinstance(kind, T.DoubleType):
            return i / 2
        return None

    rows = [tuple(None if i == 3 and f.nullable else value(f.dataType, i) for f in schema.fields) for i in range(50)]
    df = spark.createDataFrame(rows, schema)
    S.write_table(df, str(tmp_path), name)
    back = S.read_table(spark, str(tmp_path), name)
    assert back.schema.simpleString() == df.schema.simpleString()
    assert sorted(map(repr, back.collect())) == sorted(map(repr, df.collect()))


def test_a_lookup_reads_one_file(spark, tmp_path):
    rows = spark.range(0, 100_000, 1, 8).select(
        F.col("id").alias("field_review_id"), F.pmod(F.xxhash64("id"), F.lit(5000)).alias("extraction_run_id"), F.lit("f").alias("field_path")
    )
    # Small partitions would be joined into one file otherwise.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    path = S.write_table(rows, str(tmp_path), "field_review")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    column = [f.name for f in T.StructType.fromDDL(TABLES["field_review"]).fields].index("extraction_run_id")
    spans = []
    for f in pathlib.Path(path).glob("*.parquet"):
        meta = pq.ParquetFile(f).metadata
        for g in range(meta.num_row_groups):
            s = meta.row_group(g).column(column).statistics
            spans.append((s.min, s.max))
    assert len(spans) > 1
    for key in (17, 2500, 4999):
        assert sum(lo <= key <= hi for lo, hi in spans) <= 2


def test_evaluation_files(spark, tmp_path):
    case = {
        "dataset": "weighing", "case": "one", "inputs": {"pdf_path": "p.pdf"},
        "expected_output": {"net_weight": "1 t"}, "metadata": {"status": "ok"},
    }
    (tmp_path / "cases.json").write_text(json.dumps(case) + "\n")
    cases = S.load_eval_cases(spark, str(tmp_path / "cases.json"))
    row = cases.first()
    assert row.pdf_path == "p.pdf" and json.loads(row.expected) == {"net_weight": "1 t"}
    files = spark.createDataFrame([("other.pdf",)], "path string")
    found = {(r.dataset, r.problem) for r in fixture_health(cases, files, ["weighing", "invoice"]).collect()}
    assert found == {("invoice", "no cases"), ("weighing", "source file missing")}
    assert S.load_refinement_truth(spark, str(tmp_path / "nowhere")).count() == 0


def test_page_sizes(spark):
    infos = [
        ('{"0":{"width":10,"height":20},"2":{"page_width":5,"page_height":6},"x":{"width":1,"height":1}}', 2),
        ('[{"page":0,"width":1,"height":2},{"index":0,"width":3,"height":4},{"page":1,"width":0,"height":9},"odd"]', 2),
        (None, 1),
    ]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(infos)], "id int, j string, n int")
    rows = B.page_sizes(df.withColumn("info", as_variant(F.col("j"))), "info", "n", ["id"]).collect()
    assert {(r.id, r.page_no): (r.width, r.height) for r in rows} == {
        (0, 1): (10.0, 20.0), (0, 2): (612.0, 792.0), (0, 3): (5.0, 6.0),
        (1, 1): (3.0, 4.0), (1, 2): (612.0, 792.0), (2, 1): (612.0, 792.0),
    }


def test_page_count(spark):
    null = F.lit(None).cast("int")
    blocks = F.array(F.struct(F.lit(4).alias("page")), F.struct(null.alias("page")))
    none = F.array().cast("array<struct<page:int>>")
    row = spark.range(1).select(
        B.page_count(null, null, blocks), B.page_count(F.lit(2), F.lit(3), blocks),
        B.page_count(null, F.lit(3), blocks), B.page_count(null, null, none), B.page_count(F.lit(0), null, none),
    ).first()
    assert list(row) == [5, 2, 3, 1, 1]
