"""Uploads, blob keys, payload parsing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..operators import ingest
from ..session import work_path
from ..sources import payloads, tables, uploads
from .registry import BLOCKS_CTE, page_blocks, query, reviews, spread, table


def _uploads(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select(
        F.col("doc_id").alias("upload_ord"),
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("filename"),
        F.lit(None).cast("string").alias("mime_type"),
        F.octet_length("text").cast("long").alias("size_bytes"),
        F.col("text").cast("binary").alias("content"),
        "lang",
    )


def _stored(spark, sf):
    """Documents an earlier load of the German source files left behind."""
    known = _uploads(spark, sf).filter("lang = 'de'")
    return (
        known.groupBy(F.sha2("content", 256).alias("sha256"))
        .agg(F.min("upload_ord").cast("string").alias("document_id"))
    )


@query(
    "ingest_dedupe",
    """
WITH h AS (SELECT doc_id, lang, sha256(text) AS sha FROM documents),
known AS (SELECT sha, min(doc_id) AS kid FROM h WHERE lang = 'de' GROUP BY sha),
fst AS (SELECT sha, min(doc_id) AS fid FROM h GROUP BY sha)
SELECT h.doc_id AS upload_ord, h.sha AS sha256,
       coalesce(CAST(kid AS VARCHAR), substr(h.sha, 1, 32)) AS document_id,
       (kid IS NULL AND h.doc_id = fid) AS is_new
FROM h JOIN fst USING (sha) LEFT JOIN known USING (sha)
""",
)
def ingest_dedupe(spark, sf):
    return ingest.ingest_by_hash(_uploads(spark, sf).drop("lang"), _stored(spark, sf))[1]


@query(
    "ingested_documents",
    """
WITH h AS (SELECT doc_id, lang, source, strlen(text) AS n, sha256(text) AS sha FROM documents),
known AS (SELECT DISTINCT sha FROM h WHERE lang = 'de'),
fst AS (SELECT sha, min(doc_id) AS fid FROM h WHERE sha NOT IN (SELECT sha FROM known) GROUP BY sha)
SELECT substr(sha, 1, 32) AS document_id, source || '/' || fid AS filename, n AS size_bytes,
       'documents/' || substr(sha, 1, 2) || '/' || sha || '.pdf' AS blob_key, 'uploaded' AS status
FROM fst JOIN h USING (sha) WHERE h.doc_id = fid
""",
)
def ingested_documents(spark, sf):
    docs, _ = ingest.ingest_by_hash(_uploads(spark, sf).drop("lang"), _stored(spark, sf))
    return docs.filter("status = 'uploaded'").select(
        "document_id", "filename", "size_bytes", "blob_key", "status"
    )


@query(
    "ingest_two_batches",
    """
WITH h AS (SELECT doc_id, source, lang IN ('en', 'fr') AS early, sha256(text) AS sha FROM documents),
a AS (SELECT sha, min(doc_id) AS id FROM h WHERE early GROUP BY 1),
b AS (SELECT sha, min(doc_id) AS id FROM h WHERE NOT early AND sha NOT IN (SELECT sha FROM a) GROUP BY 1),
w AS (SELECT * FROM a UNION ALL SELECT * FROM b)
SELECT substr(w.sha, 1, 32) AS document_id, source || '/' || id AS filename, w.sha AS sha256 FROM w JOIN h ON doc_id = id
""",
)
def ingest_two_batches(spark, sf):
    """Two loads whose upload numbers overlap; every content ends up under one id of its own."""
    rows = _uploads(spark, sf)
    none = rows.limit(0).select(F.lit("").alias("sha256"), F.lit("").alias("document_id"))
    early = F.col("lang").isin("en", "fr")
    first, _ = ingest.ingest_by_hash(rows.filter(early).drop("lang"), none)
    later = rows.filter(~early).drop("lang").withColumn("upload_ord", F.col("upload_ord") - 1)
    both, _ = ingest.ingest_by_hash(later, first)
    return both.select("document_id", "filename", "sha256")


@query(
    "page_key_format",
    """
SELECT o_orderkey, 'pages/' || o_custkey || '/' || format('{:03d}', o_orderkey) || '.png' AS blob_key
FROM orders
""",
)
def page_key_format(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", uploads.page_key(F.col("o_custkey"), F.col("o_orderkey")).alias("blob_key")
    )


@query(
    "reject_uploads",
    """
WITH u AS (
  SELECT doc_id, CASE WHEN source <> 'src0' THEN doc_id || CASE lang WHEN 'en' THEN '.PDF' ELSE '.txt' END END AS filename,
         CASE lang WHEN 'en' THEN 'application/octet-stream' WHEN 'fr' THEN 'text/plain'
                   ELSE 'application/pdf' END AS mime_type,
         CASE WHEN source = 'src1' THEN 0 ELSE n_chars END AS size_bytes
  FROM documents)
SELECT doc_id, CASE WHEN filename IS NULL THEN 'missing filename' WHEN size_bytes = 0 THEN 'empty file'
       ELSE 'not a pdf' END AS reject_reason
FROM u WHERE filename IS NULL OR size_bytes = 0
   OR NOT (mime_type = 'application/pdf' OR lower(filename) LIKE '%.pdf')
""",
)
def reject_uploads(spark, sf):
    docs = table(spark, sf, "documents")
    suffix = F.when(F.col("lang") == "en", ".PDF").otherwise(".txt")
    declared = F.when(F.col("lang") == "en", "application/octet-stream").when(
        F.col("lang") == "fr", "text/plain"
    )
    rows = docs.select(
        "doc_id",
        F.when(
            F.col("source") != "src0", F.concat(F.col("doc_id").cast("string"), suffix)
        ).alias("filename"),
        uploads.media_type(declared).alias("mime_type"),
        F.when(F.col("source") == "src1", 0).otherwise(F.col("n_chars")).alias("size_bytes"),
    )
    return uploads.validate_uploads(rows)[1].select("doc_id", "reject_reason")


def _blob_store(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select(
        F.concat(F.lit("documents/"), "source", F.lit("/"), F.col("doc_id").cast("string")).alias(
            "key"
        ),
        F.col("text").cast("binary").alias("content"),
    )


def _labelled(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang")
    return table(spark, sf, "labels").join(docs, "doc_id").withColumn(
        "key", F.concat(F.lit("documents/"), "source", F.lit("/"), F.col("doc_id").cast("string"))
    )


@query(
    "keyed_put_delete",
    """
WITH d AS (SELECT doc_id, 'documents/' || source || '/' || doc_id AS key, source, lang, text FROM documents),
put AS (SELECT key, source || ':' || lang AS text FROM labels JOIN d USING (doc_id) WHERE toxic = 1),
del AS (SELECT key FROM labels JOIN d USING (doc_id) WHERE quality = 0),
merged AS (SELECT key, text FROM d WHERE key NOT IN (SELECT key FROM put) UNION ALL SELECT key, text FROM put)
SELECT key, CAST(strlen(text) AS BIGINT) AS n_bytes, sha256(text) AS sha256
FROM merged WHERE key NOT IN (SELECT key FROM del)
""",
)
def keyed_put_delete(spark, sf):
    labelled = _labelled(spark, sf)
    puts = labelled.filter("toxic = 1").select(
        "key", F.concat("source", F.lit(":"), "lang").cast("binary").alias("content")
    )
    store, _ = uploads.blob_put(_blob_store(spark, sf), puts)
    left = uploads.blob_delete(store, labelled.filter("quality = 0"))
    return left.select(
        "key",
        F.octet_length("content").cast("long").alias("n_bytes"),
        F.sha2("content", 256).alias("sha256"),
    )


@query(
    "keyed_update_in_place",
    """
WITH d AS (SELECT doc_id, 'documents/' || source || '/' || doc_id AS key, source, lang, text FROM documents),
put AS (SELECT key, source || ':' || lang AS text FROM labels JOIN d USING (doc_id) WHERE toxic = 1),
del AS (SELECT key FROM labels JOIN d USING (doc_id) WHERE quality = 0),
merged AS (SELECT key, text FROM d WHERE key NOT IN (SELECT key FROM put) UNION ALL SELECT key, text FROM put)
SELECT key, sha256(text) AS sha256 FROM merged WHERE key NOT IN (SELECT key FROM del)
""",
)
def keyed_update_in_place(spark, sf):
    """The same puts and deletes on a stored table, shard by shard."""
    path = work_path(spark, "blobs")
    uploads.write_blobs(_blob_store(spark, sf), path)
    labelled = _labelled(spark, sf)
    puts = labelled.filter("toxic = 1").select(
        "key", F.concat("source", F.lit(":"), "lang").cast("binary").alias("content")
    )
    uploads.update_blobs(spark, path, puts, labelled.filter("quality = 0"))
    return uploads.read_blobs(spark, path).select("key", F.sha2("content", 256).alias("sha256"))


@query(
    "keyed_missing",
    """
SELECT 'documents/' || source || '/' || doc_id AS key FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
""",
)
def keyed_missing(spark, sf):
    return uploads.blob_missing(_labelled(spark, sf), _blob_store(spark, sf))


@query(
    "keyed_exists",
    """
SELECT 'documents/' || source || '/' || doc_id AS key, toxic IS NOT NULL AS "exists"
FROM documents LEFT JOIN labels USING (doc_id)
""",
)
def keyed_exists(spark, sf):
    stored = _labelled(spark, sf).select("key")
    return uploads.blob_exists(stored, _blob_store(spark, sf).select("key"))


@query(
    "keyed_get",
    """
SELECT 'documents/' || source || '/' || doc_id AS key, sha256(text) AS sha256
FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1)
""",
)
def keyed_get(spark, sf):
    wanted = _labelled(spark, sf).filter("quality = 1")
    return uploads.blob_get(_blob_store(spark, sf), wanted).select(
        "key", F.sha2("content", 256).alias("sha256")
    )


@query(
    "upsert_pages",
    """
WITH p AS (SELECT l_orderkey AS document_id, l_linenumber AS page_no, l_linestatus AS st,
                  CAST(max(l_quantity) AS INT) AS w, CAST(max(l_partkey) AS INT) AS h
           FROM lineitem GROUP BY ALL),
old AS (SELECT * FROM p WHERE st = 'F'), neu AS (SELECT * FROM p WHERE st = 'O'),
cnt AS (SELECT document_id, CAST(count(*) AS INT) AS page_count FROM neu GROUP BY 1)
SELECT document_id, page_no, coalesce(neu.w, old.w) AS width_px, coalesce(neu.h, old.h) AS height_px,
       CASE WHEN neu.w IS NULL THEN 'scan' ELSE 'pages/' || document_id || '/' || format('{:03d}', page_no) || '.png' END AS blob_key,
       page_count
FROM old FULL JOIN neu USING (document_id, page_no) LEFT JOIN cnt USING (document_id)
""",
)
def upsert_pages(spark, sf):
    pages = (
        table(spark, sf, "lineitem")
        .groupBy(
            F.col("l_orderkey").alias("document_id"),
            F.col("l_linenumber").alias("page_no"),
            F.col("l_linestatus").alias("st"),
        )
        .agg(
            F.max("l_quantity").cast("int").alias("width_px"),
            F.max("l_partkey").cast("int").alias("height_px"),
        )
        .withColumn("blob_key", F.lit("scan"))
    )
    stored = pages.filter("st = 'F'").drop("st")
    rendered = pages.filter("st = 'O'").drop("st", "blob_key")
    merged, counts = ingest.record_pages(stored, rendered)
    return merged.join(counts, "document_id", "left")


# ---- payloads -------------------------------------------------------------------------------------


@query(
    "ocr_payload",
    f"""
WITH {BLOCKS_CTE},
per AS (SELECT page_id, url, count(*) AS n, sum(length(html)) AS c, max(page) + 1 AS pc FROM blk GROUP BY ALL)
SELECT page_id, CASE WHEN starts_with(url, 'https') THEN CAST(n AS INT) END AS n_blocks,
       CASE WHEN starts_with(url, 'https') THEN CAST(c AS BIGINT) END AS html_chars,
       CASE WHEN starts_with(url, 'https') THEN CAST(pc AS INT) END AS page_count
FROM per
""",
)
def ocr_payload(spark, sf):
    blocks = page_blocks(spark, sf)
    last = F.array_max(F.transform("blocks", lambda b: b["page"])) + 1
    whole = F.struct("blocks", F.struct(last.alias("page_count")).alias("metadata"))
    # A payload that is not an object (a bare block list) is no payload.
    raw = F.when(F.col("url").startswith("https"), F.to_json(whole)).otherwise(F.to_json("blocks"))
    parsed = payloads.parse_ocr_payload(blocks.select("page_id", raw.alias("payload")), "payload")
    chars = F.aggregate(
        F.col("ocr.blocks"), F.lit(0).cast("long"), lambda a, b: a + F.length(b["html"])
    )
    return parsed.select(
        "page_id",
        F.when(F.col("ocr").isNotNull(), F.size("ocr.blocks")).alias("n_blocks"),
        chars.alias("html_chars"),
        F.col("ocr.metadata.page_count").alias("page_count"),
    )


def invoice_json(spark, sf):
    """Orders as invoice records; open ones carry a wrong type, pending ones an unknown key."""
    orders = spread(table(spark, sf, "orders"), "o_orderkey")
    item = F.struct(
        F.col("o_orderpriority").alias("description"),
        F.col("o_orderkey").cast("string").alias("quantity"),
    )
    number = F.concat(F.lit("INV-"), F.col("o_orderkey").cast("string"))
    base = [
        number.alias("invoice_number"),
        F.col("o_orderdate").cast("date").cast("string").alias("invoice_date"),
    ]
    good = F.to_json(F.struct(*base, F.array(item).alias("items")))
    unknown = F.to_json(F.struct(*base, F.col("o_orderstatus").alias("currency")))
    wrong = F.to_json(F.struct(*base, F.col("o_custkey").alias("terms"), F.lit("x").alias("items")))
    st = F.col("o_orderstatus")
    return orders.select(
        "o_orderkey",
        F.when(st == "F", good).when(st == "P", unknown).otherwise(wrong).alias("extracted"),
    )


@query(
    "blob_table",
    "SELECT source || '/' || doc_id AS key, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents",
)
def blob_table(spark, sf):
    """Documents written as a blob table in hash shards and read back."""
    path = work_path(spark, "blobs")
    store = table(spark, sf, "documents").select(
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("key"),
        F.col("text").cast("binary").alias("content"),
    )
    uploads.write_blobs(store, path)
    return uploads.read_blobs(spark, path).select(
        "key", F.octet_length("content").cast("long").alias("n_bytes")
    )


@query(
    "stored_reviews",
    """
SELECT event_id AS field_review_id, user_id AS extraction_run_id, event_type AS field_path,
       CAST(value AS VARCHAR) AS edited_value, ts AS created_at FROM events
""",
)
def stored_reviews(spark, sf):
    """Reviews written as a table version and read back."""
    root = work_path(spark, "tables")
    tables.write_table(reviews(spark, sf), root, "field_review")
    return tables.read_table(spark, root, "field_review").select(
        "field_review_id", "extraction_run_id", "field_path", "edited_value", "created_at"
    )


@query(
    "eval_cases",
    """
SELECT o_orderpriority AS dataset, 'case-' || o_orderkey AS "case", o_orderkey || '.pdf' AS pdf_path,
       'INV-' || o_orderkey AS invoice_number, o_orderstatus AS status
FROM orders WHERE o_orderstatus = 'F'
""",
)
def eval_cases(spark, sf):
    """Evaluation cases written as JSON lines, loaded, and typed strictly."""
    path = work_path(spark, "cases")
    records = invoice_json(spark, sf)
    orders = table(spark, sf, "orders").join(records, "o_orderkey")
    key = F.col("o_orderkey").cast("string")
    orders.select(
        F.col("o_orderpriority").alias("dataset"),
        F.concat(F.lit("case-"), key).alias("case"),
        F.struct(F.concat(key, F.lit(".pdf")).alias("pdf_path")).alias("inputs"),
        F.col("extracted").alias("expected_output"),
        F.struct(F.col("o_orderstatus").alias("status")).alias("metadata"),
    ).write.json(path)
    cases = payloads.parse_extracted(tables.load_eval_cases(spark, path), "expected", "invoice")
    return cases.filter("record IS NOT NULL").select(
        "dataset", "case", "pdf_path", F.col("record.invoice_number").alias("invoice_number"), "status"
    )


@query(
    "refinement_truth",
    """
SELECT o_orderkey AS extraction_run_id, 1 AS page_no, 'total' AS field_key, o_orderstatus AS fragment_id, CAST(o_custkey AS DOUBLE) AS l FROM orders
UNION ALL SELECT o_orderkey, 1, 'terms', o_orderpriority, CAST(0 AS DOUBLE) FROM orders
""",
)
def refinement_truth(spark, sf):
    """Per-page truth written as JSON lines and loaded as a long table."""
    path = work_path(spark, "truth")

    def field(fragment, left):
        zero = F.lit(0.0)
        return F.struct(F.col(fragment).alias("fragment_id"), G.box(left, zero, zero, zero).alias("bbox"))

    table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("extraction_run_id"),
        F.lit(1).alias("page_no"),
        F.create_map(
            F.lit("total"), field("o_orderstatus", F.col("o_custkey")),
            F.lit("terms"), field("o_orderpriority", F.lit(0)),
        ).alias("fields"),
    ).write.json(path)
    return tables.load_refinement_truth(spark, path).select(
        "extraction_run_id", "page_no", "field_key", "fragment_id", F.col("bbox.l").alias("l")
    )


@query(
    "strict_records",
    """
SELECT o_orderkey,
       CASE o_orderstatus WHEN 'F' THEN '' WHEN 'P' THEN 'unknown:currency' ELSE 'type:items,type:terms' END AS errors,
       CASE o_orderstatus WHEN 'F' THEN 'INV-' || o_orderkey END AS invoice_number,
       CASE o_orderstatus WHEN 'F' THEN strftime(o_orderdate, '%Y-%m-%d') END AS invoice_date,
       CASE o_orderstatus WHEN 'F' THEN o_orderpriority END AS first_item
FROM orders
""",
)
def strict_records(spark, sf):
    out = payloads.parse_extracted(invoice_json(spark, sf), "extracted", "invoice")
    return out.select(
        "o_orderkey",
        F.array_join("errors", ",").alias("errors"),
        F.col("record.invoice_number").alias("invoice_number"),
        F.col("record.invoice_date").alias("invoice_date"),
        F.get("record.items", F.lit(0)).getField("description").alias("first_item"),
    )


