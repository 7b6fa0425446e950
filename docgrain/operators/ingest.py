"""Documents and pages entering the store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.uploads import document_key, page_key


def ingest_by_hash(uploads: DataFrame, documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Upsert uploads by content hash.

    ``uploads``: upload_ord, filename, mime_type, size_bytes, uploaded_by, content, created_at.
    Returns the documents after the upload and, per upload, the document it resolved to and
    ``is_new``. The first upload of a hash wins and keeps its file name; re-uploads write
    nothing. A new document is named after its content, so loads that number their uploads anew
    cannot give two documents one id. Contents take no part in any shuffle: only the hash and the metadata travel.
    """
    hashed = uploads.withColumn("sha256", F.sha2("content", 256)).drop("content")
    meta = [c for c in hashed.columns if c not in ("sha256", "upload_ord")]
    first = (
        hashed.groupBy("sha256")
        .agg(F.min_by(F.struct("upload_ord", *meta), "upload_ord").alias("u"))
        .select("sha256", "u.*")
    )
    known = documents.select("sha256", F.col("document_id").alias("known_id"))
    resolved = first.join(known, "sha256", "left").withColumn(
        "document_id", F.coalesce("known_id", F.substring("sha256", 1, 32))
    )
    fresh = resolved.filter("known_id IS NULL").select(
        "document_id",
        *meta,
        document_key(F.col("sha256")).alias("blob_key"),
        "sha256",
        F.lit("uploaded").alias("status"),
    )
    winners = resolved.select(
        F.col("sha256").alias("w_sha"),
        "document_id",
        F.when(F.col("known_id").isNull(), F.col("upload_ord")).alias("w_ord"),
    )
    outcome = hashed.join(winners, F.col("sha256") == F.col("w_sha")).select(
        "upload_ord",
        "sha256",
        "document_id",
        F.coalesce(F.col("upload_ord") == F.col("w_ord"), F.lit(False)).alias("is_new"),
    )
    return documents.unionByName(fresh, allowMissingColumns=True), outcome


def record_pages(stored: DataFrame, rendered: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Upsert rendered pages by (document, page) and count the pages of each rendering.

    Stored pages beyond the new rendering stay. Returns the pages and, per rendered document,
    ``page_count`` = number of pages in this rendering.
    """
    keys = ["document_id", "page_no"]
    new = rendered.select(
        *keys,
        F.col("width_px").alias("new_w"),
        F.col("height_px").alias("new_h"),
        page_key(F.col("document_id"), F.col("page_no")).alias("new_key"),
    )
    pages = stored.join(new, keys, "full_outer").select(
        *keys,
        F.coalesce("new_w", "width_px").alias("width_px"),
        F.coalesce("new_h", "height_px").alias("height_px"),
        F.coalesce("new_key", "blob_key").alias("blob_key"),
    )
    counts = rendered.groupBy("document_id").agg(F.count("*").cast("int").alias("page_count"))
    return pages, counts
