"""Uploaded files: scan, validate, store bytes under keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import media_type

def scan_uploads(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """One row per file below ``path`` whose name matches ``glob``; empty files give none.

    A job that does not select ``content`` reads the listing only.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    declared = (
        F.when(ext == "png", "image/png")
        .when(ext.isin("jpg", "jpeg"), "image/jpeg")
    )
    return files.select(
        F.col("path"),
        name.alias("filename"),
        media_type(declared).alias("mime_type"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("uploaded_at"),
        "content",
    )


def reject_reason(filename: Column, mime_type: Column, size_bytes: Column) -> Column:
    """Why an upload is refused, or null."""
    is_pdf = (mime_type == "application/pdf") | F.lower(filename).endswith(".pdf")
    return (
        F.when(filename.isNull(), "missing filename")
        .when(F.coalesce(size_bytes, F.lit(0)) == 0, "empty file")
        .when(~F.coalesce(is_pdf, F.lit(False)), "not a pdf")
    )


def validate_uploads(uploads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split into accepted rows and rejected rows with ``reject_reason``."""
    judged = uploads.withColumn(
        "reject_reason",
        reject_reason(F.col("filename"), F.col("mime_type"), F.col("size_bytes")),
    )
    ok = judged.filter("reject_reason IS NULL").drop("reject_reason")
    return ok, judged.filter("reject_reason IS NOT NULL")


def document_key(sha256: Column, suffix: str = ".pdf") -> Column:
    return F.concat(
        F.lit("documents/"), F.substring(sha256, 1, 2), F.lit("/"), sha256, F.lit(suffix)
    )


def page_key(document_id: Column, page_no: Column) -> Column:
    number = F.format_string("%03d", page_no.cast("long"))
    return F.concat(F.lit("pages/"), document_id.cast("string"), F.lit("/"), number, F.lit(".png"))


# ---- key -> bytes table -------------------------------------------------------------------
# A blob table is a DataFrame (key, content). Stored as Parquet it is partitioned by the first
# two hex digits of the key's hash, so that one shard can be rewritten or read on its own.


def _valid_key(key: Column) -> Column:
    return ~F.array_contains(F.split(key, "/"), "..")


def blob_put(store: DataFrame, puts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Store with ``puts`` written over it, and the puts refused for a ``..`` in the key.

    ``puts`` may carry ``put_ord``; the highest one wins when a key is written twice.
    """
    if "put_ord" not in puts.columns:
        puts = puts.withColumn("put_ord", F.lit(0).cast("long"))
    good = puts.filter(_valid_key(F.col("key")))
    last = good.groupBy("key").agg(F.max_by("content", "put_ord").alias("content"))
    kept = store.join(last.select("key"), "key", "left_anti")
    return kept.unionByName(last), puts.filter(~_valid_key(F.col("key"))).drop("put_ord")


def blob_get(store: DataFrame, keys: DataFrame) -> DataFrame:
    return store.join(keys.select("key").distinct(), "key", "left_semi")


def blob_exists(store: DataFrame, keys: DataFrame) -> DataFrame:
    present = store.select("key").distinct().withColumn("found", F.lit(True))
    return (
        keys.join(present, "key", "left")
        .withColumn("exists", F.coalesce("found", F.lit(False)))
        .drop("found")
    )


def blob_delete(store: DataFrame, keys: DataFrame) -> DataFrame:
    """Store without ``keys``; keys that are not there change nothing."""
    return store.join(keys.select("key"), "key", "left_anti")


def shard(key: Column) -> Column:
    return F.substring(F.sha2(key, 256), 1, 2)


def blob_missing(store: DataFrame, keys: DataFrame) -> DataFrame:
    """Asked keys that the store does not hold."""
    return keys.select("key").distinct().join(store.select("key"), "key", "left_anti")


SHARDS = 256
FILE_BYTES = 128 << 20


def _by_shard(store: DataFrame, files: int) -> DataFrame:
    return store.withColumn("shard", shard(F.col("key"))).repartition(
        "shard", F.pmod(F.xxhash64("key"), F.lit(files))
    )


def _files(size: int, shards: int) -> int:
    return max(1, -(-size // (max(1, shards) * FILE_BYTES)))


def write_blobs(store: DataFrame, path: str, files_per_shard: int | None = None) -> None:
    """Cluster on the shard; a shard folder gets as many files as its share of the bytes needs."""
    if files_per_shard is None:
        size = store.agg(F.sum(F.octet_length("content").cast("long"))).first()[0] or 0
        files_per_shard = _files(size, SHARDS)
    _by_shard(store, files_per_shard).write.mode("errorifexists").partitionBy("shard").parquet(path)


def update_blobs(
    spark: SparkSession,
    path: str,
    puts: DataFrame | None = None,
    deletes: DataFrame | None = None,
    files_per_shard: int | None = None,
) -> DataFrame:
    """Write ``puts`` over the stored table, then delete; only the shards of the named keys are
    read and written. Returns the refused puts.

    A shard is written as as many files, by as many tasks, as the bytes of the touched shards and of the puts ask for.

    The shards are replaced when all of them are written. A row without key keeps the folder of a
    shard that runs empty, which would not be replaced otherwise; readers leave it out.
    """
    none = spark.createDataFrame([], "key string, content binary")
    puts, deletes = none if puts is None else puts, none if deletes is None else deletes
    named = puts.select("key").union(deletes.select("key"))
    touched = [r[0] for r in named.select(shard(F.col("key"))).distinct().collect()]  # 256 at most
    rows = spark.read.schema(STORED).parquet(path).filter(F.col("shard").isin(touched))
    kept, refused = blob_put(rows.filter("key IS NOT NULL").select("key", "content"), puts)
    after = blob_delete(kept, deletes)
    marks = spark.createDataFrame([(None, None, t) for t in touched], STORED)
    if files_per_shard is None:
        size = lambda df: df.agg(F.sum(F.octet_length("content").cast("long"))).first()[0] or 0
        files_per_shard = _files(size(rows) + size(puts), len(touched))
    out = _by_shard(after, files_per_shard).unionByName(marks)
    if touched:
        writer = out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("shard").parquet(path)
    return refused


STORED = "key string, content binary, shard string"


def read_blobs(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """The whole table, or one key with only its shard folder read."""
    table = spark.read.schema(STORED).parquet(path).filter("key IS NOT NULL")
    if key is not None:
        wanted = F.lit(key)
        table = table.filter((F.col("shard") == shard(wanted)) & (F.col("key") == wanted))
    return table.drop("shard")
