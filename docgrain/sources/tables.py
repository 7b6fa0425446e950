"""The stored tables and the evaluation files."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import EVAL_CASE_DDL, EVAL_DATASET_DDL, TABLES, TRUTH_DDL

# How each table is laid out: partition folders for the flag every read filters on, and the
# sort key whose min/max statistics let Parquet skip row groups.
LAYOUT = {
    "document": (["status"], ["created_at"]),
    "document_page": ([], ["document_id", "page_no"]),
    "extraction_run": (["is_current"], ["document_id", "created_at"]),
    "field_review": ([], ["extraction_run_id", "field_path"]),
    "refinement_run": (["is_current"], ["extraction_run_id", "created_at"]),
}


def conform(df: DataFrame, table: str) -> DataFrame:
    """Cast to the stored shape; columns that are missing become null."""
    schema = T.StructType.fromDDL(TABLES[table])
    return df.select(
        *[
            (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in schema.fields
        ]
    )


def write_table(df: DataFrame, root: str, table: str) -> str:
    """Write a new version below ``root/table`` and return its folder.

    A version is complete once its ``_SUCCESS`` mark is there; readers take the newest complete
    one, so a lost job never leaves a half-written table visible.
    """
    folders, order = LAYOUT[table]
    spark = df.sparkSession
    stamp = spark.range(1).select(F.unix_micros(F.current_timestamp())).first()[0]
    path = f"{root}/{table}/v={stamp:020d}-{uuid.uuid4().hex[:8]}"
    # Ranges of the sort key, so that a file covers few keys and a lookup skips the others.
    out = conform(df, table).repartitionByRange(*folders, *order).sortWithinPartitions(*folders, *order)
    writer = out.write.mode("errorifexists")
    if folders:
        writer = writer.partitionBy(*folders)
    writer.parquet(path)
    return path


def _versions(spark: SparkSession, folder: str) -> list[str]:
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return []
    done = []
    for status in fs.listStatus(root):
        path = status.getPath()
        if path.getName().startswith("v=") and fs.exists(
            jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS")
        ):
            done.append(path.toString())
    return sorted(done)


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    """Newest complete version, or an empty table of the right shape."""
    schema = T.StructType.fromDDL(TABLES[table])
    found = _versions(spark, f"{root}/{table}")
    if not found:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(found[-1]).select(*schema.fieldNames())


# ---- bucketed layout -----------------------------------------------------------------------------------

# The composite access paths of the histories: rows of one key lie in one bucket, sorted by the rest.
BUCKETED = {
    "document_page": ("document_id", ["page_no"]),
    "extraction_run": ("document_id", ["created_at"]),
    "field_review": ("extraction_run_id", ["field_path", "created_at"]),
    "refinement_run": ("extraction_run_id", ["created_at"]),
}
BUCKET_BYTES = 512 << 20


def bucket_count(size_bytes: int) -> int:
    """Buckets for a table of a given size: a power of two, so that tables of different sizes still join bucket by bucket."""
    return 1 << max(3, (-(-size_bytes // BUCKET_BYTES) - 1).bit_length())


def write_bucketed(df: DataFrame, name: str, path: str, by: str, order: list[str], buckets: int) -> DataFrame:
    """Write a catalog table bucketed by ``by`` and sorted inside buckets by ``by`` and ``order``, and return it.

    The rows are dealt out once, by the hash that names the bucket, so each bucket is one file. Lookups, aggregates and
    joins on ``by`` then read the table without a shuffle; only what is joined to it moves. A key with a very large share of
    the rows makes its bucket as large: for such tables use :func:`write_table`, whose ranges split a key.
    """
    keys = [by, *[c for c in order if c != by]]
    writer = df.repartition(buckets, by).write.mode("errorifexists").format("parquet").option("path", path)
    writer.bucketBy(buckets, by).sortBy(*keys).saveAsTable(name)
    return df.sparkSession.table(name)


def write_history(df: DataFrame, table: str, name: str, path: str, buckets: int) -> DataFrame:
    """One of the histories in the bucketed layout of its access path."""
    by, order = BUCKETED[table]
    return write_bucketed(conform(df, table), name, path, by, order, buckets)


def load_eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases from JSON lines; ``expected`` stays JSON text until typed."""
    cases = spark.read.schema(EVAL_CASE_DDL).json(path)
    return cases.select(
        "dataset",
        F.col("case"),
        F.col("inputs.pdf_path").alias("pdf_path"),
        F.col("expected_output").alias("expected"),
        F.col("metadata.source_pdf").alias("source_pdf"),
        F.col("metadata.status").alias("status"),
        F.col("metadata.notes").alias("notes"),
    )


def load_eval_datasets(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Whole data sets from JSON lines, one a line: cases (as of :func:`load_eval_cases`) and (dataset, evaluators).

    A data set without an evaluator list has an empty one.
    """
    sets = spark.read.schema(EVAL_DATASET_DDL).json(path)
    cases = sets.select(F.col("name").alias("dataset"), F.explode("cases").alias("c")).select(
        "dataset",
        F.col("c.name").alias("case"),
        F.col("c.inputs.pdf_path").alias("pdf_path"),
        F.col("c.expected_output").alias("expected"),
        F.col("c.metadata.source_pdf").alias("source_pdf"),
        F.col("c.metadata.status").alias("status"),
        F.col("c.metadata.notes").alias("notes"),
    )
    none = F.array().cast("array<struct<name:string,options:map<string,string>>>")
    return cases, sets.select(F.col("name").alias("dataset"), F.coalesce("evaluators", none).alias("evaluators"))


def load_refinement_truth(spark: SparkSession, path: str) -> DataFrame:
    """Long truth table (run, page, field, fragment, box); a missing folder is an empty set."""
    try:
        raw = spark.read.schema(TRUTH_DDL).json(path)
    except AnalysisException as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        raw = spark.createDataFrame([], TRUTH_DDL)
    return raw.select(
        "extraction_run_id", "page_no", F.explode("fields").alias("field_key", "truth")
    ).select(
        "extraction_run_id", "page_no", "field_key", "truth.fragment_id", "truth.bbox"
    )
