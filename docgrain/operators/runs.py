"""Run history, document listings and integrity checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import DEFAULT_PAGE_SIZE, DOC_STATUSES, DOC_TYPES, PAGE_SIZES, PAYLOAD_VERSION
from .ranking import latest_per_key, mark_latest, split_row_number


DEEP = 10_000  # rows of a listing that may be gathered to skip them


def append_runs(
    runs: DataFrame, new: DataFrame, key: str, row_id: str | list[str]
) -> DataFrame:
    """Insert runs; per touched key the last inserted one becomes the only current run.

    Old history passes through untouched: only the rows that are current today meet the keys of
    the new runs.
    """
    touched = new.select(key).distinct().withColumn("__touched", F.lit(True))
    current = (
        runs.filter("is_current")
        .join(touched, key, "left")
        .withColumn("is_current", F.col("__touched").isNull())
        .drop("__touched")
    )
    added = mark_latest(new, key, row_id)
    out = runs.filter("NOT is_current").unionByName(current)
    return out.unionByName(added, allowMissingColumns=True)


def append_extraction_run(
    runs: DataFrame, new: DataFrame, documents: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Append extraction runs and set doc_type and status of the documents they belong to.

    New runs that name no payload version get the present one.
    """
    if "schema_version" in runs.columns and "schema_version" not in new.columns:
        new = new.withColumn("schema_version", F.lit(PAYLOAD_VERSION))
    out = append_runs(runs, new, "document_id", "extraction_run_id")
    last = latest_per_key(
        new.select("document_id", "extraction_run_id", F.col("doc_type").alias("new_type")),
        ["document_id"],
        ["extraction_run_id"],
    ).drop("extraction_run_id")
    docs = (
        documents.join(last, "document_id", "left")
        .withColumn("doc_type", F.coalesce("new_type", "doc_type"))
        .withColumn("status", F.when(F.col("new_type").isNotNull(), "extracted").otherwise(F.col("status")))
        .drop("new_type")
        .select(*documents.columns)
    )
    return out, docs


def append_refinement_run(
    runs: DataFrame, new: DataFrame, row_id: str | list[str] = "refinement_run_id"
) -> DataFrame:
    """Append refinement runs; per extraction run the last inserted one becomes current.

    Where refinement ids start anew in each extraction run, ``row_id`` names both columns.
    """
    return append_runs(runs, new, "extraction_run_id", row_id)


def current_runs(runs: DataFrame) -> DataFrame:
    return runs.filter("is_current")


def current_violations(runs: DataFrame, key: str) -> DataFrame:
    """Keys with more than one current run."""
    return (
        runs.groupBy(key)
        .agg(F.count_if(F.col("is_current")).alias("n_current"))
        .filter("n_current > 1")
    )


def run_history(
    runs: DataFrame, key: str = "document_id", row_id: str = "extraction_run_id"
) -> DataFrame:
    """Runs numbered newest first per key."""
    newest = [F.col("created_at").desc(), F.col(row_id).desc()]
    return split_row_number(runs, [key], newest, name="run_rank")


def page_request(page: int, size: int) -> tuple[int, int]:
    """Clamp a listing request to page >= 1 and an allowed page size."""
    return max(int(page), 1), size if size in PAGE_SIZES else DEFAULT_PAGE_SIZE


def list_documents(documents: DataFrame, page: int = 1, size: int = DEFAULT_PAGE_SIZE) -> DataFrame:
    """One page of the listing, newest first, each row with the total and the page count.

    A page beyond the first ``DEEP`` rows is cut out by row numbers of range partitions, so the
    rows before it never meet in one place. Readers that turn page after page use :func:`documents_after`.
    """
    page, size = page_request(page, size)
    newest = [F.col("created_at").desc(), F.col("document_id").desc()]
    start = (page - 1) * size
    if start <= DEEP:
        rows = documents.orderBy(*newest).offset(start).limit(size)
    else:
        all_rows = documents.withColumn("__all", F.lit(0))
        numbered = split_row_number(all_rows, ["__all"], newest, name="__rn")
        rows = numbered.filter(F.col("__rn").between(start + 1, start + size)).drop("__all", "__rn")
    total = documents.agg(F.count("*").alias("n")).scalar()
    return rows.withColumn("total", total).withColumn(
        "pages", F.ceil(F.col("total") / size).cast("long")
    )


def documents_after(
    documents: DataFrame, created_at: object, document_id: object, size: int = DEFAULT_PAGE_SIZE
) -> DataFrame:
    """The page after the document last seen: a filter and a top-n, at any depth."""
    when, name = F.col("created_at"), F.col("document_id")
    seen = F.lit(created_at)
    older = (when < seen) | ((when == seen) & (name < F.lit(document_id)))
    return documents.filter(older).orderBy(when.desc(), name.desc()).limit(size)


def document_detail(documents: DataFrame, runs: DataFrame, pages: DataFrame) -> DataFrame:
    """Documents with their current run and pages, one row per page in page order.

    Documents without run or pages keep one row. Pages stay rows, so a document of any length
    never has to fit into one value.
    """
    run = current_runs(runs).select(
        "document_id",
        "extraction_run_id",
        F.col("doc_type").alias("run_doc_type"),
        "llm_model",
        "duration_ms",
    )
    return documents.join(run, "document_id", "left").join(pages, "document_id", "left")


def page_lookup(pages: DataFrame, document_id: object, page_no: int) -> DataFrame:
    return pages.filter((F.col("document_id") == document_id) & (F.col("page_no") == page_no))


def pages_for(pages: DataFrame, requests: DataFrame) -> DataFrame:
    """Pages of many lookups (document_id, page_no) at once."""
    keys = ["document_id", "page_no"]
    return pages.join(requests.select(*keys).distinct(), keys, "left_semi")


def list_pages(pages: DataFrame, document_id: object) -> DataFrame:
    return pages.filter(F.col("document_id") == document_id).orderBy("page_no")


def run_by_id(runs: DataFrame, run_id: int) -> DataFrame:
    return runs.filter(F.col("extraction_run_id") == run_id)


def runs_for(runs: DataFrame, ids: DataFrame) -> DataFrame:
    """Runs of many ids (extraction_run_id) at once."""
    return runs.join(ids.select("extraction_run_id").distinct(), "extraction_run_id", "left_semi")


def effective_scaffold(runs: DataFrame, refinements: DataFrame) -> DataFrame:
    """Scaffold shown for each run: that of its current refinement, else its own."""
    refined = refinements.filter("is_current").select("extraction_run_id", "scaffold_out")
    return runs.join(refined, "extraction_run_id", "left").select(
        "extraction_run_id",
        F.coalesce("scaffold_out", "scaffold").alias("scaffold"),
        F.col("scaffold_out").isNotNull().alias("is_refined"),
    )


# ---- integrity -------------------------------------------------------------------------------


def _is_shape(c: str, opening: str) -> Column:
    return F.coalesce(F.ltrim(F.col(c)).startswith(opening), F.lit(False))




def rules(table: str) -> dict[str, Column]:
    """Row rules of a stored table: name -> condition that must hold."""
    c = F.col
    if table == "document":
        return {
            "size_bytes_positive": c("size_bytes") > 0,
            "page_count_positive": c("page_count").isNull() | (c("page_count") > 0),
            "doc_type_known": c("doc_type").isNull() | c("doc_type").isin(DOC_TYPES),
            "status_known": c("status").isin(DOC_STATUSES),
        }
    if table == "document_page":
        return {
            "page_no_positive": c("page_no") >= 1,
            "width_positive": c("width_px") > 0,
            "height_positive": c("height_px") > 0,
        }
    if table == "extraction_run":
        return {
            "duration_nonneg": c("duration_ms") >= 0,
            "doc_type_known": c("doc_type").isin(DOC_TYPES),
            "extracted_is_object": _is_shape("extracted", "{"),
        }
    if table == "refinement_run":
        return {
            "duration_nonneg": c("duration_ms") >= 0,
            "scaffold_in_is_object": _is_shape("scaffold_in", "{"),
            "scaffold_out_is_object": _is_shape("scaffold_out", "{"),
            "patches_is_array": _is_shape("patches", "["),
        }
    raise ValueError(f"no rules for table {table!r}")


def check_constraints(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row per (row, broken rule), found in a single pass without shuffle."""
    broken = F.array_compact(
        F.array(
            *[
                F.when(~F.coalesce(cond, F.lit(False)), F.lit(name))
                for name, cond in checks.items()
            ]
        )
    )
    return df.withColumn("rule", F.explode(broken))


def unique_violations(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once although the column is unique."""
    return df.groupBy(key).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose parent does not exist; a null reference is no reference."""
    keys = parent.select(F.col(parent_key).alias(child_key)).distinct()
    return child.filter(F.col(child_key).isNotNull()).join(keys, child_key, "left_anti")


def restricted_parents(
    parent: DataFrame, child: DataFrame, parent_key: str, child_key: str
) -> DataFrame:
    """Parents that may not be removed because a child still refers to them."""
    refs = child.select(F.col(child_key).alias(parent_key)).distinct()
    return parent.join(refs, parent_key, "left_semi")


def cascade_delete(
    doomed: DataFrame,
    documents: DataFrame,
    pages: DataFrame,
    runs: DataFrame,
    reviews: DataFrame,
    refinements: DataFrame,
) -> dict[str, DataFrame]:
    """Remove documents with all they own; ``blob_keys`` lists the blobs left to clean up."""
    ids = doomed.select("document_id").distinct()
    gone_runs = runs.join(ids, "document_id", "left_semi").select("extraction_run_id")
    keys = (
        documents.join(ids, "document_id", "left_semi")
        .select("blob_key")
        .unionByName(pages.join(ids, "document_id", "left_semi").select("blob_key"))
    )
    return {
        "document": documents.join(ids, "document_id", "left_anti"),
        "document_page": pages.join(ids, "document_id", "left_anti"),
        "extraction_run": runs.join(ids, "document_id", "left_anti"),
        "field_review": reviews.join(gone_runs, "extraction_run_id", "left_anti"),
        "refinement_run": refinements.join(gone_runs, "extraction_run_id", "left_anti"),
        "blob_keys": keys,
    }
