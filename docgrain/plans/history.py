"""Run history, listings, integrity."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import runs as H
from ..operators.ranking import mark_latest
from ..session import stage, work_path
from ..sources import tables
from .registry import query, reviews, runs, table


def _history(spark, sf):
    return mark_latest(runs(spark, sf), "document_id", "extraction_run_id")


@query(
    "current_runs",
    """
SELECT o_custkey AS document_id, o_orderkey AS extraction_run_id, o_orderpriority AS llm_model
FROM orders WHERE o_orderkey IN (SELECT max(o_orderkey) FROM orders GROUP BY o_custkey)
""",
)
def current_runs(spark, sf):
    return H.current_runs(_history(spark, sf)).select("document_id", "extraction_run_id", "llm_model")


def _appended(spark, sf):
    """Finished orders are the stored history, all others arrive now."""
    rows = runs(spark, sf)
    stored = stage(
        mark_latest(rows.filter("doc_type = 'F'"), "document_id", "extraction_run_id"), "history"
    )
    new = rows.filter("doc_type <> 'F'")
    documents = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("document_id"),
        F.lit(None).cast("string").alias("doc_type"),
        F.lit("uploaded").alias("status"),
    )
    return H.append_extraction_run(stored, new, documents)


@query(
    "append_runs",
    """
WITH n AS (SELECT o_custkey, max(o_orderkey) AS k FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1),
o AS (SELECT o_custkey, max(o_orderkey) AS k FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT orders.o_custkey AS document_id, o_orderkey AS extraction_run_id,
       o_orderkey = coalesce(n.k, o.k) AS is_current
FROM orders LEFT JOIN n ON n.o_custkey = orders.o_custkey LEFT JOIN o ON o.o_custkey = orders.o_custkey
""",
)
def append_runs(spark, sf):
    return _appended(spark, sf)[0].select("document_id", "extraction_run_id", "is_current")


@query(
    "append_runs_documents",
    """
WITH n AS (SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS t FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1)
SELECT c_custkey AS document_id, t AS doc_type, CASE WHEN t IS NULL THEN 'uploaded' ELSE 'extracted' END AS status
FROM customer LEFT JOIN n ON o_custkey = c_custkey
""",
)
def append_runs_documents(spark, sf):
    return _appended(spark, sf)[1]


@query(
    "append_refinements",
    """
WITH f AS (SELECT conv_id, turn, role FROM conversations),
n AS (SELECT conv_id, max(turn) AS k FROM f WHERE role = 'assistant' GROUP BY 1),
o AS (SELECT conv_id, max(turn) AS k FROM f WHERE role <> 'assistant' GROUP BY 1)
SELECT f.conv_id AS extraction_run_id, turn AS refinement_run_id, turn = coalesce(n.k, o.k) AS is_current
FROM f LEFT JOIN n USING (conv_id) LEFT JOIN o USING (conv_id)
""",
)
def append_refinements(spark, sf):
    """Turns as refinement runs: what the user and the system said is history, answers arrive now."""
    turns = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("extraction_run_id"),
        F.col("turn").alias("refinement_run_id"),
        "role",
    )
    # The turn number restarts in every conversation, so a row is named by both.
    row_id = ["extraction_run_id", "refinement_run_id"]
    asked = turns.filter("role <> 'assistant'").drop("role")
    stored = stage(mark_latest(asked, "extraction_run_id", row_id), "history")
    new = turns.filter("role = 'assistant'").drop("role")
    return H.append_refinement_run(stored, new, row_id)


@query(
    "current_violations",
    """
SELECT o_custkey AS document_id, count(*) FILTER (o_orderstatus = 'P') AS n_current
FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderstatus = 'P') > 1
""",
)
def current_violations(spark, sf):
    flagged = runs(spark, sf).withColumn("is_current", F.col("doc_type") == "P")
    return H.current_violations(flagged, "document_id")


@query(
    "run_history",
    """
SELECT o_custkey AS document_id, o_orderkey AS extraction_run_id,
       row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS run_rank
FROM orders
""",
)
def run_history(spark, sf):
    return H.run_history(runs(spark, sf)).select("document_id", "extraction_run_id", "run_rank")


@query(
    "list_documents_page",
    """
SELECT o_orderkey AS document_id, o_orderdate AS created_at, (SELECT count(*) FROM orders) AS total,
       CAST(ceil((SELECT count(*) FROM orders) / 20.0) AS BIGINT) AS pages
FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20 OFFSET 40
""",
)
def list_documents_page(spark, sf):
    docs = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("document_id"), F.col("o_orderdate").alias("created_at")
    )
    return H.list_documents(docs, page=3, size=7)


@query(
    "list_documents_after",
    """
SELECT o_orderkey AS document_id, o_orderdate AS created_at FROM orders
WHERE o_orderdate < TIMESTAMP '1998-01-01' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 20
""",
)
def list_documents_after(spark, sf):
    docs = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("document_id"), F.col("o_orderdate").alias("created_at")
    )
    return H.documents_after(docs, dt.datetime(1998, 1, 1), 0)


PAGES_SQL = """
pg AS (SELECT l_orderkey AS document_id, l_linenumber AS page_no, CAST(max(l_quantity) AS INT) AS width_px
       FROM lineitem GROUP BY ALL)
"""


def _pages(spark, sf):
    return (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("page_no"))
        .agg(F.max("l_quantity").cast("int").alias("width_px"))
    )


@query(
    "document_detail",
    f"""
WITH {PAGES_SQL},
cur AS (SELECT o_custkey, max(o_orderkey) AS run_id FROM orders GROUP BY 1)
SELECT c_custkey AS document_id, c_name AS filename, run_id AS extraction_run_id, o_orderpriority AS llm_model, page_no, width_px
FROM customer LEFT JOIN cur ON cur.o_custkey = c_custkey LEFT JOIN orders ON o_orderkey = run_id
LEFT JOIN pg ON pg.document_id = c_custkey
""",
)
def document_detail(spark, sf):
    docs = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("document_id"), F.col("c_name").alias("filename")
    )
    out = H.document_detail(docs, _history(spark, sf), _pages(spark, sf))
    return out.select("document_id", "filename", "extraction_run_id", "llm_model", "page_no", "width_px")


@query(
    "page_lookup",
    f"""
WITH {PAGES_SQL}
SELECT document_id, page_no, width_px FROM pg JOIN orders ON o_orderkey = document_id
 AND page_no = CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 3 END
""",
)
def page_lookup(spark, sf):
    """One page of every order: the first of finished ones, the third of others."""
    asked = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("document_id"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(3).alias("page_no"),
    )
    return H.pages_for(_pages(spark, sf), asked)


@query(
    "run_lookup",
    """
SELECT o_orderkey AS extraction_run_id, o_custkey AS document_id, o_orderpriority AS llm_model
FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')
""",
)
def run_lookup(spark, sf):
    ids = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("extraction_run_id")
    )
    return H.runs_for(runs(spark, sf), ids).select("extraction_run_id", "document_id", "llm_model")


@query(
    "effective_scaffold",
    """
WITH r AS (SELECT l_orderkey, max(l_shipdate) AS d FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT o_orderkey AS extraction_run_id,
       CASE WHEN d IS NULL THEN o_orderstatus ELSE strftime(d, '%Y-%m-%d') END AS scaffold, d IS NOT NULL AS is_refined
FROM orders LEFT JOIN r ON l_orderkey = o_orderkey
""",
)
def effective_scaffold(spark, sf):
    base = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("extraction_run_id"), F.col("o_orderstatus").alias("scaffold")
    )
    refined = (
        table(spark, sf, "lineitem")
        .filter("l_returnflag = 'R'")
        .groupBy(F.col("l_orderkey").alias("extraction_run_id"))
        .agg(F.max("l_shipdate").cast("date").cast("string").alias("scaffold_out"))
        .withColumn("is_current", F.lit(True))
    )
    return H.effective_scaffold(base, refined)


# ---- integrity ---------------------------------------------------------------------------------------


def _documents(spark, sf):
    """Documents as stored rows; some sources break a rule each."""
    src = F.col("source")
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("document_id"),
        F.when(src == "src1", 0).otherwise(F.col("n_chars")).alias("size_bytes"),
        F.when(src == "src2", -1).when(src == "src3", None).otherwise(1).alias("page_count"),
        F.when(src == "src4", "letter").otherwise("invoice").alias("doc_type"),
        F.when(src.isin("src4", "src5"), "lost").otherwise("uploaded").alias("status"),
    )


@query(
    "constraint_report",
    """
SELECT doc_id AS document_id, 'size_bytes_positive' AS rule FROM documents WHERE source = 'src1' OR n_chars = 0
UNION ALL SELECT doc_id, 'page_count_positive' FROM documents WHERE source = 'src2'
UNION ALL SELECT doc_id, 'doc_type_known' FROM documents WHERE source = 'src4'
UNION ALL SELECT doc_id, 'status_known' FROM documents WHERE source IN ('src4', 'src5')
""",
)
def constraint_report(spark, sf):
    return H.check_constraints(_documents(spark, sf), H.rules("document")).select("document_id", "rule")


@query(
    "page_constraints",
    """
WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linenumber - 1 AS page_no, l_quantity - 1 AS w, l_partkey AS h FROM lineitem)
SELECT l_orderkey, l_partkey, l_suppkey, 'page_no_positive' AS rule FROM p WHERE page_no < 1
UNION ALL SELECT l_orderkey, l_partkey, l_suppkey, 'width_positive' FROM p WHERE w <= 0
UNION ALL SELECT l_orderkey, l_partkey, l_suppkey, 'height_positive' FROM p WHERE h <= 0
""",
)
def page_constraints(spark, sf):
    pages = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey",
        (F.col("l_linenumber") - 1).alias("page_no"),
        (F.col("l_quantity") - 1).alias("width_px"),
        F.col("l_partkey").alias("height_px"),
    )
    return H.check_constraints(pages, H.rules("document_page")).select(
        "l_orderkey", "l_partkey", "l_suppkey", "rule"
    )


@query(
    "run_constraints",
    """
SELECT o_orderkey, 'duration_nonneg' AS rule FROM orders WHERE o_totalprice < 100000
UNION ALL SELECT o_orderkey, 'doc_type_known' FROM orders WHERE o_orderstatus = 'P'
UNION ALL SELECT o_orderkey, 'extracted_is_object' FROM orders WHERE o_orderstatus = 'O'
""",
)
def run_constraints(spark, sf):
    st = F.col("o_orderstatus")
    rows = table(spark, sf, "orders").select(
        "o_orderkey",
        (F.col("o_totalprice") - 100000).alias("duration_ms"),
        F.when(st == "P", "memo").otherwise("invoice").alias("doc_type"),
        F.when(st == "O", "[]").otherwise(" {}").alias("extracted"),
    )
    return H.check_constraints(rows, H.rules("extraction_run")).select("o_orderkey", "rule")


@query(
    "duplicate_hashes",
    "SELECT sha256(text) AS sha256, count(*) AS n_rows FROM documents GROUP BY 1 HAVING count(*) > 1",
)
def duplicate_hashes(spark, sf):
    hashed = table(spark, sf, "documents").select(F.sha2("text", 256).alias("sha256"))
    return H.unique_violations(hashed, "sha256")


@query(
    "orphans",
    "SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')",
)
def orphans(spark, sf):
    parents = table(spark, sf, "orders").filter("o_orderstatus = 'F'")
    return H.orphans(
        table(spark, sf, "events").select("event_id", "user_id"), parents, "user_id", "o_custkey"
    )


@query(
    "restricted_parents",
    "SELECT s_suppkey FROM supplier WHERE s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50 AND l_returnflag = 'R')",
)
def restricted_parents(spark, sf):
    child = table(spark, sf, "lineitem").filter("l_quantity = 50 AND l_returnflag = 'R'")
    return H.restricted_parents(
        table(spark, sf, "supplier").select("s_suppkey"), child, "s_suppkey", "l_suppkey"
    )


@query(
    "cascade_delete",
    """
WITH gone AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY'),
gone_runs AS (SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM gone))
SELECT 'document' AS tbl, c_custkey AS id, NULL AS blob_key FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM gone)
UNION ALL SELECT 'document_page', l_orderkey, NULL FROM lineitem WHERE l_orderkey NOT IN (SELECT c_custkey FROM gone)
UNION ALL SELECT 'extraction_run', o_orderkey, NULL FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM gone)
UNION ALL SELECT 'field_review', event_id, NULL FROM events WHERE user_id NOT IN (SELECT o_orderkey FROM gone_runs)
UNION ALL SELECT 'refinement_run', conv_id, NULL FROM conversations WHERE conv_id NOT IN (SELECT o_orderkey FROM gone_runs)
UNION ALL SELECT 'blob_keys', NULL, 'doc/' || c_custkey FROM gone
UNION ALL SELECT 'blob_keys', NULL, 'page/' || l_orderkey || '/' || l_linenumber FROM lineitem WHERE l_orderkey IN (SELECT c_custkey FROM gone)
""",
)
def cascade_delete(spark, sf):
    """Customers of one segment leave with their pages, runs, reviews and refinements."""
    customers = table(spark, sf, "customer")
    key = F.col("c_custkey")
    documents = customers.select(
        key.alias("document_id"), F.concat(F.lit("doc/"), key.cast("string")).alias("blob_key")
    )
    doomed = customers.filter("c_mktsegment = 'MACHINERY'").select(key.alias("document_id"))
    pages = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("document_id"),
        F.concat(
            F.lit("page/"), F.col("l_orderkey").cast("string"), F.lit("/"),
            F.col("l_linenumber").cast("string"),
        ).alias("blob_key"),
    )
    reviews_ = table(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("extraction_run_id")
    )
    refinements = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("extraction_run_id")
    )
    left = H.cascade_delete(doomed, documents, pages, runs(spark, sf), reviews_, refinements)
    ids = {
        "document": "document_id",
        "document_page": "document_id",
        "extraction_run": "extraction_run_id",
        "field_review": "event_id",
        "refinement_run": "extraction_run_id",
    }
    null = F.lit(None)
    out = left["blob_keys"].select(
        F.lit("blob_keys").alias("tbl"), null.cast("long").alias("id"), "blob_key"
    )
    for name, id_ in ids.items():
        out = out.unionByName(
            left[name].select(
                F.lit(name).alias("tbl"), F.col(id_).alias("id"), null.cast("string").alias("blob_key")
            )
        )
    return out


# ---- bucketed histories ------------------------------------------------------------------------------------


@query(
    "bucketed_edit_counts",
    """
SELECT o_orderkey AS extraction_run_id, count(event_id) AS n_reviews, count(DISTINCT event_type) AS n_fields
FROM orders LEFT JOIN events ON user_id = o_orderkey GROUP BY o_orderkey
""",
)
def bucketed_edit_counts(spark, sf):
    """Runs and reviews stored in buckets of the run id and joined bucket by bucket."""
    path = work_path(spark, "buckets")
    unique = path.rsplit("-", 1)[1]
    size = lambda df, row_bytes: tables.bucket_count(df.count() * row_bytes)
    log, orders = reviews(spark, sf), runs(spark, sf).select("extraction_run_id", "created_at")
    log = log.select("extraction_run_id", "field_review_id", "field_path", "created_at")
    stored = tables.write_bucketed(log, f"reviews_{unique}", f"{path}/reviews", "extraction_run_id", ["field_path"], size(log, 100))
    heads = tables.write_bucketed(orders, f"runs_{unique}", f"{path}/runs", "extraction_run_id", ["created_at"], size(orders, 50))
    counts = stored.groupBy("extraction_run_id").agg(
        F.count("*").alias("n_reviews"), F.count_distinct("field_path").alias("n_fields")
    )
    zero = {"n_reviews": 0, "n_fields": 0}
    return heads.join(counts, "extraction_run_id", "left").select("extraction_run_id", *zero).fillna(zero)
