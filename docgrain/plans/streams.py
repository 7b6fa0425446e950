"""Streaming jobs over the given tables, run until the input is used up and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import work_path
from ..streaming import jobs as J
from ..streaming import stateful as K
from .registry import query, table


FILES = 1000  # input files per micro-batch; results do not depend on it


def _stream(spark, sf, name):
    schema = table(spark, sf, name).schema
    return J.watch(spark, f"{sf}/{name}.parquet", schema, FILES)


def _finish(job):
    job.awaitTermination()
    if job.exception() is not None:
        raise job.exception()


def _clock(c):
    return F.col(c).cast("timestamp")


@query(
    "stream_dedupe",
    """
WITH f AS (SELECT sha256(text) AS sha256, min(doc_id) AS upload_ord FROM documents GROUP BY 1)
SELECT sha256, upload_ord, 'documents/' || substr(sha256, 1, 2) || '/' || sha256 || '.pdf' AS blob_key FROM f
""",
)
def stream_dedupe(spark, sf):
    root = work_path(spark, "stream-dedupe")
    uploads = _stream(spark, sf, "documents").select(
        F.col("doc_id").alias("upload_ord"), F.col("text").cast("binary").alias("content")
    )
    _finish(J.stream_ingest(uploads, root))
    return J.uploads_from_stream(spark, root, uploads.schema)


@query(
    "stream_dedupe_events",
    """
SELECT sha256(event_type || props) AS sha256, min(event_id) AS upload_ord, arg_min(ts, event_id) AS created_at
FROM events GROUP BY 1
""",
)
def stream_dedupe_events(spark, sf):
    root = work_path(spark, "stream-dedupe-events")
    uploads = _stream(spark, sf, "events").select(
        F.col("event_id").alias("upload_ord"),
        F.concat("event_type", "props").cast("binary").alias("content"),
        _clock("ts").alias("created_at"),
    )
    _finish(J.stream_ingest(uploads, root))
    return J.uploads_from_stream(spark, root, uploads.schema).drop("blob_key")


@query(
    "stream_current",
    """
SELECT o_custkey AS document_id, max(o_orderkey) AS extraction_run_id, arg_max(o_orderpriority, o_orderkey) AS llm_model
FROM orders GROUP BY 1
""",
)
def stream_current(spark, sf):
    root = work_path(spark, "stream-current")
    runs = _stream(spark, sf, "orders").select(
        F.col("o_custkey").alias("document_id"),
        F.col("o_orderkey").alias("extraction_run_id"),
        F.col("o_orderpriority").alias("llm_model"),
    )
    _finish(J.stream_current_runs(runs, root))
    return J.current_from_stream(spark, root, runs.schema)


@query(
    "stream_current_documents",
    """
WITH c AS (SELECT o_custkey AS document_id, arg_max(o_orderstatus, o_orderkey) AS doc_type FROM orders GROUP BY 1)
SELECT c_custkey AS document_id, c.doc_type, CASE WHEN c.document_id IS NULL THEN 'uploaded' ELSE 'extracted' END AS status
FROM customer LEFT JOIN c ON c.document_id = c_custkey
""",
)
def stream_current_documents(spark, sf):
    root = work_path(spark, "stream-current-documents")
    runs = _stream(spark, sf, "orders").select(
        F.col("o_custkey").alias("document_id"),
        F.col("o_orderkey").alias("extraction_run_id"),
        F.col("o_orderstatus").alias("doc_type"),
    )
    _finish(J.stream_current_runs(runs, root))
    documents = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("document_id"),
        F.lit(None).cast("string").alias("doc_type"),
        F.lit("uploaded").alias("status"),
    )
    return J.documents_after_runs(documents, J.current_from_stream(spark, root, runs.schema))


@query(
    "stream_current_flags",
    """
SELECT o_orderkey AS extraction_run_id, o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey) AS is_current FROM orders
""",
)
def stream_current_flags(spark, sf):
    root = work_path(spark, "stream-current-flags")
    runs = _stream(spark, sf, "orders").select(
        F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("extraction_run_id")
    )
    _finish(J.stream_current_runs(runs, root))
    history = table(spark, sf, "orders").select(F.col("o_orderkey").alias("extraction_run_id"))
    return J.flag_current(history, J.current_from_stream(spark, root, runs.schema))


@query(
    "stream_latest",
    """
SELECT user_id AS extraction_run_id, event_type AS field_path, max((ts, event_id))[2] AS field_review_id,
       arg_max(value, (ts, event_id)) AS edited_value
FROM events GROUP BY ALL
""".replace("max((ts, event_id))[2]", "arg_max(event_id, (ts, event_id))"),
)
def stream_latest(spark, sf):
    root = work_path(spark, "stream-latest")
    edits = _stream(spark, sf, "events").select(
        F.col("user_id").alias("extraction_run_id"),
        F.col("event_type").alias("field_path"),
        F.col("event_id").alias("field_review_id"),
        F.col("value").alias("edited_value"),
        _clock("ts").alias("created_at"),
    )
    _finish(J.stream_latest_reviews(edits, root))
    out = J.reviews_from_stream(spark, root, edits.schema)
    return out.select("extraction_run_id", "field_path", "field_review_id", "edited_value")


def _timing_sql(windows: str) -> str:
    """Counts and the percentile of rows (window_start, window_end, event_type, value), with the durations in the buckets of the job."""
    return f"""
{windows},
b AS (
  SELECT window_start, window_end, event_type, CASE WHEN value > 0 THEN CAST(ceil(ln(round(value, 2)) / ln({J.GROWTH})) AS INT) END AS bucket,
         count(*) AS n, sum(CAST(value AS DECIMAL(18,2))) AS total
  FROM w WHERE event_type <> 'signup' GROUP BY ALL),
c AS (
  SELECT *, sum(n) OVER (k ORDER BY bucket NULLS FIRST) AS below, sum(n) OVER k AS every
  FROM b WINDOW k AS (PARTITION BY window_start, window_end, event_type))
SELECT window_start, window_end, CASE event_type WHEN 'purchase' THEN 'POST' ELSE 'GET' END AS method, '/' || event_type AS path,
       CAST(sum(n) AS BIGINT) AS n, round(CAST(sum(total) AS DOUBLE), 2) AS total_ms,
       CAST(coalesce(sum(n) FILTER (event_type = 'error'), 0) AS BIGINT) AS errors,
       round(min(coalesce(pow({J.GROWTH}, bucket - 0.5), 0)) FILTER (below >= every * 0.95), 3) AS p95_ms_1pct
FROM c GROUP BY window_start, window_end, event_type
"""


def _request_log(spark, sf):
    status = F.when(F.col("event_type") == "error", 503).otherwise(200)
    verb = F.when(F.col("event_type") == "purchase", "POST").otherwise("GET")
    line = F.when(
        F.col("event_type") != "signup",
        F.format_string("%s /%s -> %d in %.2fms", verb, "event_type", status, "value"),
    ).otherwise("user signed up")
    return _stream(spark, sf, "events").select(_clock("ts").alias("ts"), line.alias("line"))


def _timing(spark, sf, root, **options):
    _finish(J.stream_request_timing(_request_log(spark, sf), root, **options))
    return J.timing_from_stream(spark, root, "gap" in options).select(
        "window_start", "window_end", "method", "path", "n", F.round("total_ms", 2).alias("total_ms"), "errors",
        F.round("p95_ms_1pct", 3).alias("p95_ms_1pct"),
    )


@query(
    "stream_timing",
    _timing_sql(
        "WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, value FROM events)"
    ),
)
def stream_timing(spark, sf):
    return _timing(spark, sf, work_path(spark, "stream-timing"), window="1 hour")


@query(
    "stream_timing_sliding",
    _timing_sql(
        """WITH u AS (SELECT *, unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS window_start FROM events),
w AS (SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, event_type, value FROM u)"""
    ),
)
def stream_timing_sliding(spark, sf):
    return _timing(
        spark, sf, work_path(spark, "stream-sliding"), window="1 hour", slide="30 minutes"
    )


@query(
    "stream_timing_sessions",
    _timing_sql(
        """WITH r AS (SELECT *, CASE WHEN ts < lag(ts) OVER v + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens
           FROM events WHERE event_type <> 'signup' WINDOW v AS (PARTITION BY event_type ORDER BY ts)),
s AS (SELECT *, sum(opens) OVER (PARTITION BY event_type ORDER BY ts RANGE UNBOUNDED PRECEDING) AS no FROM r),
w AS (SELECT min(ts) OVER g AS window_start, max(ts) OVER g + INTERVAL 30 MINUTE AS window_end, event_type, value FROM s WINDOW g AS (PARTITION BY event_type, no))"""
    ),
)
def stream_timing_sessions(spark, sf):
    return _timing(spark, sf, work_path(spark, "stream-sessions"), gap="30 minutes")


# ---- jobs with keyed state ------------------------------------------------------------------------

HORIZON_MS = 3_600_000  # results do not depend on it


@query(
    "stream_dedupe_state",
    """
WITH f AS (SELECT sha256(text) AS sha256, min(doc_id) AS upload_ord, arg_min(source, doc_id) AS source FROM documents GROUP BY 1)
SELECT sha256, upload_ord, source, 'documents/' || substr(sha256, 1, 2) || '/' || sha256 || '.pdf' AS blob_key FROM f
""",
)
def stream_dedupe_state(spark, sf):
    root = work_path(spark, "stream-dedupe-state")
    uploads = _stream(spark, sf, "documents").select(
        F.col("doc_id").alias("upload_ord"), "source", F.col("text").cast("binary").alias("content")
    )
    _finish(K.stream_ingest_within(uploads, root, HORIZON_MS))
    return J.uploads_from_stream(spark, root, uploads.schema)


@query(
    "stream_current_feed",
    """
SELECT o_custkey AS document_id, o_orderkey AS extraction_run_id,
       o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey) AS is_current FROM orders
""",
)
def stream_current_feed(spark, sf):
    root = work_path(spark, "stream-feed")
    runs = _stream(spark, sf, "orders").select(
        F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("extraction_run_id")
    )
    _finish(K.stream_current_changes(runs, root))
    history = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("extraction_run_id")
    )
    return K.apply_changes(history, K.current_changes(spark, root, "bigint"))


@query(
    "stream_timing_closed",
    """
SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, CASE event_type WHEN 'purchase' THEN 'POST' ELSE 'GET' END AS method,
       '/' || event_type AS path, count(*) AS n, round(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE), 2) AS total_ms,
       count(*) FILTER (event_type = 'error') AS errors
FROM events WHERE event_type <> 'signup' GROUP BY ALL
""",
)
def stream_timing_closed(spark, sf):
    """Closed windows, their corrections and the windows still open, added up."""
    closed, parts = work_path(spark, "stream-closed"), work_path(spark, "stream-closed-parts")
    log = _request_log(spark, sf)
    _finish(K.stream_closed_windows(log, closed, window="1 hour", delay="2 hours"))
    _finish(J.stream_request_timing(log, parts, window="1 hour"))
    rows = K.closed_windows(spark, closed).unionByName(K.corrections(spark, closed, parts).drop("closed"))
    return rows.groupBy("window_start", "method", "path").agg(
        F.sum("n").alias("n"), F.round(F.sum("total_ms"), 2).alias("total_ms"), F.sum("errors").alias("errors")
    )
