"""Human edits over the extracted records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reviews as R
from .registry import query, reviews, runs, table

LATEST_CTE = """
r AS (SELECT event_id, user_id, event_type, value, ts, props,
             row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn
      FROM events)
"""


@query(
    "latest_reviews",
    f"""
WITH {LATEST_CTE}
SELECT user_id AS extraction_run_id, event_type AS field_path, event_id AS field_review_id,
       CAST(value AS VARCHAR) AS edited_value
FROM r WHERE rn = 1
""",
)
def latest_reviews(spark, sf):
    return R.latest_reviews(reviews(spark, sf)).select(
        "extraction_run_id", "field_path", "field_review_id", "edited_value"
    )


@query(
    "audit_log",
    f"""
WITH {LATEST_CTE}
SELECT user_id AS extraction_run_id, event_type AS path, json_extract_string(props, '$.k') AS was,
       CAST(value AS VARCHAR) AS now, props AS remark, ts AS edited_at
FROM r WHERE rn = 1
""",
)
def audit_log(spark, sf):
    return R.audit_log(reviews(spark, sf))


@query(
    "overlay_orders",
    f"""
WITH {LATEST_CTE}, e AS (SELECT * FROM r WHERE rn = 1),
w AS (SELECT event_id, user_id, event_type, value, ts FROM e)
SELECT o_orderkey AS extraction_run_id, coalesce(p.value, o_totalprice) AS total,
       coalesce(CAST(v.value AS VARCHAR), o_orderpriority) AS priority
FROM orders LEFT JOIN w p ON p.user_id = o_orderkey AND p.event_type = 'purchase'
            LEFT JOIN w v ON v.user_id = o_orderkey AND v.event_type = 'view'
""",
)
def overlay_orders(spark, sf):
    base = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("extraction_run_id"),
        F.col("o_totalprice").alias("total"),
        F.col("o_orderpriority").alias("priority"),
    )
    return R.overlay_fields(base, reviews(spark, sf), {"purchase": "total", "view": "priority"})


def _payload_runs(spark, sf):
    record = F.struct(F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("click"))
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("extraction_run_id"),
        F.col("o_custkey").alias("document_id"),
        F.to_json(record).alias("extracted"),
    )


@query(
    "extracted_view",
    """
WITH r AS (SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS v, min((ts, event_id)) AS seen
           FROM events GROUP BY ALL),
x AS (SELECT user_id,
             max(CASE WHEN event_type = 'click' THEN CAST(v AS VARCHAR) END) AS click,
             string_agg(',"' || event_type || '":' || v, '' ORDER BY seen) FILTER (event_type <> 'click') AS added
      FROM r GROUP BY user_id)
SELECT o_orderkey AS extraction_run_id,
       '{"status":"' || o_orderstatus || '","click":' || coalesce(click, CAST(o_custkey AS VARCHAR)) || coalesce(added, '') || '}' AS "view"
FROM orders LEFT JOIN x ON user_id = o_orderkey
""",
)
def extracted_view(spark, sf):
    return R.extracted_view(_payload_runs(spark, sf), reviews(spark, sf), listed=False).select(
        "extraction_run_id", "view"
    )


def _edits(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_id").alias("edit_id"),
        F.col("user_id").alias("document_id"),
        F.when(F.col("event_type") == "view", "status").otherwise("total").alias("field_path"),
        F.col("value").cast("string").alias("edited_value"),
    )


def _order_runs(spark, sf):
    """Orders as runs with payload; the highest order of a customer is the current run, finished
    orders excepted, so that some customers have runs but no current one."""
    from ..operators.ranking import mark_latest

    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("extraction_run_id"),
        F.col("o_custkey").alias("document_id"),
        F.col("o_orderstatus").alias("doc_type"),
        F.to_json(F.struct(F.col("o_orderstatus").alias("status"))).alias("extracted"),
    )
    marked = mark_latest(rows, "document_id", "extraction_run_id")
    return marked.withColumn("is_current", F.col("is_current") & (F.col("doc_type") != "F"))


CURRENT_CTE = """
cur AS (SELECT o_custkey, max(o_orderkey) AS run_id FROM orders GROUP BY 1),
live AS (SELECT o_custkey, run_id, o_orderstatus FROM cur JOIN orders USING (o_custkey) WHERE o_orderkey = run_id AND o_orderstatus <> 'F')
"""


@query(
    "append_reviews",
    f"""
WITH {CURRENT_CTE}
SELECT event_id AS edit_id, user_id AS document_id, run_id AS extraction_run_id,
       CASE WHEN event_type = 'view' THEN o_orderstatus END AS original_value
FROM events JOIN live ON user_id = o_custkey WHERE user_id IN (SELECT c_custkey FROM customer)
""",
)
def append_reviews(spark, sf):
    return _append(spark, sf)[0].select("edit_id", "document_id", "extraction_run_id", "original_value")


def _append(spark, sf):
    documents = table(spark, sf, "customer").select(F.col("c_custkey").alias("document_id"))
    return R.append_reviews(_edits(spark, sf), documents, _order_runs(spark, sf))


@query(
    "rejected_edits",
    f"""
WITH {CURRENT_CTE}
SELECT event_id AS edit_id, CASE WHEN c_custkey IS NULL THEN 'document not found' ELSE 'no current extraction' END AS reason
FROM events LEFT JOIN customer ON c_custkey = user_id LEFT JOIN live ON user_id = o_custkey
WHERE c_custkey IS NULL OR run_id IS NULL
""",
)
def rejected_edits(spark, sf):
    return _append(spark, sf)[1].select("edit_id", "reason")


@query(
    "edit_summary",
    f"""
WITH {CURRENT_CTE},
e AS (SELECT run_id, o_orderstatus AS status, CASE WHEN event_type = 'view' THEN 'status' ELSE 'total' END AS path,
             value, ts, event_id
      FROM events JOIN live ON user_id = o_custkey WHERE user_id IN (SELECT c_custkey FROM customer)),
last AS (SELECT run_id, status, path, arg_max(value, (ts, event_id)) AS v, count(*) AS n FROM e GROUP BY ALL),
per AS (SELECT run_id, status, sum(n)::BIGINT AS applied, count(*)::INTEGER AS n_reviews,
               max(CASE WHEN path = 'status' THEN v END) AS s, max(CASE WHEN path = 'total' THEN v END) AS t
        FROM last GROUP BY ALL)
SELECT run_id AS extraction_run_id, applied, n_reviews,
       '{{"status":' || coalesce(CAST(s AS VARCHAR), '"' || status || '"') || coalesce(',"total":' || CAST(t AS VARCHAR), '') || '}}' AS "view"
FROM per
""",
)
def edit_summary(spark, sf):
    """Edits placed on the current runs, with the records that result from them."""
    accepted = _append(spark, sf)[0]
    clock = table(spark, sf, "events").select(F.col("event_id").alias("field_review_id"), F.col("ts").alias("created_at"))
    log = accepted.withColumnRenamed("edit_id", "field_review_id").join(clock, "field_review_id")
    view = R.extracted_view(_order_runs(spark, sf), log)
    return R.edit_summary(accepted, view).select(
        "extraction_run_id", "applied", F.size("reviews").alias("n_reviews"), "view"
    )


@query(
    "view_reviews",
    """
WITH r AS (SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS id, arg_max(value, (ts, event_id)) AS v,
                  min((ts, event_id)) AS seen FROM events GROUP BY ALL)
SELECT o_orderkey AS extraction_run_id, (row_number() OVER (PARTITION BY user_id ORDER BY seen) - 1)::INTEGER AS pos,
       id AS field_review_id, event_type AS field_path, CAST(v AS VARCHAR) AS edited_value
FROM r JOIN orders ON o_orderkey = user_id
""",
)
def view_reviews(spark, sf):
    """The list of reviews that goes with each view, in the order in which they apply."""
    view = R.extracted_view(_payload_runs(spark, sf), reviews(spark, sf))
    rows = view.select("extraction_run_id", F.posexplode("reviews").alias("pos", "r"))
    return rows.select("extraction_run_id", "pos", "r.field_review_id", "r.field_path", "r.edited_value")


@query(
    "bad_edits",
    """
SELECT event_id AS field_review_id, CASE event_type WHEN 'error' THEN 'invalid field path' ELSE 'value is not JSON' END AS reason
FROM events WHERE event_type IN ('error', 'signup')
""",
)
def bad_edits(spark, sf):
    """Edits of errors name a path with an empty step, sign-ups a value without quotes."""
    rows = reviews(spark, sf)
    rows = rows.withColumn(
        "field_path", F.when(F.col("field_path") == "error", "a..b").otherwise(F.col("field_path"))
    ).withColumn(
        "edited_value", F.when(F.col("field_path") == "signup", "no quotes").otherwise(F.col("edited_value"))
    )
    return R.check_edits(rows)[1].select("field_review_id", "reason")


@query(
    "view_field_pages",
    """
WITH last AS (SELECT user_id, arg_max(value, (ts, event_id)) AS v FROM events WHERE event_type = 'click' GROUP BY 1),
x AS (SELECT o_orderkey, 'ord' || o_orderkey AS ref,
             coalesce(regexp_replace(CAST(v AS VARCHAR), '[^0-9a-z]', '', 'g'), CAST(o_custkey AS VARCHAR)) AS click,
             CAST(o_custkey AS VARCHAR) AS cust
      FROM orders LEFT JOIN last ON user_id = o_orderkey)
SELECT o_orderkey AS extraction_run_id, 'ref' AS path, 1 AS page_no FROM x
UNION ALL
SELECT o_orderkey, 'click', 3 FROM x WHERE length(click) >= 2 AND (contains('c' || cust || 'z', click) OR contains(click, 'c' || cust || 'z'))
""",
)
def view_field_pages(spark, sf):
    """Pages of the values after the edits: an edited click is no longer found where the old one was."""
    o = F.col("o_orderkey").cast("string")
    cust = F.col("o_custkey").cast("string")

    def block(id_, text):
        return F.struct(
            F.lit(id_).alias("id"), F.lit("Text").alias("block_type"), text.alias("html"),
            F.lit(None).cast("string").alias("markdown"), F.lit(0).alias("page"),
        )

    runs_ = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("extraction_run_id"),
        F.to_json(F.struct(F.concat(F.lit("ORD-"), o).alias("ref"), F.col("o_custkey").alias("click"))).alias("extracted"),
        F.array(
            block("/page/0/Text/0", F.concat(F.lit("ord "), o)),
            block("/page/2/Text/1", F.concat(F.lit("c"), cust, F.lit("z"))),
        ).alias("blocks"),
    )
    edits = reviews(spark, sf).filter("field_path = 'click'")
    return R.view_field_pages(R.extracted_view(runs_, edits), "blocks")


@query(
    "delete_review",
    """
WITH req AS (SELECT event_id, CASE WHEN event_type = 'error' THEN user_id ELSE -1 END AS doc
             FROM events WHERE event_type IN ('error', 'view') AND value > 10),
gone AS (SELECT req.event_id FROM req JOIN events USING (event_id)
         JOIN orders ON o_orderkey = user_id AND o_custkey = doc)
SELECT user_id AS extraction_run_id, event_type AS field_path, arg_max(event_id, (ts, event_id)) AS field_review_id
FROM events WHERE event_id NOT IN (SELECT event_id FROM gone) GROUP BY ALL
""",
)
def delete_review(spark, sf):
    """Requests for large error edits name the user as the document, requests for views name none
    that exists; only those whose run belongs to the named document count."""
    rows = reviews(spark, sf)
    asked = rows.filter("field_path IN ('error', 'view') AND CAST(edited_value AS DOUBLE) > 10").select(
        "field_review_id",
        F.when(F.col("field_path") == "error", F.col("extraction_run_id"))
        .otherwise(F.lit(-1))
        .alias("document_id"),
    )
    left = R.delete_review(rows, runs(spark, sf), asked)
    return R.latest_reviews(left).select("extraction_run_id", "field_path", "field_review_id")


STATUS_CTE = """
ev AS (
  SELECT c_custkey AS document_id, TIMESTAMP '1990-01-01' AS moment, 0 AS k, 'uploaded' AS status FROM customer
  UNION ALL SELECT o_custkey, o_orderdate, 1, 'extracted' FROM orders
  UNION ALL SELECT o_custkey, l_shipdate, 2, 'reviewed' FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag = 'R'),
st AS (SELECT document_id, arg_max(status, (moment, k)) AS status FROM ev GROUP BY 1)
"""


def _status(spark, sf):
    documents = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("document_id"),
        F.lit("1990-01-01 00:00:00").cast("timestamp_ntz").alias("created_at"),
    )
    edits = table(spark, sf, "lineitem").filter("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("extraction_run_id"), F.col("l_shipdate").alias("created_at")
    )
    return R.document_status(documents, runs(spark, sf), edits)


@query("doc_status", f"WITH {STATUS_CTE} SELECT document_id, status FROM st")
def doc_status(spark, sf):
    return _status(spark, sf)


@query("open_queue", f"WITH {STATUS_CTE} SELECT document_id, status FROM st WHERE status <> 'reviewed'")
def open_queue(spark, sf):
    return R.open_queue(_status(spark, sf))
