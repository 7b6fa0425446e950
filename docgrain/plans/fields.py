"""Extracted fields and their anchors."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import values as V
from ..functions.barrier import unroll
from ..operators import anchors as A
from ..operators import fields as O
from ..operators import patterns as P
from .registry import LINES_CTE, norm_sql, query, spread, table

# ---- flattening --------------------------------------------------------------------------------------


def order_records(spark, sf):
    """Orders as nested records: plain values, a list of one, a list of values, line items, an
    object, an empty list and a null."""
    key = F.col("o_orderkey")
    record = F.struct(
        key.alias("number"),
        F.col("o_orderpriority").alias("terms"),
        F.array(F.col("o_orderstatus")).alias("single"),
        F.array(F.col("o_custkey").cast("string"), F.lit(None), F.lit("b")).alias("several"),
        F.array(
            F.struct(F.lit("x").alias("name"), F.col("o_custkey").alias("qty")),
            F.struct(F.lit(None).cast("string").alias("name"), key.alias("qty")),
        ).alias("items"),
        F.struct(F.lit("K").alias("name"), (F.col("o_orderstatus") == "F").alias("open")).alias("party"),
        F.array().cast("array<string>").alias("empty"),
        F.lit(None).cast("string").alias("remark"),
    )
    text = F.to_json(record, {"ignoreNullFields": "false"})
    orders = spread(table(spark, sf, "orders"), "o_orderkey")
    return orders.select("o_orderkey", V.as_variant(text).alias("extracted"))


LEAVES_SQL = """
SELECT o_orderkey, 'number' AS path, CAST(o_orderkey AS VARCHAR) AS value FROM orders
UNION ALL SELECT o_orderkey, 'terms', o_orderpriority FROM orders
UNION ALL SELECT o_orderkey, 'single[0]', o_orderstatus FROM orders
UNION ALL SELECT o_orderkey, 'several[0]', CAST(o_custkey AS VARCHAR) FROM orders
UNION ALL SELECT o_orderkey, 'several[2]', 'b' FROM orders
UNION ALL SELECT o_orderkey, 'items[0].name', 'x' FROM orders
UNION ALL SELECT o_orderkey, 'items[0].qty', CAST(o_custkey AS VARCHAR) FROM orders
UNION ALL SELECT o_orderkey, 'items[1].qty', CAST(o_orderkey AS VARCHAR) FROM orders
UNION ALL SELECT o_orderkey, 'party.name', 'K' FROM orders
UNION ALL SELECT o_orderkey, 'party.open', CASE WHEN o_orderstatus = 'F' THEN 'True' ELSE 'False' END FROM orders
"""


@query(
    "flatten_props",
    "SELECT event_id, 'k' AS path, json_extract_string(props, '$.k') AS value FROM events",
)
def flatten_props(spark, sf):
    rows = table(spark, sf, "events").select("event_id", V.as_variant(F.col("props")).alias("v"))
    return O.flatten_scalars(rows, "v", ["event_id"]).drop("ord")


@query("flatten_nested", LEAVES_SQL)
def flatten_nested(spark, sf):
    return O.flatten_scalars(order_records(spark, sf), "extracted", ["o_orderkey"]).drop("ord")


@query("flatten_keys", f"SELECT o_orderkey, path FROM ({LEAVES_SQL})")
def flatten_keys(spark, sf):
    return O.flatten_field_keys(
        order_records(spark, sf), "extracted", ["o_orderkey"]
    ).drop("ord")


@query(
    "split_scalars",
    """
SELECT o_orderkey, 'number' AS path, CAST(o_orderkey AS VARCHAR) AS value, 'number' AS leaf_type FROM orders
UNION ALL SELECT o_orderkey, 'terms', o_orderpriority, 'string' FROM orders
UNION ALL SELECT o_orderkey, 'single', o_orderstatus, 'string' FROM orders
UNION ALL SELECT o_orderkey, 'several', o_custkey || ', , b', 'string' FROM orders
UNION ALL SELECT o_orderkey, 'party.name', 'K', 'string' FROM orders
UNION ALL SELECT o_orderkey, 'party.open', CASE WHEN o_orderstatus = 'F' THEN 'true' ELSE 'false' END, 'boolean' FROM orders
UNION ALL SELECT o_orderkey, 'empty', NULL, 'null' FROM orders
UNION ALL SELECT o_orderkey, 'remark', NULL, 'null' FROM orders
""",
)
def split_scalars(spark, sf):
    return O.split_extraction(order_records(spark, sf), "extracted", ["o_orderkey"])[0]


@query(
    "split_tables",
    """
SELECT o_orderkey, 'items' AS path, 0 AS row_no, 'name' AS "column", 'x' AS value FROM orders
UNION ALL SELECT o_orderkey, 'items', 0, 'qty', CAST(o_custkey AS VARCHAR) FROM orders
UNION ALL SELECT o_orderkey, 'items', 1, 'name', NULL FROM orders
UNION ALL SELECT o_orderkey, 'items', 1, 'qty', CAST(o_orderkey AS VARCHAR) FROM orders
""",
)
def split_tables(spark, sf):
    return O.split_extraction(order_records(spark, sf), "extracted", ["o_orderkey"])[1]


@query(
    "norm_keys",
    f"""
SELECT 'part' AS origin, p_partkey AS id, {norm_sql('p_name')} AS norm FROM part
UNION ALL SELECT 'customer', c_custkey, {norm_sql('c_name')} FROM customer
""",
)
def norm_keys(spark, sf):
    parts = table(spark, sf, "part").select(
        F.lit("part").alias("origin"), F.col("p_partkey").alias("id"), X.norm_key(F.col("p_name")).alias("norm")
    )
    customers = table(spark, sf, "customer").select(
        F.lit("customer").alias("origin"), F.col("c_custkey").alias("id"), X.norm_key(F.col("c_name")).alias("norm")
    )
    return parts.unionByName(customers)


# ---- anchors ------------------------------------------------------------------------------------------

LINES_PER_PAGE = 5


def _records(spark, sf):
    """Documents with their record (title, closing line, source, language, size) and their lines as
    blocks, five lines to a page."""
    ls = F.split("text", "\n")
    fields = V.fixed_leaves(
        {
            "title": F.get(ls, F.lit(0)),
            "closing": F.element_at(ls, -1),
            "source": F.col("source"),
            "language": F.col("lang"),
            "size": F.col("n_chars"),
        }
    )
    blocks = F.transform(
        ls,
        lambda t, i: F.struct(
            F.concat(
                F.lit("/page/"), F.floor(i / LINES_PER_PAGE).cast("string"), F.lit("/Text/"),
                i.cast("string"),
            ).alias("id"),
            t.alias("html"),
            F.lit(None).cast("string").alias("markdown"),
            F.floor(i / LINES_PER_PAGE).cast("int").alias("page"),
        ),
    )
    docs = spread(table(spark, sf, "documents"), "doc_id")
    return docs.select("doc_id", fields.alias("fields"), blocks.alias("blocks"))


def _block_table(spark, sf):
    return _records(spark, sf).select("doc_id", F.posexplode_outer("blocks").alias("ord", "b")).select(
        "doc_id", "ord", F.col("b.id").alias("block_id"), "b.html", "b.markdown", "b.page"
    )


def anchor_cte(where: str = "true") -> str:
    return f"""
{LINES_CTE},
blk AS (SELECT doc_id, line_no, line_no // {LINES_PER_PAGE} AS page,
               {norm_sql("regexp_replace(line, '<[^>]+>', ' ', 'g')")} AS hay FROM ln),
f AS (
  SELECT doc_id, 0 AS field_ord, 'title' AS path, ls[1] AS value FROM txt
  UNION ALL SELECT doc_id, 1, 'closing', ls[-1] FROM txt
  UNION ALL SELECT doc_id, 2, 'source', source FROM documents
  UNION ALL SELECT doc_id, 3, 'language', lang FROM documents
  UNION ALL SELECT doc_id, 4, 'size', CAST(n_chars AS VARCHAR) FROM documents),
nd AS (SELECT *, {norm_sql('value')} AS needle FROM f),
cand AS (
  SELECT nd.doc_id, field_ord, path, line_no, page,
         row_number() OVER (PARTITION BY nd.doc_id, path ORDER BY length(hay), line_no) AS rn
  FROM nd JOIN blk ON nd.doc_id = blk.doc_id AND length(needle) >= 2 AND hay <> ''
       AND (contains(hay, needle) OR contains(needle, hay)) AND {where}),
anc AS (SELECT doc_id, CAST(field_ord AS BIGINT) AS field_ord, path, page,
               '/page/' || page || '/Text/' || line_no AS block_id FROM cand WHERE rn = 1)
"""


@query("anchor_lines", f"WITH {anchor_cte()} SELECT doc_id, field_ord, path, block_id FROM anc")
def anchor_lines(spark, sf):
    return A.anchors_in_payload(_records(spark, sf), "fields", "blocks", ["doc_id"])


@query(
    "anchor_lines_page",
    f"WITH {anchor_cte('page = 0')} SELECT doc_id, field_ord, path, block_id FROM anc",
)
def anchor_lines_page(spark, sf):
    return A.anchors_in_payload(_records(spark, sf), "fields", "blocks", ["doc_id"], page_no=1)


@query("anchor_tables", f"WITH {anchor_cte()} SELECT doc_id, field_ord, path, block_id FROM anc")
def anchor_tables(spark, sf):
    return A.anchors_over_tables(_records(spark, sf), "fields", _block_table(spark, sf), "doc_id")


@query("anchor_long_tables", f"WITH {anchor_cte()} SELECT doc_id, field_ord, path, block_id FROM anc")
def anchor_long_tables(spark, sf):
    fields = _records(spark, sf).select("doc_id", F.explode("fields").alias("f")).select("doc_id", "f.*")
    return A.anchors_in_chunks(fields, _block_table(spark, sf), "doc_id")


@query(
    "anchor_long_tables_page",
    f"WITH {anchor_cte('page = 0')} SELECT doc_id, field_ord, path, block_id FROM anc",
)
def anchor_long_tables_page(spark, sf):
    fields = _records(spark, sf).select("doc_id", F.explode("fields").alias("f")).select("doc_id", "f.*")
    return A.anchors_in_chunks(fields, _block_table(spark, sf), "doc_id", page_no=1)


@query("field_pages", f"WITH {anchor_cte()} SELECT doc_id, path, CAST(page + 1 AS INT) AS page_no FROM anc")
def field_pages(spark, sf):
    return A.field_pages(anchor_lines(spark, sf)).select("doc_id", "path", "page_no")


@query(
    "inverse_anchor",
    f"""
WITH {anchor_cte()}
SELECT doc_id, block_id, arg_max(path, field_ord) AS path FROM anc GROUP BY doc_id, block_id
""",
)
def inverse_anchor(spark, sf):
    return A.block_to_field(anchor_lines(spark, sf), ["doc_id"])


@query(
    "page_split",
    f"""
WITH {anchor_cte()}
SELECT f.doc_id, f.path, CASE WHEN page IS NULL THEN 'document' WHEN page = 0 THEN 'page' ELSE 'hidden' END AS placement
FROM f LEFT JOIN anc ON f.doc_id = anc.doc_id AND f.path = anc.path
""",
)
def page_split(spark, sf):
    scalars = _records(spark, sf).select("doc_id", F.explode("fields").alias("f")).select(
        "doc_id", F.col("f.path").alias("path")
    )
    # The record keeps its closing line as a list of one, so its page is filed under closing[0].
    pages = A.field_pages(anchor_lines(spark, sf)).withColumn(
        "path", F.when(F.col("path") == "closing", "closing[0]").otherwise(F.col("path"))
    )
    return O.page_split(scalars, pages, 1, ["doc_id"])


@query(
    "typed_leaves",
    """
SELECT o_orderkey, path, value FROM (
  SELECT o_orderkey, 'invoice_number' AS path, 'INV-' || o_orderkey AS value, o_orderstatus FROM orders
  UNION ALL SELECT o_orderkey, 'invoice_date', strftime(o_orderdate, '%Y-%m-%d'), o_orderstatus FROM orders
  UNION ALL SELECT o_orderkey, 'items[0].description', o_orderpriority, o_orderstatus FROM orders
  UNION ALL SELECT o_orderkey, 'items[0].quantity', CAST(o_orderkey AS VARCHAR), o_orderstatus FROM orders)
WHERE o_orderstatus = 'F'
""",
)
def typed_leaves(spark, sf):
    from ..schemas import RECORDS
    from ..sources.payloads import parse_extracted
    from .uploads import invoice_json

    records = parse_extracted(invoice_json(spark, sf), "extracted", "invoice")
    leaves = V.record_leaves(F.col("record"), RECORDS["invoice"])
    return unroll(records, leaves, ["o_orderkey"], "ord", "leaf").select("o_orderkey", "leaf.path", "leaf.value")


# ---- values -------------------------------------------------------------------------------------------


@query(
    "coerce_values",
    """
SELECT event_id, CASE event_type
  WHEN 'view' THEN CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END
  WHEN 'click' THEN '"click"'
  WHEN 'error' THEN CASE WHEN value > 10 THEN 'true' ELSE '"no"' END
  WHEN 'signup' THEN 'null'
  ELSE '"' || replace(props, '"', '\\"') || '"' END AS edited
FROM events
""",
)
def coerce_values(spark, sf):
    t = F.col("event_type")
    kind = (
        F.when(t.isin("view", "click"), "number").when(t == "error", "boolean").otherwise("string")
    )
    raw = (
        F.when(t == "view", F.col("value").cast("string"))
        .when(t == "click", t)
        .when(t == "error", F.when(F.col("value") > 10, "TRUE").otherwise("no"))
        .when(t == "signup", F.lit(""))
        .otherwise(F.col("props"))
    )
    return table(spark, sf, "events").select("event_id", V.coerce_edited(kind, raw).alias("edited"))


@query(
    "get_at_path",
    """
SELECT event_id, CASE event_type WHEN 'view' THEN json_extract_string(props, '$.k') END AS value FROM events
""",
)
def get_at_path(spark, sf):
    path = F.when(F.col("event_type") == "view", F.lit("k")).otherwise(F.lit("k.deeper"))
    return table(spark, sf, "events").select(
        "event_id", V.get_at_path(F.col("props"), path).alias("value")
    )


@query(
    "payload_contains",
    "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '7'",
)
def payload_contains(spark, sf):
    rows = table(spark, sf, "events").select("event_id", V.as_variant(F.col("props")).alias("v"))
    return O.payload_contains(rows, "v", {"k": 7}).select("event_id")


@query(
    "payload_contains_nested",
    "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_custkey = 7",
)
def payload_contains_nested(spark, sf):
    pattern = {"party": {"open": True}, "items": [{"qty": 7, "name": "x"}], "single": ["F"]}
    return O.payload_contains(order_records(spark, sf), "extracted", pattern).select("o_orderkey")


# One pattern per customer (their finished orders) and one per order (a list entry that joins its name and number).
@query(
    "payload_contains_table",
    """
SELECT o_orderkey, 'customer ' || c_custkey AS pattern_id FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'
UNION ALL SELECT a.o_orderkey, 'order ' || b.o_orderkey FROM orders a JOIN orders b ON a.o_custkey = b.o_orderkey
""",
)
def payload_contains_table(spark, sf):
    def entry(number):
        return F.array(F.struct(number.alias("qty"), F.lit("x").alias("name")))

    open_orders = F.struct(
        F.struct(F.lit(True).alias("open")).alias("party"), entry(F.col("c_custkey")).alias("items"), F.array(F.lit("F")).alias("single")
    )
    by_customer = table(spark, sf, "customer").select(
        F.concat(F.lit("customer "), "c_custkey").alias("pattern_id"), F.to_json(open_orders).alias("p")
    )
    by_order = table(spark, sf, "orders").select(
        F.concat(F.lit("order "), "o_orderkey").alias("pattern_id"), F.to_json(F.struct(entry(F.col("o_orderkey")).alias("items"))).alias("p")
    )
    asked = by_customer.unionByName(by_order).select("pattern_id", V.as_variant(F.col("p")).alias("pattern"))
    return P.payload_contains_many(order_records(spark, sf), "extracted", ["o_orderkey"], asked)
