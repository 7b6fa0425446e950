"""OCR blocks and document items."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import text as X
from ..functions.values import as_variant
from ..operators import blocks as B
from .registry import BLOCKS_CTE, LINES_CTE, PER_PAGE, lines, page_blocks, query, spread, strip_sql, table


@query(
    "strip_html_pages",
    f"""
SELECT page_id, {strip_sql('html')} AS text,
       CAST(length(regexp_replace(html, '<[^>]+>', ' ', 'g')) AS INT) AS anchor_chars
FROM pages
""",
)
def strip_html_pages(spark, sf):
    html = F.col("html")
    return spread(table(spark, sf, "pages"), "page_id").select(
        "page_id",
        X.strip_html(html).alias("text"),
        F.length(X.anchor_text(html)).alias("anchor_chars"),
    )


@query(
    "list_items_pages",
    f"""
WITH li AS (SELECT page_id, regexp_extract_all(html, '(?is)<li[^>]*>(.*?)</li>', 1) AS xs FROM pages),
u AS (SELECT page_id, unnest(xs) AS x, generate_subscripts(xs, 1) - 1 AS item_ord FROM li)
SELECT page_id, CAST(item_ord AS INT) AS item_ord, {strip_sql('x')} AS text FROM u
""",
)
def list_items_pages(spark, sf):
    return B.list_items(spread(table(spark, sf, "pages"), "page_id"), "html", ["page_id"])


@query(
    "exploded_blocks",
    f"""
WITH {BLOCKS_CTE}
SELECT page_id, CAST(ord AS INT) AS ord, '/page/' || page || '/' || block_type || '/' || ord AS block_id,
       block_type, CAST(page + 1 AS INT) AS page_no, {strip_sql('html')} AS text,
       CASE block_type WHEN 'SectionHeader' THEN 'section_header' WHEN 'PageFooter' THEN 'page_footer'
            ELSE 'text' END AS label
FROM blk
""",
)
def exploded_blocks(spark, sf):
    rows = B.explode_blocks(page_blocks(spark, sf), "blocks", ["page_id"])
    return rows.select(
        "page_id",
        "ord",
        "block_id",
        "block_type",
        X.block_id_page(F.col("block_id")).alias("page_no"),
        X.display_text(F.col("html"), F.col("markdown")).alias("text"),
        X.block_label(F.col("block_type")).alias("label"),
    )


# ---- tables ----------------------------------------------------------------------------------------


def order_tables(spark, sf):
    """One HTML table per order, with a spanning header, a spanning cell and entities; the tables
    of finished orders carry an unreadable span."""
    span = F.when(F.col("o_orderstatus") == "F", F.lit("x")).otherwise(F.lit("2"))
    html = F.concat(
        F.lit('<table><tr><th colspan="2">'), "o_orderpriority", F.lit("</th><th>"),
        F.col("o_orderkey").cast("string"), F.lit('</th></tr><tr><td rowspan="'), span,
        F.lit('">'), "o_orderstatus", F.lit("</td><td> "), F.col("o_custkey").cast("string"),
        F.lit(" </td><th>a<br>b</th></tr><tr><td>x &amp; y</td><td></td></tr></table>"),
    )
    orders = spread(table(spark, sf, "orders"), "o_orderkey")
    return orders.select("o_orderkey", html.alias("html"))


@query(
    "table_cells",
    """
WITH good AS (SELECT * FROM orders WHERE o_orderstatus <> 'F'),
cells AS (
  SELECT o_orderkey, 0 AS cell_ord, 0 AS row_no, 0 AS col_no, 1 AS row_span, 2 AS col_span, o_orderpriority AS text, true AS column_header, false AS row_header FROM good
  UNION ALL SELECT o_orderkey, 1, 0, 2, 1, 1, CAST(o_orderkey AS VARCHAR), true, false FROM good
  UNION ALL SELECT o_orderkey, 2, 1, 0, 2, 1, o_orderstatus, false, false FROM good
  UNION ALL SELECT o_orderkey, 3, 1, 1, 1, 1, CAST(o_custkey AS VARCHAR), false, false FROM good
  UNION ALL SELECT o_orderkey, 4, 1, 2, 1, 1, 'a' || chr(10) || 'b', false, true FROM good
  UNION ALL SELECT o_orderkey, 5, 2, 1, 1, 1, 'x & y', false, false FROM good
  UNION ALL SELECT o_orderkey, 6, 2, 2, 1, 1, '', false, false FROM good)
SELECT *, 3 AS num_rows, 3 AS num_cols FROM cells
UNION ALL
SELECT o_orderkey, 0, 0, 0, 1, 1, o_orderpriority || ' ' || o_orderkey || ' F ' || o_custkey || ' a b x & y', false, false, 1, 1
FROM orders WHERE o_orderstatus = 'F'
""",
)
def table_cells(spark, sf):
    return B.html_table_cells(order_tables(spark, sf), "html", ["o_orderkey"])


# ---- statistics -----------------------------------------------------------------------------------


@query(
    "block_stats",
    f"""
WITH {BLOCKS_CTE},
ex AS (SELECT *, row_number() OVER (PARTITION BY block_type ORDER BY page_id, ord) AS rn FROM blk),
n AS (SELECT block_type, count(*) AS n_blocks FROM blk GROUP BY 1)
SELECT block_type, n_blocks, page_id AS example_doc, CAST(ord AS INT) AS example_ord,
       false AS has_polygon, true AS has_bbox, html,
       'bbox,block_type,html,id,page' || CASE block_type WHEN 'SectionHeader' THEN ',section_hierarchy' ELSE '' END AS example_keys
FROM n JOIN ex USING (block_type) WHERE rn = 1
""",
)
def block_stats(spark, sf):
    rows = B.explode_blocks(page_blocks(spark, sf), "blocks", ["page_id"])
    stats = B.block_type_stats(rows, "page_id")
    return stats.withColumn("example_keys", F.array_join("example_keys", ","))


# ---- geometry -------------------------------------------------------------------------------------


def _line_boxes(spark, sf):
    """Line items as boxes: 'F' rows carry four numbers, 'O' rows a polygon, returned rows neither."""
    q, p = F.col("l_quantity"), F.col("l_partkey").cast("double")
    x0, y0 = F.col("l_linenumber").cast("double"), q
    corners = F.array(
        F.array(x0, y0), F.array(x0 + p, y0 + 1), F.array(x0 + p, y0 + 3), F.array(x0, y0 + 2)
    )
    kept = F.col("l_returnflag") != "R"
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.when(kept & (F.col("l_linestatus") == "F"), F.array(x0, y0, x0 + p, y0 + 5)).alias("bbox"),
        F.when(kept & (F.col("l_linestatus") == "O"), corners).alias("polygon"),
    )


@query(
    "block_boxes",
    """
WITH b AS (SELECT *, CAST(l_linenumber AS DOUBLE) AS x, l_quantity AS y, CAST(l_partkey AS DOUBLE) AS p,
                  CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_linestatus END AS st FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
       CASE WHEN st IS NOT NULL THEN x END AS l, CASE WHEN st IS NOT NULL THEN y END AS t,
       CASE WHEN st IS NOT NULL THEN x + p END AS r,
       CASE st WHEN 'F' THEN y + 5 WHEN 'O' THEN y + 3 END AS b,
       CASE st WHEN 'F' THEN y WHEN 'O' THEN y + 1 END AS quad_y2,
       CASE st WHEN 'F' THEN y + 5 WHEN 'O' THEN y + 2 END AS quad_y4
FROM b
""",
)
def block_boxes(spark, sf):
    rows = _line_boxes(spark, sf)
    box = G.block_box(F.col("bbox"), F.col("polygon"))
    quad = G.block_quad(F.col("polygon"), F.col("bbox"))

    def y(i):
        return F.get(F.get(quad, F.lit(i)), F.lit(1))

    return rows.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        *[box.getField(s).alias(s) for s in "ltrb"],
        y(1).alias("quad_y2"),
        y(3).alias("quad_y4"),
    )


@query(
    "scale_blocks",
    f"""
WITH {BLOCKS_CTE},
pg AS (SELECT DISTINCT page_id, page + 1 AS page_no, 100.0 + page_id AS w, 50.0 * (page + 1) AS h,
              CASE WHEN starts_with(url, 'https') THEN 200.0 END AS sw,
              CASE WHEN starts_with(url, 'https') THEN 100.0 END AS sh FROM blk)
SELECT b.page_id, CAST(b.page + 1 AS INT) AS page_no, '/page/' || b.page || '/' || block_type || '/' || ord AS block_id,
       block_type, round(CAST(0.0 AS DOUBLE), 6) AS l,
       round(CAST(ord % {PER_PAGE} * 10 AS DOUBLE) * coalesce(h / sh, 1.0), 6) AS t,
       round(CAST(length(html) AS DOUBLE) * coalesce(w / sw, 1.0), 6) AS r,
       round(CAST(ord % {PER_PAGE} * 10 + 8 AS DOUBLE) * coalesce(h / sh, 1.0), 6) AS b
FROM blk b JOIN pg ON pg.page_id = b.page_id AND pg.page_no = b.page + 1
""",
)
def scale_blocks(spark, sf):
    source = page_blocks(spark, sf)
    rows = B.explode_blocks(source, "blocks", ["page_id"])
    n_pages = B.page_count(
        F.lit(None).cast("int"), F.lit(None).cast("int"), F.col("blocks")
    )
    info = as_variant(
        F.when(
            F.col("url").startswith("https"),
            F.to_json(
                F.map_from_entries(
                    F.transform(
                        F.sequence(F.lit(0), n_pages - 1),
                        lambda p: F.struct(
                            p.cast("string"),
                            F.struct(F.array(*[F.lit(v) for v in (0.0, 0.0, 200.0, 100.0)]).alias("bbox")),
                        ),
                    )
                )
            ),
        )
    )
    pages = source.select(
        "page_id", info.alias("info"), F.explode(F.sequence(F.lit(1), n_pages)).alias("page_no")
    ).select(
        "page_id",
        "page_no",
        (F.lit(100.0) + F.col("page_id")).alias("width_px"),
        (F.lit(50.0) * F.col("page_no")).alias("height_px"),
        B.page_dims(F.col("info"), F.col("page_no")).alias("d"),
    ).select("page_id", "page_no", "width_px", "height_px",
             F.col("d.width").alias("source_w"), F.col("d.height").alias("source_h"))
    out = B.scale_blocks(rows, pages, ["page_id"])
    return out.select(
        "page_id", "page_no", "block_id", "block_type",
        *[F.round(F.col("bbox").getField(s), 6).alias(s) for s in "ltrb"],
    )


@query(
    "section_level",
    """
SELECT p_partkey, CASE WHEN p_type = 'ECONOMY' THEN 1 ELSE CAST(least(p_size, 6) AS INT) END AS level FROM part
""",
)
def section_level(spark, sf):
    other = F.when(F.col("p_type") == "ECONOMY", F.lit("h")).otherwise(F.lit("0"))
    hierarchy = F.create_map(
        F.col("p_size").cast("string"), F.lit("a"), other, F.lit("b")
    )
    return table(spark, sf, "part").select("p_partkey", X.section_level(hierarchy).alias("level"))


@query(
    "page_sizes_fill",
    """
WITH d AS (SELECT doc_id, lang, CAST(greatest(ceil(n_chars / 1000.0), 1) AS INT) AS n, n_chars FROM documents),
p AS (SELECT doc_id, lang, n, n_chars, unnest(generate_series(1, n)) AS page_no FROM d),
extra AS (SELECT doc_id, lang, n, n_chars, 2 AS page_no FROM d WHERE lang = 'fr' AND n < 2),
a AS (SELECT * FROM p UNION ALL SELECT * FROM extra)
SELECT doc_id, CAST(page_no AS INT) AS page_no,
       CASE WHEN lang = 'en' AND page_no = 1 THEN CAST(n_chars + 1 AS DOUBLE) WHEN lang = 'fr' AND page_no = 2 THEN 300.0 ELSE 612.0 END AS width,
       CAST(CASE WHEN lang = 'en' AND page_no = 1 THEN 500 WHEN lang = 'fr' AND page_no = 2 THEN 400 ELSE 792 END AS DOUBLE) AS height
FROM a
""",
)
def page_sizes_fill(spark, sf):
    docs = table(spark, sf, "documents")
    by_key = F.concat(
        F.lit('{"0":{"width":'), (F.col("n_chars") + 1).cast("string"),
        F.lit(',"height":500},"x":{"width":1,"height":1},"1":{"width":0,"height":9}}'),
    )
    listed = F.lit(
        '[{"page":1,"width":9,"height":9},{"index":1,"page_width":300,"page_height":400},7]'
    )
    info = F.when(F.col("lang") == "en", by_key).when(F.col("lang") == "fr", listed)
    rows = docs.select(
        "doc_id",
        as_variant(info).alias("page_info"),
        F.greatest(F.ceil(F.col("n_chars") / 1000), F.lit(1)).cast("int").alias("n"),
    )
    return B.page_sizes(rows, "page_info", "n", ["doc_id"])


# ---- document items --------------------------------------------------------------------------------

ITEMS_CTE = f"""
{BLOCKS_CTE},
head AS (
  SELECT page_id, ord, 0 AS item_ord,
         CASE block_type WHEN 'SectionHeader' THEN 'heading' WHEN 'ListGroup' THEN 'list' ELSE 'text' END AS kind,
         CASE block_type WHEN 'SectionHeader' THEN 'section_header' WHEN 'ListGroup' THEN 'list'
              WHEN 'PageFooter' THEN 'page_footer' ELSE 'text' END AS label,
         CASE block_type WHEN 'SectionHeader' THEN 2 END AS level,
         CASE WHEN block_type <> 'ListGroup' THEN {strip_sql('html')} END AS text,
         CASE WHEN block_type <> 'ListGroup' THEN page + 1 END AS page_no, length(html) AS width
  FROM blk),
lx AS (SELECT page_id, ord, page, length(html) AS width, regexp_extract_all(html, '(?is)<li[^>]*>(.*?)</li>', 1) AS xs
       FROM blk WHERE block_type = 'ListGroup'),
lu AS (SELECT page_id, ord, page, width, unnest(xs) AS x, generate_subscripts(xs, 1) AS item_ord FROM lx),
items AS (
  SELECT page_id, ord, item_ord, kind, label, level, text, page_no, width FROM head
  UNION ALL
  SELECT page_id, ord, item_ord, 'list_item', 'list_item', NULL, {strip_sql('x')}, page + 1, width FROM lu)
"""


@query(
    "document_items",
    f"""
WITH {ITEMS_CTE}
SELECT page_id, CAST(ord AS INT) AS ord, CAST(item_ord AS INT) AS item_ord, kind, label,
       CAST(level AS INT) AS level, text, CAST(page_no AS INT) AS page_no, CAST(length(text) AS INT) AS chars,
       CASE WHEN kind <> 'list' THEN CAST(0 AS DOUBLE) END AS l,
       CASE WHEN kind <> 'list' THEN CAST(ord % {PER_PAGE} * 10 AS DOUBLE) END AS t,
       CASE WHEN kind <> 'list' THEN CAST(width AS DOUBLE) END AS r,
       CASE WHEN kind <> 'list' THEN CAST(ord % {PER_PAGE} * 10 + 8 AS DOUBLE) END AS b
FROM items
""",
)
def document_items(spark, sf):
    items = _items(spark, sf)
    return items.select(*[c for c in items.columns if c != "bbox"], "bbox.*")


def _items(spark, sf):
    rows = B.explode_blocks(page_blocks(spark, sf), "blocks", ["page_id"])
    return B.document_items(rows, ["page_id"])[0]


@query(
    "doc_item_counts",
    f"""
WITH {ITEMS_CTE}
SELECT page_id, count(*) FILTER (kind IN ('heading', 'text', 'list_item')) AS texts,
       CAST(0 AS BIGINT) AS tables, CAST(0 AS BIGINT) AS pictures,
       CAST(max(page_no) AS INT) AS last_page, count(*) FILTER (item_ord = 0) AS blocks
FROM items GROUP BY page_id
""",
)
def doc_item_counts(spark, sf):
    return B.doc_item_counts(_items(spark, sf), ["page_id"])


@query(
    "rejected_blocks",
    """
SELECT p_partkey, 0 AS ord, '/page/0/SectionHeader/0' AS block_id, 'SectionHeader' AS block_type,
       CASE WHEN p_size % 5 = 0 THEN 'unreadable box' WHEN p_size % 5 = 1 THEN 'unreadable polygon'
            ELSE 'heading level below 1' END AS reason
FROM part WHERE p_type = 'ECONOMY' OR p_size % 5 < 2
""",
)
def rejected_blocks(spark, sf):
    """Part headings; those of the economy line claim level 0, some sizes come with a box or a
    polygon that lacks a number, and none of these can become an item."""
    level = F.when(F.col("p_type") == "ECONOMY", F.lit("0")).otherwise(F.lit("3"))
    block = F.struct(
        F.lit("/page/0/SectionHeader/0").alias("id"),
        F.lit("SectionHeader").alias("block_type"),
        F.col("p_name").alias("html"),
        F.lit(None).cast("string").alias("markdown"),
        F.lit(0).alias("page"),
        F.when(F.col("p_size") % 5 == 1, F.expr("array(array(1D, 2D), array(3D))"))
        .otherwise(F.expr("array(array(1D, 2D), array(3D, 4D))"))
        .alias("polygon"),
        F.when(F.col("p_size") % 5 == 0, F.expr("array(1D, null, 2D, 3D)")).alias("bbox"),
        F.create_map(level, F.lit("s")).alias("section_hierarchy"),
    )
    runs = table(spark, sf, "part").select("p_partkey", F.array(block).alias("blocks"))
    return B.document_items(B.explode_blocks(runs, "blocks", ["p_partkey"]), ["p_partkey"])[1]


@query(
    "document_text",
    f"""
WITH {ITEMS_CTE},
parts AS (
  SELECT page_id, ord, CASE any_value(kind ORDER BY item_ord) WHEN 'heading' THEN '## ' || any_value(text ORDER BY item_ord)
         WHEN 'list' THEN coalesce(string_agg('- ' || text, chr(10) ORDER BY item_ord) FILTER (item_ord > 0), '')
         ELSE any_value(text ORDER BY item_ord) END AS part
  FROM items GROUP BY page_id, ord)
SELECT page_id, string_agg(part, chr(10) || chr(10) ORDER BY ord) AS text
FROM parts WHERE part <> '' GROUP BY page_id
""",
)
def document_text(spark, sf):
    return B.document_text(page_blocks(spark, sf), "blocks", ["page_id"], tables=False)


@query(
    "document_text_tables",
    """
SELECT o_orderkey,
       CASE WHEN o_orderstatus = 'F'
            THEN '| ' || o_orderpriority || ' ' || o_orderkey || ' F ' || o_custkey || ' a b x & y |'
            ELSE '| ' || o_orderpriority || ' | ' || o_orderkey || ' |' || chr(10) || '| ' || o_orderstatus || ' | '
                 || o_custkey || ' | a b |' || chr(10) || '| x & y |  |' END AS text
FROM orders
""",
)
def document_text_tables(spark, sf):
    block = F.struct(
        F.lit("/page/0/Table/0").alias("id"),
        F.lit("Table").alias("block_type"),
        F.col("html"),
        F.lit(None).cast("string").alias("markdown"),
        F.lit(None).cast("map<string,string>").alias("section_hierarchy"),
    )
    docs = order_tables(spark, sf).select("o_orderkey", F.array(block).alias("blocks"))
    return B.document_text(docs, "blocks", ["o_orderkey"])


@query(
    "compact_fragments",
    """
SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS INT) AS frag_ord,
       CASE l_linestatus WHEN 'F' THEN '#/texts/' || l_linenumber ELSE 'f' || l_linenumber END AS id,
       CASE WHEN l_returnflag = 'R' THEN '' ELSE l_returnflag END AS text, l_quantity AS l
FROM lineitem
""",
)
def compact_fragments(spark, sf):
    n = F.col("l_linenumber")
    frags = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey",
        n.alias("frag_ord"),
        F.when(
            F.col("l_linestatus") == "F", F.concat(F.lit("#/texts/"), n.cast("string"))
        ).alias("self_ref"),
        F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")).alias("text"),
        G.box(F.col("l_quantity"), n, n, n).alias("bbox"),
    )
    out = B.compact_fragments(frags, ["l_orderkey", "l_partkey", "l_suppkey"])
    return out.withColumn("l", F.col("bbox.l")).drop("bbox")


@query(
    "compact_scaffold",
    """
WITH l AS (SELECT l_orderkey AS k, count(*) AS n, min(l_linenumber) AS lo FROM lineitem GROUP BY 1)
SELECT o_orderkey, CAST(1 AS INT) AS n_pages, CAST(o_custkey AS DOUBLE) AS width, CAST(coalesce(n, 0) AS INT) AS n_texts,
       'f' || lo AS first_id
FROM orders LEFT JOIN l ON k = o_orderkey
""",
)
def compact_scaffold(spark, sf):
    page = F.struct(F.lit(1).alias("page"), F.col("o_custkey").cast("double").alias("width"), F.lit(792.0).alias("height"))
    scaffolds = table(spark, sf, "orders").select("o_orderkey", F.array(page).alias("pages"))
    n = F.col("l_linenumber")
    frags = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("o_orderkey"), n.alias("frag_ord"), F.lit(None).cast("string").alias("self_ref"),
        F.col("l_returnflag").alias("text"), G.box(n, n, n, n).alias("bbox"),
    )
    out = B.compact_scaffold(scaffolds, frags, ["o_orderkey"])
    return out.select(
        "o_orderkey", F.size("pages").alias("n_pages"), F.get("pages", F.lit(0))["width"].alias("width"),
        F.size("texts").alias("n_texts"), F.get("texts", F.lit(0))["id"].alias("first_id"),
    )


# ---- term search -------------------------------------------------------------------------------------

# Words looked for in every line of every document.
TERMS = ["Outre", "ciónado", "WORTHLESS", "thtion", "lesheit"]


@query(
    "term_hits",
    f"""
WITH {LINES_CTE}, t AS (SELECT unnest({TERMS!r}) AS term)
SELECT doc_id, CAST(line_no AS INT) AS line_no, term, round(length(line) / CAST(n_chars AS DOUBLE), 3) AS confidence, line AS text
FROM ln JOIN documents USING (doc_id) JOIN t ON contains(lower(line), lower(term))
""",
)
def term_hits(spark, sf):
    rows = lines(spark, sf).select(
        "doc_id", "line_no", F.col("line").alias("text"),
        F.try_divide(F.length("line"), "n_chars").alias("confidence"),
    )
    return B.line_term_hits(rows, TERMS, ["doc_id"])


@query(
    "first_term_lines",
    f"""
WITH {LINES_CTE}, t AS (SELECT unnest({TERMS!r}) AS term)
SELECT doc_id, term, CAST(min(line_no) AS INT) AS line_no, arg_min(line, line_no) AS text
FROM ln JOIN t ON contains(lower(line), lower(term)) GROUP BY doc_id, term
""",
)
def first_term_lines(spark, sf):
    rows = lines(spark, sf).select(
        "doc_id", "line_no", F.col("line").alias("text"), F.lit(None).cast("double").alias("confidence")
    )
    return B.first_term_lines(rows, TERMS, ["doc_id"])


# Every two neighbouring words of the benchmark texts, as a table of terms.
TERM_TABLE_CTE = r"""
bw AS (SELECT string_split_regex(text, '[\x20\x09-\x0D]+') AS ws FROM benchmark),
pairs AS (SELECT DISTINCT unnest(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) AS term FROM bw),
t AS MATERIALIZED (SELECT term, lower(term) AS low_term FROM pairs),
low AS MATERIALIZED (SELECT doc_id, line_no, line, lower(line) AS low_line FROM ln)
"""


def term_table(spark, sf):
    words = F.split("text", r"[\x20\x09-\x0D]+")
    pairs = F.transform(F.slice(words, 1, F.size(words) - 1), lambda w, i: F.concat(w, F.lit(" "), F.get(words, i + 1)))
    return table(spark, sf, "benchmark").select(F.explode(pairs).alias("term")).distinct()


@query(
    "term_table_hits",
    f"""
WITH {LINES_CTE}, {TERM_TABLE_CTE}
SELECT doc_id, CAST(line_no AS INT) AS line_no, term, round(length(line) / CAST(n_chars AS DOUBLE), 3) AS confidence, line AS text
FROM low JOIN t ON contains(low_line, low_term) JOIN documents USING (doc_id)
""",
)
def term_table_hits(spark, sf):
    rows = lines(spark, sf).select(
        "doc_id", "line_no", F.col("line").alias("text"),
        F.try_divide(F.length("line"), "n_chars").alias("confidence"),
    )
    return B.line_term_table_hits(rows, term_table(spark, sf), ["doc_id"])


@query(
    "first_table_term_lines",
    f"""
WITH {LINES_CTE}, {TERM_TABLE_CTE}
SELECT doc_id, term, CAST(min(line_no) AS INT) AS line_no, arg_min(line, line_no) AS text
FROM low JOIN t ON contains(low_line, low_term) GROUP BY doc_id, term
""",
)
def first_table_term_lines(spark, sf):
    rows = lines(spark, sf).select(
        "doc_id", "line_no", F.col("line").alias("text"), F.lit(None).cast("double").alias("confidence")
    )
    return B.first_of_table_terms(rows, term_table(spark, sf), ["doc_id"])


# ---- document items of every kind ----------------------------------------------------------------------

LINE = ["l_orderkey", "l_partkey", "l_suppkey"]


def _mixed_items(spark, sf):
    """Order lines as blocks: heading, Markdown text in a polygon, table, picture, list, text without page, caption."""
    n, q = F.col("l_linenumber"), F.col("l_quantity")
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    kinds = ["SectionHeader", "Text", "Table", "Picture", "ListGroup", "Text", "Caption"]
    html = (
        F.when(n == 1, F.concat(F.lit("<h2>Order "), F.col("l_orderkey"), F.lit("</h2>")))
        .when(n == 3, F.concat(F.lit("<table><tr><td>"), flag, F.lit("</td><td>"), status, F.lit("</td></tr></table>")))
        .when(n == 4, F.lit('<img src="x.png">'))
        .when(n == 5, F.concat(F.lit("<ul><li>"), flag, F.lit("</li><li>a &amp; "), status, F.lit("</li></ul>")))
        .when(n > 5, F.concat(F.lit("<p>"), flag, F.lit("</p>")))
    )
    polygon = F.array(F.array(q, F.lit(1.0)), F.array(q + 2, F.lit(1.5)), F.array(q + 1, F.lit(4.0)))
    blocks = table(spark, sf, "lineitem").select(
        *LINE,
        n.alias("ord"),
        F.concat(F.lit("b"), n).alias("block_id"),
        F.get(F.array(*map(F.lit, kinds)), n - 1).alias("block_type"),
        html.alias("html"),
        F.when(n == 2, F.concat(F.lit("  **"), flag, F.lit("** "))).alias("markdown"),
        F.when(n != 6, F.floor(n / 3).cast("int")).alias("page"),
        F.when(n.isin(2, 5), polygon).alias("polygon"),
        F.when(n.isin(1, 3, 6), F.array(F.lit(0.0), n.cast("double"), q, n + 8.0)).alias("bbox"),
        F.when(n == 1, F.create_map(F.lit("1"), F.lit("/a"), F.lit("3"), F.lit("/b"))).alias("section_hierarchy"),
    )
    return B.document_items(blocks, LINE)[0]


MIXED_ITEMS_CTE = """
li AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber AS n, l_quantity AS q, l_returnflag AS f, l_linestatus AS s FROM lineitem),
head AS (
  SELECT *, 0 AS item_ord,
         CASE n WHEN 1 THEN 'heading' WHEN 3 THEN 'table' WHEN 4 THEN 'picture' WHEN 5 THEN 'list' ELSE 'text' END AS kind,
         CASE n WHEN 1 THEN 'section_header' WHEN 3 THEN 'table' WHEN 4 THEN 'picture' WHEN 5 THEN 'list' WHEN 7 THEN 'caption' ELSE 'text' END AS label,
         CASE n WHEN 1 THEN 'Order ' || l_orderkey WHEN 2 THEN '**' || f || '**' WHEN 3 THEN f || ' ' || s ELSE f END AS words
  FROM li),
entries AS (SELECT *, unnest([f, 'a & ' || s]) AS words, unnest([1, 2]) AS item_ord FROM li WHERE n = 5),
items AS (
  SELECT l_orderkey, l_partkey, l_suppkey, n, q, item_ord, kind, label, CASE n WHEN 1 THEN 3 END AS level,
         CASE WHEN n NOT IN (3, 4, 5) THEN words END AS text, CASE WHEN n IN (1, 2, 3, 6) THEN length(words) END AS chars, n IN (1, 2, 3, 6) AS placed
  FROM head
  UNION ALL
  SELECT l_orderkey, l_partkey, l_suppkey, n, q, item_ord, 'list_item', 'list_item', NULL, words, length(words), true FROM entries),
placed AS (
  SELECT *, CASE WHEN placed THEN CASE WHEN n = 6 THEN 1 ELSE n // 3 + 1 END END AS page_no,
         CASE WHEN placed THEN CASE WHEN n IN (2, 5) THEN q ELSE 0 END END AS l, CASE WHEN placed THEN CASE WHEN n IN (2, 5) THEN 1 ELSE n END END AS t,
         CASE WHEN placed THEN CASE WHEN n IN (2, 5) THEN q + 2 ELSE q END END AS r, CASE WHEN placed THEN CASE WHEN n IN (2, 5) THEN 4 ELSE n + 8 END END AS b
  FROM items)
"""


@query(
    "document_items_mixed",
    f"""
WITH {MIXED_ITEMS_CTE}
SELECT l_orderkey, l_partkey, l_suppkey, CAST(n AS INT) AS ord, CAST(item_ord AS INT) AS item_ord, kind, label, CAST(level AS INT) AS level, text,
       CAST(page_no AS INT) AS page_no, CAST(chars AS INT) AS chars, CAST(l AS DOUBLE) AS l, CAST(t AS DOUBLE) AS t, CAST(r AS DOUBLE) AS r, CAST(b AS DOUBLE) AS b
FROM placed
""",
)
def document_items_mixed(spark, sf):
    items = _mixed_items(spark, sf)
    return items.select(*[c for c in items.columns if c != "bbox"], "bbox.*")


@query(
    "doc_item_counts_mixed",
    f"""
WITH {MIXED_ITEMS_CTE}
SELECT l_orderkey, count(*) FILTER (kind IN ('heading', 'text', 'list_item')) AS texts, count(*) FILTER (kind = 'table') AS tables,
       count(*) FILTER (kind = 'picture') AS pictures, CAST(max(page_no) AS INT) AS last_page, count(*) FILTER (item_ord = 0) AS blocks
FROM placed GROUP BY l_orderkey
""",
)
def doc_item_counts_mixed(spark, sf):
    return B.doc_item_counts(_mixed_items(spark, sf), ["l_orderkey"])
