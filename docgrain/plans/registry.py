"""Query registry and the views that read the given tables in the shapes of the data model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.barrier import compute_once
from ..functions.text import strip_html

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query, with its SQL where the result can be stated in SQL."""

    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Rows of a table kept in fewer splits than there are cores, hashed over all cores.

    For work that is heavy per row (HTML, text). A table with enough splits is left as it is, so
    at scale nothing is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df._jdf.queryExecution().toRdd().getNumPartitions()
    return df if splits >= cores else df.repartition(cores, key)


# ---- events as field reviews: a user is a run, an event type a field ---------------------------


def reviews(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_id").alias("field_review_id"),
        F.col("user_id").alias("extraction_run_id"),
        F.col("event_type").alias("field_path"),
        F.get_json_object("props", "$.k").alias("original_value"),
        F.col("value").cast("string").alias("edited_value"),
        F.col("props").alias("remark"),
        F.col("ts").alias("created_at"),
    )


# ---- orders as extraction runs: a customer is a document ----------------------------------------


def runs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("extraction_run_id"),
        F.col("o_custkey").alias("document_id"),
        F.col("o_orderpriority").alias("llm_model"),
        F.col("o_orderstatus").alias("doc_type"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("duration_ms"),
        F.col("o_orderdate").alias("created_at"),
    )


# ---- pages as OCR payloads: the elements of a web page are its blocks ----------------------------

# Not text: scripts, styles, comments and the document type; what is not closed runs to the end.
HIDDEN = r"(?is)<script\b.*?(?:</script>|\z)|<style\b.*?(?:</style>|\z)|<!--.*?(?:-->|\z)|<!doctype[^>]*>"
# Elements that start and end a block. What stands between two of them is a block of its own.
BLOCK_TAGS = "title|h1|ul|p|div|nav|article|footer"
CUT = "\x01"
PER_PAGE = 10  # blocks per page of the payload


def page_elements(html: Column) -> Column:
    """The page cut at the tags of its block elements; pieces without text are left out.

    Every character of the page that is not hidden lies in exactly one piece or in one without text.
    """
    shown = F.regexp_replace(html, HIDDEN, " ")
    opened = F.regexp_replace(shown, rf"(?i)(<(?:{BLOCK_TAGS})(?:\s[^>]*)?>)", f"{CUT}$1")
    closed = F.regexp_replace(opened, f"(?i)(</(?:{BLOCK_TAGS})>)", f"$1{CUT}")
    return F.filter(F.split(closed, CUT), lambda p: strip_html(p) != "")


def page_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """(page_id, url, blocks): the payload's block array, built inside each row."""

    def block(e, i):
        kind = (
            F.when(e.startswith("<h1"), "SectionHeader")
            .when(e.startswith("<ul"), "ListGroup")
            .when(e.startswith("<footer"), "PageFooter")
            .otherwise("Text")
        )
        page = F.floor(i / PER_PAGE).cast("int")
        top = (i % PER_PAGE * 10).cast("double")
        return F.struct(
            F.concat(
                F.lit("/page/"), page.cast("string"), F.lit("/"), kind, F.lit("/"),
                i.cast("string"),
            ).alias("id"),
            kind.alias("block_type"),
            e.alias("html"),
            F.lit(None).cast("string").alias("markdown"),
            page.alias("page"),
            F.lit(None).cast("array<array<double>>").alias("polygon"),
            F.array(F.lit(0.0), top, F.length(e).cast("double"), top + 8.0).alias("bbox"),
            F.when(
                kind == "SectionHeader", F.create_map(F.lit("2"), F.lit("/page/0/SectionHeader/0"))
            ).alias("section_hierarchy"),
        )

    pages = spread(table(spark, sf, "pages"), "page_id")
    # The pieces are computed once; the transform reads the finished array.
    cut = compute_once(pages, ["page_id", "url"], page_elements(F.col("html")), "pieces")
    return cut.select("page_id", "url", F.transform("pieces", block).alias("blocks"))


def strip_sql(c: str) -> str:
    """SQL text of the tag-stripping rule."""
    out = f"regexp_replace({c}, '<[^>]+>', ' ', 'g')"
    for entity, char in [
        ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"),
        ("&nbsp;", " "),
    ]:
        out = f"replace({out}, '{entity}', '{char}')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


def norm_sql(c: str) -> str:
    return f"regexp_replace(lower({c}), '[^a-z0-9]+', '', 'g')"


# The blocks of a page as a DuckDB common table expression: page_id, ord, html, block_type, page.
# A page is rid of hidden parts, split at its tags of block elements, and what has no text goes.
BLOCKS_CTE = rf"""
shown AS (
  SELECT page_id, url,
         regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
           '(?is)<script\b.*?(</script>|\z)', ' ', 'g'), '(?is)<style\b.*?(</style>|\z)', ' ', 'g'),
           '(?s)<!--.*?(-->|\z)', ' ', 'g'), '(?i)<!doctype[^>]*>', ' ', 'g') AS h
  FROM pages),
pieces AS (
  SELECT page_id, url, string_split(
           regexp_replace(regexp_replace(h, '(?i)(<({BLOCK_TAGS})(\s[^>]*)?>)', chr(1) || '\1', 'g'),
             '(?i)(</({BLOCK_TAGS})>)', '\1' || chr(1), 'g'), chr(1)) AS ps
  FROM shown),
each_piece AS (SELECT page_id, url, unnest(ps) AS html, generate_subscripts(ps, 1) AS no FROM pieces),
el AS (
  SELECT page_id, url, html, row_number() OVER (PARTITION BY page_id ORDER BY no) - 1 AS ord
  FROM each_piece WHERE {strip_sql("html")} <> ''),
blk AS (
  SELECT page_id, url, ord, html, ord // {PER_PAGE} AS page,
         CASE WHEN starts_with(html, '<h1') THEN 'SectionHeader'
              WHEN starts_with(html, '<ul') THEN 'ListGroup'
              WHEN starts_with(html, '<footer') THEN 'PageFooter' ELSE 'Text' END AS block_type
  FROM el)
"""


# ---- documents as text lines ----------------------------------------------------------------------

LINES_CTE = """
txt AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
ln AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS line_no FROM txt)
"""


def lines(spark: SparkSession, sf: str) -> DataFrame:
    docs = spread(table(spark, sf, "documents"), "doc_id")
    return docs.select(
        "doc_id", "n_chars", F.posexplode_outer(F.split("text", "\n")).alias("line_no", "line")
    )
