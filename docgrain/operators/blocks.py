"""OCR blocks: explode, clean, scale, turn into document items and text.

The blocks of a document arrive as one array in one payload row. Work on a single document
therefore stays inside its row; shuffles appear only where rows of different documents meet.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import html_table as H
from ..functions import text as X
from ..functions.barrier import compute_once, unroll
from ..functions.values import kind
from ..schemas import LETTER_PAGE
from .containment import candidates, choices, lookup

def explode_blocks(runs: DataFrame, blocks: str, keys: list[str]) -> DataFrame:
    """One row per block with its position ``ord``; documents without blocks give none."""
    rows = unroll(runs, F.col(blocks), keys, "ord", "b")
    return rows.select(
        *keys,
        "ord",
        F.col("b.id").alias("block_id"),
        F.coalesce(X.blank_to_null(F.col("b.block_type")), F.lit("Text")).alias("block_type"),
        "b.html",
        "b.markdown",
        "b.page",
        "b.polygon",
        "b.bbox",
        "b.section_hierarchy",
    )


def html_table_cells(df: DataFrame, html: str, keys: list[str]) -> DataFrame:
    """One row per table cell with the size of its table; empty tables give none."""
    cells = H.cell_rows(df, html, keys)
    header, row = F.col("is_header"), F.col("row_no")
    return cells.select(
        *keys,
        "cell_ord",
        "row_no",
        "col_no",
        "row_span",
        "col_span",
        "text",
        H.column_header(header, row).alias("column_header"),
        H.row_header(header, row).alias("row_header"),
        "num_rows",
        "num_cols",
    )


def list_items(df: DataFrame, html: str, keys: list[str]) -> DataFrame:
    """One row per ``<li>`` with its position and stripped text."""
    return unroll(df, X.list_items(F.col(html)), keys, "item_ord", "text")


# ---- pages -------------------------------------------------------------------------------------


def page_count(given: Column, metadata: Column, blocks: Column) -> Column:
    """Given count, else that of the metadata, else the last block page; at least 1."""
    pages = F.transform(blocks, lambda b: F.coalesce(b.getField("page"), F.lit(0)) + 1)
    return F.greatest(F.coalesce(given, metadata, F.array_max(pages), F.lit(1)), F.lit(1))


def _positive(entry: Column, *names: str) -> Column:
    """First of the named numbers that is neither absent nor zero."""
    values = [F.try_variant_get(entry, f"$.{n}", "double") for n in names]
    return F.coalesce(*[F.when(v != 0, v) for v in values])


def _sized(page: Column, entry: Column) -> Column:
    return F.struct(
        (page + 1).cast("int").alias("page_no"),
        _positive(entry, "width", "page_width").alias("width"),
        _positive(entry, "height", "page_height").alias("height"),
    )


def page_sizes(df: DataFrame, page_info: str, pages: str, keys: list[str]) -> DataFrame:
    """One row per page with its size; pages without a known size get the letter format.

    ``page_info`` is a VARIANT, either an object keyed by 0-based page or a list of entries.
    """
    info = F.col(page_info)
    by_key = F.map_entries(
        F.when(kind(info) == "object", F.try_variant_get(info, "$", "map<string,variant>"))
    )
    listed = F.when(kind(info) == "array", F.try_variant_get(info, "$", "array<variant>"))
    from_map = F.transform(by_key, lambda e: _sized(e["key"].try_cast("int"), e["value"]))
    from_list = F.transform(
        listed,
        lambda e: _sized(
            F.coalesce(
                F.try_variant_get(e, "$.page", "int"), F.try_variant_get(e, "$.index", "int")
            ),
            e,
        ),
    )
    listed_sizes = F.filter(
        F.coalesce(from_map, from_list, F.array().cast(_SIZES)),
        lambda p: p["page_no"].isNotNull() & p["width"].isNotNull() & p["height"].isNotNull(),
    )
    # A list may name a page twice; the later entry counts, which is the last of its run here.
    in_order = F.array_sort(
        F.transform(
            listed_sizes,
            lambda p, i: F.struct(p["page_no"].alias("page_no"), i.alias("at"), p["width"].alias("width"), p["height"].alias("height")),
        )
    )
    known = compute_once(df, [*keys, F.col(pages).alias("__n")], in_order, "__known")
    default_w, default_h = LETTER_PAGE
    missing = F.transform(
        F.array_except(
            F.sequence(F.lit(1), F.col("__n").cast("int")),
            F.transform("__known", lambda p: p["page_no"]),
        ),
        lambda n: F.struct(
            n.alias("page_no"),
            F.lit(default_w).alias("width"),
            F.lit(default_h).alias("height"),
        ),
    )
    last = F.filter(
        "__known",
        lambda p, i: ~p["page_no"].eqNullSafe(F.get(F.col("__known"), i + 1)["page_no"]),
    )
    sizes = F.concat(F.transform(last, lambda p: p.dropFields("at")), missing)
    return known.select(*keys, F.inline(sizes))


_SIZES = "array<struct<page_no:int,width:double,height:double>>"


def page_dims(page_info: Column, page_no: Column) -> Column:
    """Source size of a 1-based page from the extent of its ``bbox``, else null."""
    boxes = F.try_variant_get(page_info, "$", "map<string,struct<bbox:array<double>>>")
    bbox = F.try_element_at(boxes, (page_no - 1).cast("string")).getField("bbox")
    size = F.struct(
        (F.get(bbox, F.lit(2)) - F.get(bbox, F.lit(0))).alias("width"),
        (F.get(bbox, F.lit(3)) - F.get(bbox, F.lit(1))).alias("height"),
    )
    complete = (F.size(bbox) == 4) & ~F.exists(bbox, lambda v: v.isNull())
    return F.when(complete, size)


def scale_blocks(blocks: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """Blocks in the pixel space of their rendered page.

    ``blocks``: keys, block_id, block_type, html, markdown, page (0-based), polygon, bbox.
    ``pages``: keys, page_no, width_px, height_px, source_w, source_h — one row per page.
    Blocks without id or geometry and blocks of pages that were not rendered are left out.
    """
    placed = blocks.select(
        *keys,
        X.page_or_none(F.col("page")).alias("page_no"),
        "block_id",
        "block_type",
        X.display_text(F.col("html"), F.col("markdown")).alias("text"),
        G.block_quad(F.col("polygon"), F.col("bbox")).alias("quad"),
    ).filter("quad IS NOT NULL AND block_id IS NOT NULL AND block_id <> ''")
    joined = placed.join(pages, [*keys, "page_no"])
    scaled = joined.withColumn(
        "quad",
        G.scale_quad(
            F.col("quad"),
            G.scale_factor(F.col("width_px"), F.col("source_w")),
            G.scale_factor(F.col("height_px"), F.col("source_h")),
        ),
    )
    return scaled.select(
        *keys, "page_no", "block_id", "block_type", "text", "quad",
        G.quad_box(F.col("quad")).alias("bbox"),
    )


# ---- document items -----------------------------------------------------------------------------


def _provenance(text: Column) -> Column:
    b = G.block_box(F.col("bbox"), F.col("polygon"))
    return F.when(
        b.isNotNull(),
        F.struct(
            X.page_or_first(F.col("page")).alias("page_no"),
            b.alias("bbox"),
            F.length(text).alias("chars"),
        ),
    )


def document_items(blocks: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Exploded blocks to ordered document items, and the blocks that cannot become one: those
    with a heading level below 1, a box or a polygon that holds no number where one belongs.

    Items: keys, ord, item_ord, kind (heading, table, picture, list, list_item, text), label,
    level, text, page_no, bbox, chars. A list gives one row for itself and one per entry.
    """
    text = X.item_text(F.coalesce(F.col("html"), F.lit("")), F.col("markdown"))
    level = X.section_level(F.col("section_hierarchy"))
    typed = blocks.withColumn("text", text).withColumn(
        "level", F.when(F.col("block_type") == "SectionHeader", level)
    )
    reason = (
        F.when(~G.box_readable(F.col("bbox")), "unreadable box")
        .when(~G.polygon_readable(F.col("polygon"), F.col("bbox")), "unreadable polygon")
        .when(F.coalesce(F.col("level") < 1, F.lit(False)), "heading level below 1")
    )
    typed = typed.withColumn("reason", reason)
    bad = F.col("reason").isNotNull()
    rejects = typed.filter(bad).select(*keys, "ord", "block_id", "block_type", "reason")
    # List entries inherit page and box of their list; without a box they sit at page 1.
    prov = _provenance(F.col("text"))
    zero = G.box(*[F.lit(0.0)] * 4)

    def item(kind_: Column, label: Column, text_: Column, place: Column) -> Column:
        return F.struct(
            kind_.alias("kind"),
            label.alias("label"),
            text_.alias("text"),
            place.getField("page_no").alias("page_no"),
            place.getField("bbox").alias("bbox"),
            place.getField("chars").alias("chars"),
        )

    kind_ = (
        F.when(F.col("block_type") == "SectionHeader", "heading")
        .when(F.col("block_type") == "Table", "table")
        .when(F.col("block_type") == "Picture", "picture")
        .when(F.col("block_type") == "ListGroup", "list")
        .otherwise("text")
    )
    label = F.when(kind_ == "list", "list").otherwise(X.block_label(F.col("block_type")))
    silent = kind_.isin("table", "picture", "list")
    nowhere = F.struct(
        F.lit(None).cast("int").alias("page_no"),
        F.lit(None).cast(_BOX).alias("bbox"),
        F.lit(None).cast("int").alias("chars"),
    )
    own_place = F.when(kind_ == "list", nowhere).otherwise(prov)
    head = item(kind_, label, F.when(~silent, F.col("text")), own_place)

    def entry(t: Column) -> Column:
        place = F.struct(
            F.coalesce(prov.getField("page_no"), F.lit(1)).alias("page_no"),
            F.coalesce(prov.getField("bbox"), zero).alias("bbox"),
            F.length(t).alias("chars"),
        )
        return item(F.lit("list_item"), F.lit("list_item"), t, place)

    entries = F.when(
        F.col("block_type") == "ListGroup", F.transform(X.list_items(F.col("html")), entry)
    )
    all_items = F.concat(F.array(head), F.coalesce(entries, F.array()))
    items = unroll(typed.filter(~bad), all_items, [*keys, "ord", "level"], "item_ord", "i")
    return (
        items.select(
            *keys, "ord", "item_ord", "i.kind", "i.label", "level",
            "i.text", "i.page_no", "i.bbox", "i.chars",
        ),
        rejects,
    )


_BOX = "struct<l:double,t:double,r:double,b:double>"




def document_text(df: DataFrame, blocks: str, keys: list[str], tables: bool = True) -> DataFrame:
    """One Markdown-like text per document: ``#`` headings, ``- `` entries, pipe tables.

    ``blocks`` is the payload's block array. The text is put together inside the row, so there
    is no shuffle and no grouping; only the HTML of table blocks goes through Python. Leave
    ``tables`` out where the corpus has none, and nothing goes through Python at all.
    """
    numbered = df.select(*keys, F.col(blocks).alias("__b"))
    if tables:
        # Tables are read one row each and meet the text of their own document again by key.
        numbered = numbered.withColumn(
            "__t",
            _table_texts(F.transform("__b", lambda b: F.when(_type(b) == "Table", b["html"]))),
        )
    else:
        numbered = numbered.withColumn("__t", F.lit(None).cast("array<string>"))

    def part(b: Column, i: Column) -> Column:
        body = X.item_text(F.coalesce(b["html"], F.lit("")), b["markdown"])
        depth = X.section_level(b["section_hierarchy"])
        entries = F.array_join(
            F.transform(X.list_items(b["html"]), lambda t: F.concat(F.lit("- "), t)), "\n"
        )
        return (
            F.when(
                _type(b) == "SectionHeader",
                F.concat(F.repeat(F.lit("#"), depth), F.lit(" "), body),
            )
            .when(_type(b) == "ListGroup", entries)
            .when(_type(b) == "Picture", F.lit(""))
            .when(_type(b) == "Table", F.coalesce(F.get(F.col("__t"), i), F.lit("")))
            .when(_type(b) == "ListItem", F.concat(F.lit("- "), body))
            .otherwise(body)
        )

    parts = F.filter(F.transform("__b", part), lambda p: p != "")
    return numbered.select(*keys, F.array_join(parts, "\n\n").alias("text"))


def _type(b: Column) -> Column:
    return F.coalesce(X.blank_to_null(b["block_type"]), F.lit("Text"))


def _table_texts(htmls: Column) -> Column:
    """Array of table HTML (null where there is no table) to an array of pipe tables."""
    def lines(html: str | None) -> str | None:
        if html is None:
            return None
        rows: dict[int, list[str]] = {}
        for row, _, _, _, text, _ in H.read_cells(html):
            rows.setdefault(row, []).append(text.replace("\n", " "))
        return "\n".join(f"| {' | '.join(rows[r])} |" for r in sorted(rows))

    @F.arrow_udf("array<string>")
    def render(batch: pa.Array) -> pa.Array:
        texts = [None if hs is None else [lines(h) for h in hs] for hs in batch.to_pylist()]
        return pa.array(texts, pa.list_(pa.string()))

    return render(htmls)


def compact_fragments(fragments: DataFrame, keys: list[str]) -> DataFrame:
    """What the refinement model needs of a fragment: id, text and box."""
    ref = F.coalesce(
        X.blank_to_null(F.col("self_ref")), F.concat(F.lit("f"), F.col("frag_ord").cast("string"))
    )
    return fragments.select(
        *keys, "frag_ord", ref.alias("id"), F.coalesce("text", F.lit("")).alias("text"), "bbox"
    )


def compact_scaffold(
    scaffolds: DataFrame, fragments: DataFrame, keys: list[str], pages: str = "pages"
) -> DataFrame:
    """The whole view of the refinement model per scaffold: its pages as they are, and its texts.

    ``texts`` is array<struct<id,text,bbox>> in the order of the fragments; a scaffold without
    fragments has none. Fragments are gathered per scaffold, which is one model input.
    """
    entry = F.struct("frag_ord", "id", "text", "bbox")
    texts = compact_fragments(fragments, keys).groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(entry)), lambda f: f.dropFields("frag_ord")).alias("texts")
    )
    empty = F.array().cast(f"array<struct<id:string,text:string,bbox:{_BOX}>>")
    return scaffolds.select(*keys, pages).join(texts, keys, "left").withColumn(
        "texts", F.coalesce("texts", empty)
    )


# ---- block statistics ----------------------------------------------------------------------------


def block_type_stats(blocks: DataFrame, doc_key: str, preview: int | None = None) -> DataFrame:
    """Blocks per type, most common first, with the first block of each type as an example.

    ``example_keys`` names the fields the example has, in order; ``preview`` cuts its HTML to so many characters.
    """
    html = F.coalesce("html", F.lit(""))
    fields = ["bbox", "block_type", "html", "id", "markdown", "page", "polygon", "section_hierarchy"]
    present = [F.when(F.col("block_id" if f == "id" else f).isNotNull(), F.lit(f)) for f in fields]
    example = F.struct(
        F.col(doc_key).alias("example_doc"),
        F.col("ord").alias("example_ord"),
        F.col("polygon").isNotNull().alias("has_polygon"),
        F.col("bbox").isNotNull().alias("has_bbox"),
        (html if preview is None else F.substring(html, 1, preview)).alias("html"),
        F.array_compact(F.array(*present)).alias("example_keys"),
    )
    stats = blocks.groupBy("block_type").agg(
        F.count("*").alias("n_blocks"),
        F.min_by(example, F.struct(doc_key, "ord")).alias("e"),
    )
    return stats.select("block_type", "n_blocks", "e.*").orderBy(
        F.desc("n_blocks"), "block_type"
    )


def doc_item_counts(items: DataFrame, keys: list[str]) -> DataFrame:
    """Texts, tables, pictures, pages and blocks per document, pre-combined before the shuffle."""
    k = F.col("kind")
    return items.groupBy(*keys).agg(
        F.count_if(k.isin("heading", "text", "list_item")).alias("texts"),
        F.count_if(k == "table").alias("tables"),
        F.count_if(k == "picture").alias("pictures"),
        F.max("page_no").alias("last_page"),
        F.count_if(F.col("item_ord") == 0).alias("blocks"),
    )


def line_term_hits(lines: DataFrame, terms: list[str], keys: list[str]) -> DataFrame:
    """Lines that contain a term, case-insensitively: one row per (line, term).

    ``lines``: keys, line_no, text, confidence. The term list is small and literal, so the
    search is an expression over each line and not a join.
    """
    lowered = F.lower(F.coalesce("text", F.lit("")))
    wanted = F.array(*[F.lit(t) for t in terms])
    found = F.filter(wanted, lambda t: F.contains(lowered, F.lower(t)))
    rounded = F.round(F.coalesce("confidence", F.lit(0.0)), 3).alias("confidence")
    hits = unroll(lines, found, [*keys, "line_no", rounded, "text"], "__p", "term")
    return hits.select(*keys, "line_no", "term", "confidence", "text")


def line_term_table_hits(lines: DataFrame, terms: DataFrame, keys: list[str]) -> DataFrame:
    """Lines that contain a term of a table, case-insensitively: one row per (line, term).

    ``lines``: keys, line_no, text, confidence; ``terms``: term. For lists too long to be an expression. Each term is looked up by
    its rarest gram among all lines, and the lines that have it are tested. Terms that differ in case are terms of
    their own; a term that is given twice counts once, null terms are left out, the empty term is in every line.
    """
    rounded = F.round(F.coalesce("confidence", F.lit(0.0)), 3).alias("confidence")
    held = _terms_of_lines(lines, terms, [*keys, "line_no", rounded, "text"])
    return held.select(*keys, "line_no", "term", "confidence", "text")


def _terms_of_lines(lines: DataFrame, terms: DataFrame, keep: list) -> DataFrame:
    """(keep..., term): one row per line and term in it.

    Terms of some megabytes go to every task, and a line is searched where it stands. For more, a line meets its terms as
    one row, so no row is shuffled per hit.
    """
    each = terms.filter("term IS NOT NULL").groupBy(F.lower("term").alias("low")).agg(F.collect_set("term").alias("spelled"))
    low = F.lower(F.coalesce("text", F.lit("")))
    texts = lines.select(low.alias("__low"))
    choice, sizes = choices(each, texts, "low", "spelled", "__low")
    held = [*keep, low.alias("__low")]
    near = lookup(choice, sizes, "spelled")
    if near is not None:
        tried = lines.select(*held).withColumn("__found", near(F.col("__low")))
        inside = F.filter("__found", lambda t: F.contains(F.col("__low"), F.lower(t)))
    else:
        # Lines of one text share an id, and ids are unique in what is found, so a line that repeats very often is split.
        found = candidates(choice, sizes, texts.withColumn("__id", F.xxhash64("__low")), "spelled", "__id", "__low")
        tried = lines.select(*held).withColumn("__id", F.xxhash64("__low")).join(found, "__id")
        inside = F.flatten(F.filter("needles", lambda t: F.contains(F.col("__low"), F.lower(t[0]))))
    kept = tried.drop("__low", "__id", "needles", "__found").columns
    return unroll(tried, inside, kept, "__p", "term").drop("__p")


def first_of_table_terms(lines: DataFrame, terms: DataFrame, keys: list[str]) -> DataFrame:
    """First line of each document per term of a table.

    The first lines are found by number and by a hash of their text; the texts meet them afterwards, each line once with
    all its terms, so a long line is not shuffled once per term. Of lines that share a number one is taken.
    """
    place = [*keys, "line_no", "__text"]
    named = lines.withColumn("__text", F.xxhash64("text"))
    hits = _terms_of_lines(named, terms, place)
    first = hits.groupBy(*keys, "term").agg(F.min(F.struct("line_no", "__text")).alias("__at"))
    wanted = first.select(*keys, "__at.*", "term").groupBy(*place).agg(F.collect_list("term").alias("__terms"))
    both = named.select(*place, "text").unionByName(wanted, allowMissingColumns=True)
    met = both.groupBy(*place).agg(F.first("text", True).alias("text"), F.first("__terms", True).alias("__terms"))
    return met.select(*keys, "line_no", "text", F.explode("__terms").alias("term")).select(*keys, "term", "line_no", "text")


def first_term_lines(lines: DataFrame, terms: list[str], keys: list[str]) -> DataFrame:
    """First line of each document per term."""
    return _first_lines(line_term_hits(lines, terms, keys), keys)


def _first_lines(hits: DataFrame, keys: list[str]) -> DataFrame:
    return hits.groupBy(*keys, "term").agg(
        F.min("line_no").alias("line_no"), F.min_by("text", "line_no").alias("text")
    )
