"""Text expressions over block HTML and field values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import BLOCK_LABELS, ENTITIES

# Unicode white space plus the four separators Java leaves out of its own class.
SPACE_RUN = r"(?U)[\s\x1c-\x1f]+"
TAG = "<[^>]+>"


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def squeeze(c: Column) -> Column:
    """Collapse runs of white space to one blank and trim both ends."""
    return F.trim(F.regexp_replace(c, SPACE_RUN, " "))


def strip_html(c: Column) -> Column:
    """Tags become blanks, the common entities are decoded, white space is collapsed."""
    text = F.regexp_replace(c, TAG, " ")
    for entity, char in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.coalesce(squeeze(text), F.lit(""))


def anchor_text(html: Column, markdown: Column | None = None) -> Column:
    """Text a field value is searched in: tags out, entities left as they are."""
    raw = blank_to_null(html)
    if markdown is not None:
        raw = F.coalesce(raw, markdown)
    return F.coalesce(F.regexp_replace(raw, TAG, " "), F.lit(""))


def display_text(html: Column, markdown: Column) -> Column:
    """Overlay label: the HTML text, else the Markdown as it is."""
    return F.coalesce(blank_to_null(strip_html(html)), markdown, F.lit(""))


def item_text(html: Column, markdown: Column) -> Column:
    """Document item text: trimmed Markdown first, else the HTML text."""
    trimmed = F.regexp_replace(markdown, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    return F.coalesce(blank_to_null(trimmed), strip_html(html))


def norm_key(c: Column) -> Column:
    """Lower case, ASCII letters and digits only: the key both sides of a match use."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")


def match_key(c: Column) -> Column:
    """Comparison key of the evaluators: trimmed, lower case, single blanks."""
    return squeeze(F.lower(c))


def block_label(block_type: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in BLOCK_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, block_type), F.lit("text"))


def page_or_none(page: Column) -> Column:
    """1-based page; a block without page lands on page 0, which no page has."""
    return F.coalesce(page, F.lit(-1)) + 1


def page_or_first(page: Column) -> Column:
    """1-based page; a block without page counts as page 1."""
    return F.coalesce(page, F.lit(0)) + 1


def block_id_page(block_id: Column) -> Column:
    """1-based page named in a block id ``/page/<n>/...``, else null."""
    digits = F.regexp_extract(block_id, r"^/page/(\d+)/", 1)
    return blank_to_null(digits).try_cast("int") + 1


def section_level(hierarchy: Column) -> Column:
    """Deepest numeric key of a heading hierarchy, at most 6; anything odd is level 1."""
    levels = F.transform(F.map_keys(hierarchy), lambda k: k.try_cast("int"))
    odd = hierarchy.isNull() | (F.size(levels) <= 0) | F.exists(levels, lambda n: n.isNull())
    return F.when(odd, F.lit(1)).otherwise(F.least(F.array_max(levels), F.lit(6)))


def list_items(html: Column) -> Column:
    """Array of the stripped ``<li>`` texts."""
    found = F.regexp_extract_all(html, F.lit("(?is)<li[^>]*>(.*?)</li>"), F.lit(1))
    return F.transform(F.coalesce(found, F.array().cast("array<string>")), strip_html)


def media_type(declared: Column) -> Column:
    from ..schemas import DEFAULT_MIME

    return F.coalesce(blank_to_null(declared), F.lit(DEFAULT_MIME))
