"""Extracted fields: flatten, split for editing, search."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.barrier import compute_once, holds
from ..functions.values import contains_pattern, is_container, kind, scalar_text


def _step(rows: DataFrame) -> DataFrame:
    """Open every container row one level; leaves (and empty containers) pass through."""
    tvf = rows.sparkSession.tvf
    opened = rows.lateralJoin(tvf.variant_explode_outer(F.col("v").outer()))
    place = (
        F.when(F.col("pos").isNull(), F.col("path"))
        .when(F.col("key").isNull(), F.concat("path", F.lit("["), F.col("pos").cast("string"), F.lit("]")))
        .when(F.col("path") == "", F.col("key"))
        .otherwise(F.concat("path", F.lit("."), F.col("key")))
    )
    keys = [c for c in rows.columns if c not in ("path", "v", "ord")]
    spot = F.when(F.col("pos").isNull(), F.col("ord")).otherwise(F.array_append("ord", F.col("pos")))
    return opened.select(
        *keys, spot.alias("ord"), place.alias("path"), F.coalesce("value", "v").alias("v")
    )


def nesting_depth(v: Column) -> Column:
    """Levels of containers of a VARIANT: 0 for a plain value."""
    bare = F.regexp_replace(F.to_json(v), r'"(?:[^"\\]|\\.)*"', "")
    brackets = F.regexp_replace(bare, r"[^\[\]{}]", "")
    level = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def walk(acc: Column, c: Column) -> Column:
        now = acc["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(acc["most"], now).alias("most"))

    return F.aggregate(F.split(brackets, ""), level, walk, lambda acc: acc["most"])


def flatten_scalars(df: DataFrame, col: str, keys: list[str], depth: int | None = None) -> DataFrame:
    """Leaves of a VARIANT column as (keys, ord, path, value).

    Paths use ``a.b`` for objects and ``items[0].q`` for lists. Null leaves and empty containers
    give no row. ``ord`` is the position of the leaf on every level; objects are read in key
    order. The plan is one chain of explodes in the scan's own stage, one per level, without shuffle. How many
    levels the data has is measured first, unless ``depth`` tells it (a typed record: 3); data
    that nests deeper than a given ``depth`` stops the job instead of losing leaves.
    """
    measured = depth is None
    if depth is None:
        depth = df.agg(F.max(nesting_depth(F.col(col)))).first()[0] or 0
    rows = df.select(
        *keys,
        F.array().cast("array<int>").alias("ord"),
        F.lit("").alias("path"),
        F.col(col).alias("v"),
    )
    for _ in range(depth):
        rows = _step(rows)
    value = scalar_text(F.col("v"))
    if not measured:
        text = F.try_variant_get("v", "$", "string")
        deeper = F.substring(text, 1, 1).isin("{", "[") & (F.length(text) > 2) & is_container(F.col("v"))
        message = F.concat(F.lit("nested deeper than the given depth: "), "path")
        value = F.when(deeper, F.raise_error(message)).otherwise(value)
    return compute_once(rows, [*keys, "ord", "path"], value, "value")


def flatten_field_keys(df: DataFrame, col: str, keys: list[str], depth: int | None = None) -> DataFrame:
    """Paths of the filled leaves."""
    return flatten_scalars(df, col, keys, depth).drop("value")


def split_extraction(df: DataFrame, col: str, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows for the field editor: scalars (path, value, leaf_type) and table cells.

    Scalars: plain values; an empty list is null; a list of one is unwrapped; longer lists of
    values are joined with commas; nested objects give their own plain values one level down.
    Tables: lists of objects as (path, row_no, column, value), every column of the table in
    every row, containers inside a cell as null.
    """
    tvf = df.sparkSession.tvf
    top = (
        df.select(*keys, F.col(col).alias("v"))
        .lateralJoin(tvf.variant_explode(F.col("v").outer()))
        .filter("key IS NOT NULL")
        .select(*keys, F.col("key").alias("path"), F.col("value").alias("v"))
        .withColumn("shape", kind(F.col("v")))
    )
    members = F.when(F.col("shape") == "array", F.try_variant_get("v", "$", "array<variant>"))
    top = top.withColumn("members", members)
    is_table = (F.size("members") > 0) & F.forall("members", lambda m: kind(m) == "object")
    top = top.withColumn("is_table", F.coalesce(is_table, F.lit(False)))

    def shown(m: Column) -> Column:
        text = F.try_variant_get(m, "$", "string")
        shape = kind(m)
        return (
            F.when(shape == "null", F.lit(""))
            .when(shape == "object", F.lit("[object Object]"))
            .otherwise(F.coalesce(text, F.lit("")))
        )

    def scalar(path: Column, value: Column, leaf_type: Column) -> Column:
        return F.struct(path.alias("path"), value.alias("value"), leaf_type.alias("leaf_type"))

    def plain(path: Column, v: Column) -> Column:
        shape = kind(v)
        simple = shape.isin("string", "number", "boolean")
        value = F.when(simple, F.try_variant_get(v, "$", "string"))
        return scalar(path, value, F.when(simple, shape).otherwise(F.lit("null")))

    first = F.get("members", F.lit(0))
    joined = F.array_join(F.transform("members", shown), ", ")
    inner = F.map_entries(
        F.when(F.col("shape") == "object", F.try_variant_get("v", "$", "map<string,variant>"))
    )
    nested = F.transform(
        F.filter(inner, lambda e: ~kind(e["value"]).isin("object", "array")),
        lambda e: plain(F.concat("path", F.lit("."), e["key"]), e["value"]),
    )
    path = F.col("path")
    null = F.lit(None).cast("string")
    rows = (
        F.when(F.col("shape") == "object", nested)
        .when(F.col("shape") != "array", F.array(plain(path, F.col("v"))))
        .when(F.size("members") == 0, F.array(scalar(path, null, F.lit("null"))))
        .when(F.size("members") == 1, F.array(plain(path, first)))
        .otherwise(F.array(scalar(path, joined, F.lit("string"))))
    )
    scalars = top.filter("NOT is_table").select(*keys, F.inline(rows))

    columns = F.array_distinct(
        F.flatten(
            F.transform(
                "members",
                lambda m: F.map_keys(F.try_variant_get(m, "$", "map<string,variant>")),
            )
        )
    )
    grid = (
        top.filter("is_table")
        .select(*keys, "path", columns.alias("columns"), F.posexplode("members").alias("row_no", "m"))
        .select(
            *keys,
            "path",
            "row_no",
            F.explode("columns").alias("column"),
            F.try_variant_get("m", "$", "map<string,variant>").alias("cells"),
        )
    )
    cell = F.try_element_at("cells", F.col("column"))
    value = F.when(
        kind(cell).isin("string", "number", "boolean"), F.try_variant_get(cell, "$", "string")
    )
    return scalars, grid.select(*keys, "path", "row_no", "column", value.alias("value"))


def payload_contains(df: DataFrame, col: str, pattern: Any) -> DataFrame:
    """Rows whose VARIANT contains the pattern (objects by key, lists by element)."""
    return df.filter(holds(F.col(col), lambda v: contains_pattern(v, pattern)))


def page_split(
    scalars: DataFrame, field_pages: DataFrame, page_no: int, keys: list[str]
) -> DataFrame:
    """Editor rows as 'page' (on the shown page), 'document' (no page) or 'hidden'.

    A row finds its page under its own path or, for an unwrapped list of one, under ``path[0]``.
    """
    # Each page is filed under its path and, less firmly, under the path without a final [0].
    bare = F.when(F.col("path").endswith("[0]"), F.expr("left(path, length(path) - 3)"))
    filed = F.array_compact(
        F.array(
            F.struct(F.col("path").alias("p"), F.lit(1).alias("firm")),
            F.when(bare.isNotNull(), F.struct(bare.alias("p"), F.lit(0).alias("firm"))),
        )
    )
    pages = (
        field_pages.select(*keys, "page_no", F.explode(filed).alias("at"))
        .groupBy(*keys, F.col("at.p").alias("path"))
        .agg(F.max_by("page_no", "at.firm").alias("__page"))
    )
    found = F.col("__page")
    return (
        scalars.join(pages, [*keys, "path"], "left")
        .withColumn(
            "placement",
            F.when(found.isNull(), "document").when(found == page_no, "page").otherwise("hidden"),
        )
        .drop("__page")
    )
