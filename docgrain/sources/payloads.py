"""Model and OCR payloads: JSON text to typed columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.values import is_object_text, kind
from ..schemas import OCR_DDL, RECORDS


def parse_ocr_payload(df: DataFrame, col: str, name: str = "ocr") -> DataFrame:
    """Add ``name`` = struct(blocks, page_info, metadata); null unless the text is an object."""
    return df.withColumn(
        name, F.when(is_object_text(F.col(col)), F.from_json(F.col(col), OCR_DDL))
    )


def _shape_table(schema: T.StructType) -> tuple[Column, Column]:
    """Literal maps: field -> 'text', 'texts' or 'rows', and list of rows -> its cell names."""
    shapes, cells = [], [F.lit(""), F.array().cast("array<string>")]
    for f in schema.fields:
        shape = "text"
        if isinstance(f.dataType, T.ArrayType):
            element = f.dataType.elementType
            shape = "rows" if isinstance(element, T.StructType) else "texts"
            if shape == "rows":
                cells += [F.lit(f.name), F.array(*[F.lit(n) for n in element.fieldNames()])]
        shapes += [F.lit(f.name), F.lit(shape)]
    return F.create_map(*shapes), F.create_map(*cells)


def record_errors(json_col: Column, schema: T.StructType) -> Column:
    """Sorted array of the rules a JSON record breaks: unknown keys and wrong types.

    Text is a string or null. A list may be absent but not null; it holds strings, or rows of
    known cells that are strings or null. The record is parsed once and its entries are checked
    one by one.
    """
    shapes, cells = _shape_table(schema)
    none = F.array().cast("array<string>")

    def is_text(v: Column) -> Column:
        return kind(v) == "string"

    def is_cell(v: Column) -> Column:
        return kind(v).isin("string", "null")

    def check(e: Column) -> Column:
        key, v = e["key"], e["value"]
        shape = F.try_element_at(shapes, key)
        wrong = F.array(F.concat(F.lit("type:"), key))
        members = F.try_variant_get(v, "$", "array<variant>")
        rows = F.try_variant_get(v, "$", "array<map<string,variant>>")
        no_row = F.exists(rows, lambda r: r.isNull())
        names = F.array_distinct(F.flatten(F.transform(rows, lambda r: F.map_keys(r))))
        strange = F.transform(
            F.array_except(names, F.try_element_at(cells, key)),
            lambda n: F.concat(F.lit("unknown:"), key, F.lit("."), n),
        )
        bad_cell = F.exists(rows, lambda r: F.exists(F.map_values(r), lambda c: ~is_cell(c)))
        row_errors = F.concat(
            strange, F.when(bad_cell, F.array(F.concat(F.lit("type:"), key, F.lit(".*")))).otherwise(none)
        )
        return (
            F.when(shape.isNull(), F.array(F.concat(F.lit("unknown:"), key)))
            .when(shape == "text", F.when(is_cell(v), none).otherwise(wrong))
            .when(
                shape == "texts",
                F.when(F.forall(members, is_text), none).otherwise(wrong),
            )
            .otherwise(F.when(rows.isNull() | no_row, wrong).otherwise(row_errors))
        )

    entries = F.map_entries(F.from_json(json_col, "map<string,variant>"))
    errors = F.array_sort(F.flatten(F.transform(entries, check)))
    return F.coalesce(errors, F.array(F.lit("not an object")))


def typed_record(json_col: Column, schema: T.StructType) -> Column:
    """The record as a struct; missing text is null, missing lists are empty."""
    raw = F.from_json(json_col, schema)
    filled = [
        (
            F.coalesce(raw.getField(f.name), F.array().cast(f.dataType))
            if isinstance(f.dataType, T.ArrayType)
            else raw.getField(f.name)
        ).alias(f.name)
        for f in schema.fields
    ]
    return F.when(raw.isNotNull(), F.struct(*filled))


def parse_extracted(df: DataFrame, col: str, doc_type: str) -> DataFrame:
    """Add ``errors`` and ``record`` (null when there are errors) for one document type."""
    schema = RECORDS[doc_type]
    out = df.withColumn("errors", record_errors(F.col(col), schema))
    return out.withColumn(
        "record", F.when(F.size("errors") == 0, typed_record(F.col(col), schema))
    )


def strict_errors(df: DataFrame, col: str, type_col: str) -> DataFrame:
    """Add ``errors`` for rows of mixed document types."""
    errors = F.array(F.lit("unknown doc_type"))
    for doc_type, schema in RECORDS.items():
        errors = F.when(F.col(type_col) == doc_type, record_errors(F.col(col), schema)).otherwise(
            errors
        )
    return df.withColumn("errors", errors)
