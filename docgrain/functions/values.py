"""JSON values: lookup by path, edits typed back, comparison rules."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import match_key

# What a browser reads as a finite decimal number, after trimming.
JS_DECIMAL = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def as_variant(c: Column) -> Column:
    """JSON text to VARIANT; malformed text gives null."""
    return F.try_parse_json(c)


# First word of a VARIANT schema -> kind of value.
_KINDS = {
    "OBJECT": "object",
    "ARRAY": "array",
    "STRING": "string",
    "BOOLEAN": "boolean",
    "BIGINT": "number",
    "DECIMAL": "number",
    "DOUBLE": "number",
}


def kind(v: Column) -> Column:
    """'object', 'array', 'string', 'boolean', 'number' or 'null' of a VARIANT value."""
    table = F.create_map(*[F.lit(x) for pair in _KINDS.items() for x in pair])
    word = F.regexp_extract(F.schema_of_variant(v), "^[A-Z]+", 0)
    return F.coalesce(F.try_element_at(table, word), F.lit("null"))


def is_container(v: Column) -> Column:
    """Object or list. Looks at the top level only, where the schema would walk the whole value."""
    members = F.try_variant_get(v, "$", "array<variant>")
    entries = F.try_variant_get(v, "$", "map<string,variant>")
    return members.isNotNull() | entries.isNotNull()


def is_object_text(c: Column) -> Column:
    """JSON text of an object, told by its first character."""
    return F.coalesce(F.ltrim(c).startswith("{"), F.lit(False))


def scalar_text(v: Column) -> Column:
    """Leaf value as text, booleans capitalised; null for containers and JSON null.

    A number that was written with a fraction keeps one: 18.0 is "18.0", though a VARIANT gives it without.
    The costly look at the type is only taken where the text could be a container, a boolean or such a number.
    """
    text = F.try_variant_get(v, "$", "string")
    # A whole number that fits a long is a BIGINT unless it was written with a fraction.
    whole = text.rlike("^-?[0-9]+$") & text.try_cast("long").isNotNull() & F.schema_of_variant(v).startswith("DECIMAL")
    return (
        F.when(F.substring(text, 1, 1).isin("{", "[") & is_container(v), None)
        .when(text.isin("true", "false") & (kind(v) == "boolean"), F.initcap(text))
        .when(whole, F.concat(text, F.lit(".0")))
        .otherwise(text)
    )


def _json_path(path: Column) -> Column:
    return F.concat(F.lit("$['"), F.replace(path, F.lit("."), F.lit("']['")), F.lit("']"))


def get_at_path(payload: Column, path: Column | str) -> Column:
    """Text at a dotted path, walking through objects only; null where the walk ends early.

    ``path`` may be a literal or a column, so every row can look up its own field.
    """
    steps = F.lit(path) if isinstance(path, str) else path
    return F.call_function("get_json_object", payload, _json_path(steps))


def _holds(pattern: Any) -> Callable[[Column], Column]:
    return lambda v: contains_pattern(v, pattern)


def contains_pattern(v: Column, pattern: Any) -> Column:
    """Containment test of a VARIANT against a small literal pattern.

    Objects must hold every key of the pattern, arrays must hold a match for every element.
    The pattern becomes one boolean expression, so the search is a plain filter.
    """
    if isinstance(pattern, dict):
        checks = [F.coalesce(kind(v) == "object", F.lit(False))]
        checks += [
            contains_pattern(F.try_variant_get(v, f"$['{k}']", "variant"), p)
            for k, p in pattern.items()
        ]
    elif isinstance(pattern, list):
        checks = [F.coalesce(kind(v) == "array", F.lit(False))]
        checks += [
            F.coalesce(
                F.exists(
                    F.try_variant_get(v, "$", "array<variant>"),
                    _holds(p),
                ),
                F.lit(False),
            )
            for p in pattern
        ]
    elif pattern is None:
        checks = [F.coalesce(F.is_variant_null(v), F.lit(False))]
    elif isinstance(pattern, bool):
        checks = [(kind(v) == "boolean") & (F.try_variant_get(v, "$", "boolean") == pattern)]
    elif isinstance(pattern, str):
        checks = [(kind(v) == "string") & (F.try_variant_get(v, "$", "string") == pattern)]
    else:
        checks = [(kind(v) == "number") & (F.try_variant_get(v, "$", "double") == pattern)]
    test = checks[0]
    for more in checks[1:]:
        test = test & more
    return F.coalesce(test, F.lit(False))


# White space and line ends that a browser trims before it reads a number.
JS_SPACE = "[\\t-\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"


def _radix_number(text: Column, prefix: str, digits: str, base: int, exact: int) -> Column:
    """A whole number with a radix prefix as double, correctly rounded; null for other text.

    The first ``exact`` digits fit a long. Digits beyond them only tell on which side of a tie the
    number lies, so the long is made odd if one of them is not zero, and scaled by a power of two.
    """
    number = F.regexp_extract(F.lower(text), f"^{prefix}0*([{digits}]*)$", 1)
    head, tail = F.substring(number, 1, exact), F.substring(number, exact + 1, 1 << 30)
    whole = F.coalesce(F.conv(head, base, 10).try_cast("long"), F.lit(0).cast("long"))
    odd = whole.bitwiseOR(F.when(tail.rlike("[^0]"), F.lit(1)).otherwise(F.lit(0)).cast("long"))
    scaled = odd.cast("double") * F.pow(F.lit(float(base)), F.length(tail))
    return F.when(F.lower(text).rlike(f"^{prefix}[{digits}]+$"), scaled)


def coerce_edited(original_kind: Column, raw: Column) -> Column:
    """Edited text typed like the value it replaces, as JSON text.

    An empty edit clears the field. A number stays a number when the text is a finite number,
    a boolean stays one when the text says true or false; anything else is kept as text.
    """
    trimmed = F.regexp_replace(raw, f"^{JS_SPACE}+|{JS_SPACE}+$", "")
    radix = F.coalesce(
        _radix_number(trimmed, "0x", "0-9a-f", 16, 15),
        _radix_number(trimmed, "0o", "0-7", 8, 20),
        _radix_number(trimmed, "0b", "01", 2, 60),
    )
    decimal = F.when(trimmed.rlike(JS_DECIMAL), trimmed.try_cast("double"))
    number = F.when(trimmed == "", F.lit(0.0)).otherwise(
        F.coalesce(radix, decimal)
    )
    # A browser prints whole numbers without the fraction.
    shown = F.when(
        (F.abs(number) < 1e15) & (number == F.floor(number)), number.cast("long").cast("string")
    ).otherwise(number.cast("string"))
    quoted = F.to_json(F.struct(raw.alias("v")))
    text = F.substring(quoted, F.lit(6), F.length(quoted) - 6)
    flag = F.lower(raw)
    return (
        F.when(raw == "", F.lit("null"))
        .when(
            (original_kind == "number") & number.isNotNull() & (F.abs(number) < float("inf")),
            shown,
        )
        .when((original_kind == "boolean") & flag.isin("true", "false"), flag)
        .otherwise(text)
    )


# ---- typed records ------------------------------------------------------------------------


def _list_leaves(
    name: str, element: T.DataType, base: Column, width: int, leaf: Callable
) -> Callable[[Column, Column], Column]:
    def rows(e: Column, n: Column) -> Column:
        place = F.concat(F.lit(name + "["), n.cast("string"), F.lit("]"))
        if not isinstance(element, T.StructType):
            return F.array(leaf(base + n, place, e.cast("string")))
        return F.array(
            *[
                leaf(
                    base + n * width + j,
                    F.concat(place, F.lit("." + g.name)),
                    e.getField(g.name).cast("string"),
                )
                for j, g in enumerate(element.fields)
            ]
        )

    return rows


def record_leaves(record: Column, schema: T.StructType) -> Column:
    """Array of ``struct<ord,path,value>``: the filled leaves of a typed record.

    The order is the schema's; lists add ``[i]``. Built from the schema, so it is one
    expression without explode, and it leaves null leaves and empty lists out.
    """

    def leaf(ord_: Column, path: Column, value: Column) -> Column:
        return F.struct(ord_.alias("ord"), path.alias("path"), value.alias("value"))

    parts = []
    for i, f in enumerate(schema.fields):
        c, base = record.getField(f.name), F.lit(i * 1_000_000_000).cast("long")
        if not isinstance(f.dataType, T.ArrayType):
            parts.append(F.array(leaf(base, F.lit(f.name), c.cast("string"))))
            continue
        element = f.dataType.elementType
        width = len(element.fields) if isinstance(element, T.StructType) else 1

        parts.append(F.flatten(F.transform(c, _list_leaves(f.name, element, base, width, leaf))))
    leaves = F.concat(*[F.coalesce(p, F.array().cast(_LEAVES)) for p in parts])
    return F.filter(leaves, lambda x: x.getField("value").isNotNull())


_LEAVES = "array<struct<ord:bigint,path:string,value:string>>"


def fixed_leaves(fields: dict[str, Column]) -> Column:
    """The same array for a flat record given as name -> column."""
    leaves = F.array(
        *[
            F.struct(
                F.lit(i).cast("long").alias("ord"),
                F.lit(name).alias("path"),
                c.cast("string").alias("value"),
            )
            for i, (name, c) in enumerate(fields.items())
        ]
    )
    return F.filter(leaves, lambda x: x.getField("value").isNotNull())


# ---- comparison rules ---------------------------------------------------------------------


def normalized_match(a: Column, b: Column) -> Column:
    """Both null, or equal after trimming, lower-casing and collapsing blanks."""
    return match_key(a.cast("string")).eqNullSafe(match_key(b.cast("string")))


def numeric_tolerance(expected: Column, actual: Column, tolerance: float = 0.01) -> Column:
    """Numbers with a unit suffix compared within a tolerance, else plain equality."""

    def number(c: Column) -> Column:
        bare = F.trim(F.regexp_replace(F.trim(c), "[a-zA-Z]+$", ""))
        plain = bare.rlike(r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+)?$")
        return F.when(plain, F.replace(bare, F.lit("_")).try_cast("double"))

    gap = F.abs(number(expected) - number(actual))
    return F.when(gap.isNotNull(), gap <= tolerance).otherwise(expected.eqNullSafe(actual))


def list_match(expected: Column, actual: Column) -> Column:
    """Lists of text: same length and every pair equal by the normalised rule."""
    def keys(values: Column) -> Column:
        return F.transform(values, lambda v: match_key(F.coalesce(v, F.lit("None"))))

    pairs = F.zip_with(keys(expected), keys(actual), lambda a, b: a.eqNullSafe(b))
    return (F.size(expected) == F.size(actual)) & F.forall(pairs, lambda same: same)

