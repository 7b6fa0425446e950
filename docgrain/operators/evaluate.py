"""Extraction and refinement quality."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.barrier import unroll
from ..functions.geometry import iou
from ..functions.values import list_match, normalized_match, numeric_tolerance
from ..schemas import ACCURACY_FLOOR


def _canonical(values: Column, element: T.DataType) -> Column:
    """List elements as text; line items as JSON of all their cells."""
    if isinstance(element, T.StructType):
        return F.transform(values, lambda v: F.to_json(v, {"ignoreNullFields": "false"}))
    return values


def field_accuracy(
    cases: DataFrame,
    expected: str,
    actual: str,
    keys: list[str],
    skip: tuple[str, ...] = (),
) -> DataFrame:
    """One row per (case, field) with ``is_match``.

    ``expected`` and ``actual`` are typed records side by side in the case's row, so the fields are
    compared in place and no join is needed. A case without expected or actual record gives the
    single row ``has_output``; records of different shapes give ``type_match``.
    """
    want, got = cases.schema[expected].dataType, cases.schema[actual].dataType
    names = [f.name for f in want.fields if f.name not in skip]
    e, a = F.col(expected), F.col(actual)

    def row(name: str, ok: Column) -> Column:
        return F.struct(F.lit(name).alias("field"), ok.alias("is_match"))

    missing = F.array(row("has_output", a.isNotNull()))
    if want.fieldNames() != got.fieldNames():
        compared = F.array(row("type_match", F.lit(False)))
    else:
        rows = []
        for f in want.fields:
            if f.name not in names:
                continue
            x, y = e.getField(f.name), a.getField(f.name)
            if isinstance(f.dataType, T.ArrayType):
                same = list_match(
                    _canonical(x, f.dataType.elementType), _canonical(y, f.dataType.elementType)
                )
            else:
                same = normalized_match(x, y)
            ok = (
                F.when(x.isNull() & y.isNull(), True)
                .when(x.isNull() | y.isNull(), False)
                .otherwise(same)
            )
            rows.append(row(f.name, ok))
        compared = F.array(*rows)
    results = F.when(e.isNull() | a.isNull(), missing).otherwise(compared)
    return cases.select(*keys, F.inline(results))


def field_accuracy_long(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """The same rules over long field tables (keys, field, value), one row per field of either
    side; a field that only one side has matches only if its value is null."""
    x = expected.select(*keys, "field", F.col("value").alias("x"))
    y = actual.select(*keys, "field", F.col("value").alias("y"))
    return x.join(y, [*keys, "field"], "full_outer").select(
        *keys, "field", normalized_match(F.col("x"), F.col("y")).alias("is_match")
    )


# ---- evaluators named by a data set ------------------------------------------------------------------
# An evaluator turns the JSON text of the expected and the actual output into array<struct<field,is_match>>;
# ``options`` is a map<string,string> of its settings in the data set.

Evaluator = Callable[[Column, Column, Column], Column]

_FIELDS = "map<string,string>"


def _one(field: str, ok: Column) -> Column:
    return F.array(F.struct(F.lit(field).alias("field"), F.coalesce(ok, F.lit(False)).alias("is_match")))


def _plain_text(output: Column) -> Column:
    """A JSON string without its quotes; any other JSON as it is written; null for JSON null."""
    return F.coalesce(F.try_variant_get(F.try_parse_json(output), "$", "string"), F.when(F.trim(output) != "null", output))


def by_text(expected: Column, actual: Column, options: Column) -> Column:
    """The whole output by the normalised rule."""
    return _one("output", normalized_match(_plain_text(expected), _plain_text(actual)))


def by_number(expected: Column, actual: Column, options: Column) -> Column:
    """The whole output as a number, within ``tolerance`` (0.01)."""
    tolerance = F.coalesce(options["tolerance"].try_cast("double"), F.lit(0.01))
    return _one("output", numeric_tolerance(_plain_text(expected), _plain_text(actual), tolerance))


def by_fields(expected: Column, actual: Column, options: Column) -> Column:
    """Every field of the expected record but those of ``skip_fields`` (comma-separated)."""
    want, got = (F.from_json(F.when(F.ltrim(c).startswith("{"), c), _FIELDS) for c in (expected, actual))
    skip = F.split(F.coalesce(options["skip_fields"], F.lit("")), ",")
    listed = lambda c: F.from_json(F.when(F.ltrim(c).startswith("["), c), "array<string>")

    def field(e: Column) -> Column:
        x, y = e["value"], F.try_element_at(got, e["key"])
        same = F.when(listed(x).isNotNull(), F.coalesce(list_match(listed(x), listed(y)), F.lit(False))).otherwise(normalized_match(x, y))
        ok = F.when(x.isNull() & y.isNull(), True).when(x.isNull() | y.isNull(), False).otherwise(same)
        return F.struct(e["key"].alias("field"), ok.alias("is_match"))

    fields = F.transform(F.filter(F.map_entries(want), lambda e: ~F.array_contains(skip, e["key"])), field)
    missing = (_plain_text(expected).isNull()) | (_plain_text(actual).isNull())
    shapes = want.isNull() | got.isNull() | (F.array_sort(F.map_keys(want)) != F.array_sort(F.map_keys(got)))
    return F.when(missing, _one("has_output", _plain_text(actual).isNotNull())).when(shapes, _one("type_match", F.lit(False))).otherwise(fields)


# The names by which data sets call the evaluators.
EVALUATORS: dict[str, Evaluator] = {
    "FieldAccuracy": by_fields,
    "NormalizedStringMatch": by_text,
    "NumericTolerance": by_number,
}


def evaluate_datasets(
    cases: DataFrame, datasets: DataFrame, registry: dict[str, Evaluator] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Every case under the evaluators that its data set names, in one pass, and the names that nobody registered.

    ``cases``: dataset, case, expected, actual (JSON text); ``datasets``: dataset, evaluators as
    array<struct<name,options>>, one row per data set. Results: dataset, case, evaluator, field, is_match. Rejects: dataset, evaluator,
    reason. ``registry`` adds evaluators of the caller to :data:`EVALUATORS`. Cases of a data set without a row, or with an
    empty list, give no rows; a name that is listed twice counts once per listing.
    """
    known = EVALUATORS | (registry or {})
    asked = datasets.select("dataset", F.explode("evaluators").alias("ev"))
    named = F.col("ev.name").isin(*known)
    rejects = asked.filter(~F.coalesce(named, F.lit(False))).select(
        "dataset", F.col("ev.name").alias("evaluator"), F.lit("unknown evaluator").alias("reason")
    )
    rows = cases.join(datasets.select("dataset", F.filter("evaluators", lambda e: e["name"].isin(*known)).alias("__evs")), "dataset")
    rows = rows.select("dataset", "case", "expected", "actual", F.explode("__evs").alias("ev"))
    result = F.lit(None).cast("array<struct<field:string,is_match:boolean>>")
    for name, evaluator in known.items():
        found = evaluator(F.col("expected"), F.col("actual"), F.coalesce(F.col("ev.options"), F.create_map().cast(_FIELDS)))
        result = F.when(F.col("ev.name") == name, found).otherwise(result)
    out = unroll(rows, result, ["dataset", "case", F.col("ev.name").alias("evaluator")], "__p", "r")
    return out.select("dataset", "case", "evaluator", "r.*"), rejects


def accuracy_gate(results: DataFrame, group: str, floor: float = ACCURACY_FLOOR) -> DataFrame:
    """Share of matching fields per data set, and whether it reaches the floor."""
    return (
        results.groupBy(group)
        .agg(F.count("*").alias("n_checks"), F.count_if(F.col("is_match")).alias("n_match"))
        .withColumn("accuracy", F.col("n_match") / F.col("n_checks"))
        .withColumn("passed", F.col("accuracy") >= floor)
    )


def fixture_health(
    cases: DataFrame, files: DataFrame, datasets: list[str], errors: str | None = None
) -> DataFrame:
    """Problems of an evaluation set: empty data sets, missing source files, invalid records.

    ``cases``: dataset, case, pdf_path and, if named, an array of record errors. ``files``: path.
    """
    spark = cases.sparkSession
    wanted = spark.createDataFrame([(d,) for d in datasets], "dataset string")
    empty = wanted.join(cases.select("dataset").distinct(), "dataset", "left_anti").select(
        "dataset", F.lit(None).cast("string").alias("case"), F.lit("no cases").alias("problem")
    )
    lost = cases.join(
        files.select(F.col("path").alias("pdf_path")).distinct(), "pdf_path", "left_anti"
    ).select("dataset", F.col("case").cast("string"), F.lit("source file missing").alias("problem"))
    out = empty.unionByName(lost)
    if errors:
        bad = cases.filter(F.size(errors) > 0).select(
            "dataset", F.col("case").cast("string"), F.lit("invalid record").alias("problem")
        )
        out = out.unionByName(bad)
    return out


def classification_accuracy(pred: DataFrame, truth: DataFrame, runs: DataFrame) -> DataFrame:
    """Share of truth fields whose fragment was predicted; 1 for runs without truth.

    Both tables: run_id, field_key, fragment_id.
    """
    guess = pred.select("run_id", "field_key", F.col("fragment_id").alias("guess"))
    scored = (
        truth.join(guess, ["run_id", "field_key"], "left")
        .groupBy("run_id")
        .agg(
            F.count_if(F.col("guess") == F.col("fragment_id")).alias("hits"),
            F.count("*").alias("n_truth"),
        )
    )
    return runs.select("run_id").join(scored, "run_id", "left").select(
        "run_id",
        F.coalesce("n_truth", F.lit(0)).alias("n_truth"),
        F.coalesce(F.col("hits") / F.col("n_truth"), F.lit(1.0)).alias("accuracy"),
    )


def iou_macro(pred: DataFrame, truth: DataFrame, runs: DataFrame) -> DataFrame:
    """Mean IoU over truth fields, missing predictions count 0; 0 for runs without truth.

    Both tables: run_id, field_key, bbox.
    """
    guess = pred.select("run_id", "field_key", F.col("bbox").alias("guess"))
    scored = (
        truth.join(guess, ["run_id", "field_key"], "left")
        .groupBy("run_id")
        .agg(
            F.sum(
                F.when(F.col("guess").isNotNull(), iou(F.col("guess"), F.col("bbox"))).otherwise(0.0)
            ).alias("total"),
            F.count("*").alias("n_truth"),
        )
    )
    return runs.select("run_id").join(scored, "run_id", "left").select(
        "run_id",
        F.coalesce("n_truth", F.lit(0)).alias("n_truth"),
        F.coalesce(F.col("total") / F.col("n_truth"), F.lit(0.0)).alias("iou_macro"),
    )
