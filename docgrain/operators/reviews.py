"""Human edits: append, latest per field, overlay on the extracted record."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.values import as_variant, get_at_path, is_object_text
from .anchors import anchors_in_payload, field_pages
from .fields import flatten_scalars

WHEN = ["created_at", "field_review_id"]


def append_reviews(
    edits: DataFrame, documents: DataFrame, runs: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Edits on the current run of their document, and the edits that cannot be placed.

    ``edits``: document_id, field_path, edited_value, remark, created_at and an id; ``runs``
    carries ``extracted`` JSON. ``original_value`` is read from the run's own payload, never from
    an edited view. Rejected edits carry the reason.
    """
    known = documents.select("document_id").withColumn("has_doc", F.lit(True))
    current = runs.filter("is_current").select("document_id", "extraction_run_id", "extracted")
    placed = edits.join(known, "document_id", "left").join(current, "document_id", "left")
    placed = placed.withColumn(
        "reason",
        F.when(F.col("has_doc").isNull(), "document not found").when(
            F.col("extraction_run_id").isNull(), "no current extraction"
        ),
    )
    accepted = placed.filter("reason IS NULL").select(
        *edits.columns,
        "extraction_run_id",
        get_at_path(F.col("extracted"), F.col("field_path")).alias("original_value"),
    )
    return accepted, placed.filter("reason IS NOT NULL").select(*edits.columns, "reason")


def latest_reviews(reviews: DataFrame) -> DataFrame:
    """Last review per (run, field) and when the field was first reviewed.

    A pre-combined aggregate: each task reduces its own rows first, so a field with very many
    edits sends one row per task.
    """
    keys = ["extraction_run_id", "field_path"]
    rest = [c for c in reviews.columns if c not in keys]
    when = F.struct(*WHEN)
    best = reviews.groupBy(*keys).agg(
        F.max_by(F.struct(*rest), when).alias("r"), F.min(when).alias("first_seen")
    )
    return best.select(*keys, "r.*", "first_seen")


def audit_log(reviews: DataFrame) -> DataFrame:
    """What changed: path, was, now, remark, when — the latest review of each field."""
    return latest_reviews(reviews).select(
        "extraction_run_id",
        F.col("field_path").alias("path"),
        F.col("original_value").alias("was"),
        F.col("edited_value").alias("now"),
        "remark",
        F.col("created_at").alias("edited_at"),
    )


def overlay_fields(runs: DataFrame, reviews: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Typed overlay: column ``col`` of a run takes the last edit of field ``path``.

    ``fields`` maps path -> column. The latest edit of every field comes out of one pre-combined
    aggregate per run, so nothing is collected and nothing is deduplicated beforehand.
    """
    when = F.struct(*WHEN)
    picks = [
        F.max_by(
            F.when(F.col("field_path") == path, F.struct(F.col("edited_value").alias("v"))),
            F.when(F.col("field_path") == path, when),
        ).alias(f"__e{i}")
        for i, path in enumerate(fields)
    ]
    edits = (
        reviews.filter(F.col("field_path").isin(list(fields)))
        .groupBy("extraction_run_id")
        .agg(*picks)
    )
    joined = runs.join(edits, "extraction_run_id", "left")
    for i, column in enumerate(fields.values()):
        kind = runs.schema[column].dataType
        edit = F.col(f"__e{i}")
        joined = joined.withColumn(
            column,
            F.when(edit.isNotNull(), edit.getField("v").try_cast(kind)).otherwise(F.col(column)),
        )
    return joined.drop(*[f"__e{i}" for i in range(len(fields))])


EMPTY_STEP = r"(^|\.)(\.|$)"


def check_edits(reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edits that can be applied, and the others with a ``reason``: a dotted path with an empty step, or
    a value that is not JSON."""
    path, value = F.col("field_path"), F.col("edited_value")
    reason = F.when(path.isNull() | path.rlike(EMPTY_STEP), "invalid field path").when(
        value.isNotNull() & F.try_parse_json(value).isNull(), "value is not JSON"
    )
    checked = reviews.withColumn("reason", reason)
    return checked.filter("reason IS NULL").drop("reason"), checked.filter("reason IS NOT NULL")


def _merged(base: object, edits: list[tuple[list[str], object]]) -> dict:
    """An object under edits (steps, value) in their order.

    The edits are grouped by their first step. Of a group, the last edit of the member itself
    sets it, and the deeper ones after that are merged into it; without one they are merged into what was there.
    """
    groups: dict[str, list[tuple[list[str], object]]] = {}
    for (first, *deeper), value in edits:
        groups.setdefault(first, []).append((deeper, value))
    out = dict(base) if isinstance(base, dict) else {}
    for name, group in groups.items():
        whole = max((i for i, (deeper, _) in enumerate(group) if not deeper), default=-1)
        member = group[whole][1] if whole >= 0 else out.get(name)
        later = group[whole + 1 :]
        out[name] = _merged(member, later) if later else member
    return out


def overlay_json(payload: Column, edits: Column) -> Column:
    """JSON record with edits merged in at their dotted paths.

    ``edits`` is array<struct<path,value>> in the order to apply, ``value`` JSON text, checked by
    :func:`check_edits`. Members on a path that are not objects are replaced by objects.
    """

    @F.arrow_udf("string")
    def fold(base: pa.Array, changes: pa.Array) -> pa.Array:
        out = []
        for text, steps in zip(base.to_pylist(), changes.to_pylist()):
            if not steps:
                out.append(text)
                continue
            parsed = [
                (s["path"].split("."), None if s["value"] is None else json.loads(s["value"]))
                for s in steps
            ]
            view = _merged(json.loads(text) if text else {}, parsed)
            out.append(json.dumps(view, ensure_ascii=False, separators=(",", ":")))
        return pa.array(out, pa.string())

    return fold(payload, edits)


def extracted_view(runs: DataFrame, reviews: DataFrame, listed: bool = True) -> DataFrame:
    """Runs with ``view``, the extracted record under its latest edits, and ``reviews``, these edits; without
    ``listed`` only the view, and only what it needs of the edits is carried along.

    Edits of one run are applied in the order in which their fields were first reviewed. At most
    one edit per field reaches the run's row, where the result is one record as well. Edits that
    fail :func:`check_edits` are left out, as are records that are not JSON objects: their view
    is the record as it is. Runs with edits are joined and go through Python, the others are told apart by an anti-join and do not.
    """
    shown = ["field_review_id", "field_path", "edited_value", "original_value", "remark", "created_at"]
    if not listed:
        reviews = reviews.select("extraction_run_id", "field_path", "edited_value", *WHEN)
        shown = ["field_path", "edited_value"]
    latest = latest_reviews(check_edits(reviews)[0])
    entry = F.struct("first_seen", *[c for c in shown if c in latest.columns])
    per_run = latest.groupBy("extraction_run_id").agg(F.array_sort(F.collect_list(entry)).alias("reviews"))
    steps = F.transform(
        "reviews", lambda e: F.struct(e["field_path"].alias("path"), e["edited_value"].alias("value"))
    )
    record = F.when(
        F.col("extracted").isNull() | (is_object_text(F.col("extracted")) & F.try_parse_json("extracted").isNotNull()),
        F.coalesce("extracted", F.lit("{}")),
    )
    edited = runs.join(per_run, "extraction_run_id").withColumn("__record", record)
    view = F.coalesce(overlay_json(F.col("__record"), F.when(F.col("__record").isNotNull(), steps)), "extracted")
    edited = edited.withColumn("view", view).drop("__record")
    same = runs.join(per_run.select("extraction_run_id"), "extraction_run_id", "left_anti").withColumn("view", F.col("extracted"))
    if not listed:
        return edited.drop("reviews").unionByName(same)
    edited = edited.withColumn("reviews", F.transform("reviews", lambda e: e.dropFields("first_seen")))
    return edited.unionByName(same, allowMissingColumns=True)


def view_field_pages(view: DataFrame, blocks: str, depth: int | None = None) -> DataFrame:
    """(extraction_run_id, path, page_no): page of each value of the overlaid record.

    ``view`` has extraction_run_id, view and the payload's block array. Values are anchored as
    they stand after the edits; values that are found nowhere have no page.
    """
    keys = ["extraction_run_id"]
    leaves = flatten_scalars(view.select(*keys, as_variant(F.col("view")).alias("v")), "v", keys, depth)
    field = F.struct(F.col("ord").alias("ord"), "path", "value")
    fields = leaves.groupBy(*keys).agg(F.array_sort(F.collect_list(field)).alias("__f"))
    numbered = F.transform("__f", lambda f, i: F.struct(i.cast("long").alias("ord"), f["path"].alias("path"), f["value"].alias("value")))
    rows = view.select(*keys, blocks).join(fields, keys).withColumn("__f", numbered)
    return field_pages(anchors_in_payload(rows, "__f", blocks, keys)).select(*keys, "path", "page_no")


def delete_review(reviews: DataFrame, runs: DataFrame, requests: DataFrame) -> DataFrame:
    """Reviews without those requested as (document_id, field_review_id).

    A request counts only if the review's run belongs to that document.
    """
    asked = requests.select("field_review_id", F.col("document_id").alias("asked_doc"))
    targets = reviews.join(asked, "field_review_id").select(
        "field_review_id", "extraction_run_id", "asked_doc"
    )
    owned = targets.join(
        runs.select("extraction_run_id", F.col("document_id").alias("asked_doc")),
        ["extraction_run_id", "asked_doc"],
        "left_semi",
    )
    return reviews.join(owned.select("field_review_id"), "field_review_id", "left_anti")


def document_status(documents: DataFrame, runs: DataFrame, reviews: DataFrame) -> DataFrame:
    """Status after the latest event: uploaded, extracted by a run, reviewed by an edit.

    ``documents``: document_id, created_at. ``runs``: document_id, extraction_run_id, created_at.
    ``reviews``: extraction_run_id, created_at. Edits are reduced to one row per run before they
    look up their document.
    """

    def events(df: DataFrame, rank: int, status: str) -> DataFrame:
        return df.select(
            "document_id",
            F.struct(F.col("created_at").alias("at"), F.lit(rank).alias("rank")).alias("when"),
            F.lit(status).alias("status"),
        )

    last_edit = reviews.groupBy("extraction_run_id").agg(F.max("created_at").alias("created_at"))
    edited = last_edit.join(runs.select("extraction_run_id", "document_id"), "extraction_run_id")
    all_events = (
        events(documents, 0, "uploaded")
        .unionByName(events(runs, 1, "extracted"))
        .unionByName(events(edited, 2, "reviewed"))
    )
    return all_events.groupBy("document_id").agg(F.max_by("status", "when").alias("status"))


def open_queue(documents: DataFrame) -> DataFrame:
    return documents.filter(F.col("status") != "reviewed")


def edit_summary(accepted: DataFrame, view: DataFrame) -> DataFrame:
    """Edits applied per run, with the record and the reviews that result (:func:`extracted_view`
    over all reviews, the accepted ones included)."""
    counts = accepted.groupBy("extraction_run_id").agg(F.count("*").alias("applied"))
    return counts.join(view.select("extraction_run_id", "view", "reviews"), "extraction_run_id")
