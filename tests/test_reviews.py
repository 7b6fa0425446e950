import json

from pyspark.sql import functions as F

from docgrain.operators import reviews as R

DDL = (
    "field_review_id long, extraction_run_id long, field_path string, original_value string, "
    "edited_value string, remark string, created_at timestamp"
)


def at(minute):
    import datetime as dt

    return dt.datetime(2024, 1, 1, 0, minute)


def edits(spark, rows):
    return spark.createDataFrame(
        [(i, run, path, None, json.dumps(value), None, at(minute)) for i, (run, path, value, minute) in enumerate(rows)],
        DDL,
    )


def view(spark, base, rows):
    runs = spark.createDataFrame([(1, json.dumps(base))], "extraction_run_id long, extracted string")
    return json.loads(R.extracted_view(runs, edits(spark, rows)).first().view)


def test_overlay(spark):
    base = {"a": 1, "o": {"x": 1, "y": 2}, "items": [{"q": 1}]}
    assert view(spark, base, []) == base
    assert view(spark, base, [(1, "o.x", "é", 0), (1, "items", [], 1)]) == {
        "a": 1, "o": {"x": "é", "y": 2}, "items": [],
    }
    # Parents that are no objects are replaced, missing ones created, null is a value.
    assert view(spark, base, [(1, "a.b.c", 5, 0), (1, "n.m", None, 1)])["a"] == {"b": {"c": 5}}
    # The later edit of a field wins; fields are applied in the order of their first edit.
    rows = [(1, "o", {"z": 1}, 0), (1, "o.x", 9, 1), (1, "o", {"w": 2}, 2)]
    assert view(spark, base, rows)["o"] == {"w": 2, "x": 9}
    # Bad edits are put aside and stop nothing.
    assert view(spark, base, [(1, "a..b", 1, 0), (1, "", 2, 1), (1, "a.", 3, 2), (1, "a", 4, 3)])["a"] == 4


def test_bad_edits_and_records(spark):
    rows = [(0, 1, "a", None, "1", None, at(0)), (1, 1, ".a", None, "1", None, at(0)), (2, 1, "a", None, "{x", None, at(1))]
    rows += [(3, 2, "a", None, "2", None, at(0)), (4, 3, "a", None, None, None, at(0)), (5, 1, None, None, "1", None, at(0))]
    log = spark.createDataFrame(rows, DDL)
    good, bad = R.check_edits(log)
    assert {r.field_review_id for r in good.collect()} == {0, 3, 4}
    assert {r.field_review_id: r.reason for r in bad.collect()} == {1: "invalid field path", 2: "value is not JSON", 5: "invalid field path"}
    runs = spark.createDataFrame([(1, '{"a":0}'), (2, "[broken"), (3, None), (4, "{}")], "extraction_run_id long, extracted string")
    out = {r.extraction_run_id: (r.view, r.reviews and [x.field_review_id for x in r.reviews]) for r in R.extracted_view(runs, log).collect()}
    assert out == {1: ('{"a":1}', [0]), 2: ("[broken", [3]), 3: ('{"a":null}', [4]), 4: ("{}", None)}


def test_merge_equals_one_edit_after_the_other():
    import copy
    import random

    def set_at(node, steps, value):
        for s in steps[:-1]:
            node = node[s] if isinstance(node.get(s), dict) else node.setdefault(s, {}) if s not in node else node.update({s: {}}) or node[s]
        node[steps[-1]] = value

    rng = random.Random(3)
    for _ in range(500):
        base = {"a": {"b": {"c": 1}, "d": 2}, "b": 3}
        edits = [([rng.choice("abcd") for _ in range(rng.randint(1, 4))], rng.choice([1, None, {"a": 1}, [2]])) for _ in range(6)]
        want = copy.deepcopy(base)
        for steps, value in edits:
            set_at(want, steps, copy.deepcopy(value))
        assert R._merged(base, edits) == want


def test_ties_and_typed_overlay(spark):
    rows = edits(spark, [(1, "t", 1, 5), (1, "t", 2, 5), (2, "t", None, 0), (3, "other", 1, 0)])
    latest = {r.extraction_run_id: r.field_review_id for r in R.latest_reviews(rows).collect()}
    assert latest == {1: 1, 2: 2, 3: 3}
    runs = spark.createDataFrame([(i, 0.5) for i in range(1, 5)], "extraction_run_id long, total double")
    clear = rows.na.replace("null", None, subset=["edited_value"])
    out = {r.extraction_run_id: r.total for r in R.overlay_fields(runs, clear, {"t": "total"}).collect()}
    assert out == {1: 2.0, 2: None, 3: 0.5, 4: 0.5}


def test_append_and_delete(spark):
    docs = spark.createDataFrame([("d1",), ("d2",)], "document_id string")
    runs = spark.createDataFrame(
        [("d1", 1, '{"a":{"b":3}}', False), ("d1", 2, '{"a":{"b":4}}', True), ("d2", 3, "{}", False)],
        "document_id string, extraction_run_id long, extracted string, is_current boolean",
    )
    asked = spark.createDataFrame(
        [(1, "d1", "a.b", "5"), (2, "d2", "a", "1"), (3, "d9", "a", "1")],
        "edit_id int, document_id string, field_path string, edited_value string",
    )
    ok, bad = R.append_reviews(asked, docs, runs)
    row = ok.first()
    assert (row.extraction_run_id, row.original_value) == (2, "4")
    assert {r.edit_id: r.reason for r in bad.collect()} == {2: "no current extraction", 3: "document not found"}
    log = ok.select(F.col("edit_id").cast("long").alias("field_review_id"), "extraction_run_id", "field_path", "original_value", "edited_value", F.lit(None).cast("string").alias("remark"), F.lit(at(0)).alias("created_at"))
    summary = R.edit_summary(ok, R.extracted_view(runs, log)).collect()
    assert [(r.extraction_run_id, r.applied, r.view, len(r.reviews)) for r in summary] == [(2, 1, '{"a":{"b":5}}', 1)]
    log = edits(spark, [(1, "a", 1, 0), (1, "a", 2, 1), (3, "a", 3, 2)])
    gone = spark.createDataFrame([("d1", 1), ("d1", 2)], "document_id string, field_review_id long")
    left = R.delete_review(log, runs, gone)
    assert {r.field_review_id for r in left.collect()} == {0, 2}
    assert {r.now for r in R.audit_log(left).collect()} == {"1", "3"}


def test_status(spark):
    docs = spark.createDataFrame([("a", at(0)), ("b", at(0)), ("c", at(0)), ("d", at(0))], "document_id string, created_at timestamp")
    runs = spark.createDataFrame(
        [("b", 1, at(1)), ("c", 2, at(1)), ("d", 3, at(1)), ("d", 4, at(9))],
        "document_id string, extraction_run_id long, created_at timestamp",
    )
    log = spark.createDataFrame([(2, at(2)), (3, at(2))], "extraction_run_id long, created_at timestamp")
    out = R.document_status(docs, runs, log)
    assert {r.document_id: r.status for r in out.collect()} == {
        "a": "uploaded", "b": "extracted", "c": "reviewed", "d": "extracted",
    }
    assert {r.document_id for r in R.open_queue(out).collect()} == {"a", "b", "d"}
