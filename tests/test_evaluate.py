from pyspark.sql import functions as F

from docgrain.operators import evaluate as E
from docgrain.operators import metrics as M
from docgrain.sources import tables

REC = "struct<a:string,l:array<string>,items:array<struct<d:string,q:string>>>"


def test_field_accuracy(spark):
    rows = [
        (1, ("X y", ["1", "2"], [("d", None)]), (" x  Y", ["1", " 2"], [("d", None)])),
        (2, (None, [], None), (None, ["1"], None)),
        (3, ("x", [], []), (None, [], [])),
        (4, None, ("x", [], [])),
        (5, ("x", [], []), None),
    ]
    df = spark.createDataFrame(rows, f"id int, e {REC}, a {REC}")
    out = {(r.id, r.field): r.is_match for r in E.field_accuracy(df, "e", "a", ["id"]).collect()}
    assert out == {
        (1, "a"): True, (1, "l"): True, (1, "items"): True,
        (2, "a"): True, (2, "l"): False, (2, "items"): True,
        (3, "a"): False, (3, "l"): True, (3, "items"): True,
        (4, "has_output"): True, (5, "has_output"): False,
    }
    skipped = E.field_accuracy(df, "e", "a", ["id"], skip=("l",)).filter("field = 'l'")
    assert skipped.count() == 0
    other = df.withColumn("a", F.struct(F.lit("x").alias("z")))
    rows = E.field_accuracy(other, "e", "a", ["id"]).filter("id = 1").collect()
    assert [(r.field, r.is_match) for r in rows] == [("type_match", False)]
    gate = E.accuracy_gate(E.field_accuracy(df, "e", "a", ["id"]), "id").filter("id = 2").first()
    assert abs(gate.accuracy - 2 / 3) < 1e-12 and gate.passed


def test_refinement_metrics(spark):
    ddl = "run_id int, field_key string, fragment_id string, bbox struct<l:double,t:double,r:double,b:double>"
    box, half = (0.0, 0.0, 10.0, 10.0), (5.0, 0.0, 15.0, 10.0)
    truth = spark.createDataFrame([(1, "n", "f37", box), (1, "i", "f5", box), (2, "n", "f1", box)], ddl)
    pred = spark.createDataFrame([(1, "n", "f37", half), (1, "z", "f5", box), (2, "n", "f9", None)], ddl)
    runs = spark.range(1, 4).select(F.col("id").cast("int").alias("run_id"))
    acc = {r.run_id: r.accuracy for r in E.classification_accuracy(pred, truth, runs).collect()}
    assert acc == {1: 0.5, 2: 0.0, 3: 1.0}
    macro = {r.run_id: round(r.iou_macro, 9) for r in E.iou_macro(pred, truth, runs).collect()}
    assert macro == {1: round(1 / 6, 9), 2: 0.0, 3: 0.0}


def test_metrics(spark):
    lines = spark.createDataFrame(
        [("GET /a -> 200 in 1.50ms",), ("GET /a -> 503 in 2.50ms",), ("noise",), ("POST /b -> 201 in 7ms",)], "line string"
    )
    out = {r.path: r for r in M.request_timing(lines, "line").collect()}
    assert (out["/a"].n, out["/a"].mean_ms, out["/a"].error_share) == (2, 2.0, 0.5) and out["/b"].n == 1
    traces = spark.createDataFrame([(1.0, 3.0), (2.0, 2.0)], "o double, m double")
    shares = {r.stage: r.share for r in M.stage_timing(traces, {"ocr": "o", "model": "m"}).collect()}
    assert shares == {"ocr": 3 / 8, "model": 5 / 8}


def test_data_sets_name_their_evaluators(spark, tmp_path):
    import json

    sets = [
        {"name": "a", "evaluators": [{"name": "FieldAccuracy", "options": {"skip_fields": "id"}}], "cases": [
            {"name": "1", "inputs": {"pdf_path": "x.pdf"}, "expected_output": {"id": 1, "w": "A  b", "l": ["x", "Y"], "n": None}, "metadata": {"status": "ok"}},
            {"name": "2", "expected_output": {"id": 2, "w": "c", "l": [], "n": "z"}},
            {"name": "3", "expected_output": {"id": 3}},
            {"name": "4", "expected_output": {"id": 4}},
        ]},
        {"name": "b", "evaluators": [{"name": "NumericTolerance", "options": {"tolerance": "0.5"}}, {"name": "Mine"}, {"name": "Nobody"}], "cases": [
            {"name": "1", "expected_output": "12.0 kg"}, {"name": "2", "expected_output": "12.0 kg"},
        ]},
        {"name": "c", "cases": [{"name": "1", "expected_output": "x"}]},
    ]
    (tmp_path / "sets.json").write_text("\n".join(map(json.dumps, sets)))
    cases, datasets = tables.load_eval_datasets(spark, str(tmp_path / "sets.json"))
    assert cases.count() == 7 and cases.filter("pdf_path = 'x.pdf' and status = 'ok'").count() == 1
    outputs = [("a", "1", '{"id": 9, "w": "a B", "l": ["X", "y"], "n": null}'), ("a", "2", '{"id": 2, "w": null, "l": [], "n": "y"}')]
    outputs += [("a", "3", '{"other": 3}'), ("a", "4", None), ("b", "1", '"12.4 t"'), ("b", "2", "13")]
    actual = spark.createDataFrame(outputs, "dataset string, case string, actual string")
    mine = {"Mine": lambda e, a, o: E._one("mine", F.length(a) > 2)}
    rows, rejects = E.evaluate_datasets(cases.join(actual, ["dataset", "case"], "left"), datasets, mine)
    got = {(r.dataset, r.case, r.evaluator, r.field): r.is_match for r in rows.collect()}
    fields = "FieldAccuracy"
    assert got == {
        ("a", "1", fields, "w"): True, ("a", "1", fields, "l"): True, ("a", "1", fields, "n"): True,
        ("a", "2", fields, "w"): False, ("a", "2", fields, "l"): True, ("a", "2", fields, "n"): False,
        ("a", "3", fields, "type_match"): False, ("a", "4", fields, "has_output"): False,
        ("b", "1", "NumericTolerance", "output"): True, ("b", "2", "NumericTolerance", "output"): False,
        ("b", "1", "Mine", "mine"): True, ("b", "2", "Mine", "mine"): False,
    }
    assert [tuple(r) for r in rejects.collect()] == [("b", "Nobody", "unknown evaluator")]


def test_stored_sketches_merge_over_any_days(spark):
    import datetime as dt
    import random

    rng = random.Random(5)
    rows = [("GET", "/a", 500 if i % 100 == 0 else 200, rng.lognormvariate(3, 1), dt.datetime(2024, 1, 1 + i % 9)) for i in range(20_000)]
    rows += [("GET", "/b", 200, 7.0, dt.datetime(2024, 1, 3))]
    stored = M.timing_sketches(spark.createDataFrame(rows, "method string, path string, status int, ms double, ts timestamp").repartition(6))
    assert stored.count() == 10
    for days in ([1], [2, 5, 9], list(range(1, 10))):
        part = stored.filter(F.dayofmonth("period").isin(days))
        got = {r.path: r for r in M.timing_over(part).collect()}
        ms = sorted(r[3] for r in rows if r[1] == "/a" and r[4].day in days)
        assert got["/a"].n == len(ms) and abs(got["/a"].mean_ms - sum(ms) / len(ms)) < 1e-6
        for p in M.PERCENTS:
            value = got["/a"][f"p{p}_ms_kll"]
            assert abs(sum(x <= value for x in ms) / len(ms) - p / 100) < 0.01
    assert got["/b"].p99_ms_kll == 7.0
    assert max(len(r.sketch) for r in stored.collect()) < 20_000
