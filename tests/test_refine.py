"""Patch application against a small sequential model."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from docgrain.functions.values import as_variant
from docgrain.operators import refine as P

PATCH = (
    "run_id long, patch_ord long, op string, fragment_id string, field_key string, "
    "new_bbox struct<l:double,t:double,r:double,b:double>, box_2d array<int>, new_text string, "
    "reason string, confidence double"
)
FRAG = (
    "run_id long, frag_ord long, self_ref string, id string, text string, "
    "bbox struct<l:double,t:double,r:double,b:double>, source string, confidence double"
)
RUNS = "run_id long, page_w double, page_h double, n_refined int"
BOX = (1.0, 2.0, 3.0, 4.0)


def sequential(frags, patches, size, prior):
    """One run, patch by patch. Returns None if a patch breaks the contract."""
    w, h = size if size[0] and size[1] else (595.44, 842.04)
    alias, boxes = {}, {}
    for ord_, ref, id_, box in frags:
        alias[ref or id_ or f"f{ord_}"] = ord_
        alias[f"f{ord_}"] = ord_
        boxes[ord_] = box
    out = {"assign": {}, "reject": [], "add": [], "move": [], "low": [], "orphan": []}
    n = prior
    for p in patches:
        _, k, op, fid, key, nb, norm, text, _, conf = p
        if conf < 0.5:
            out["low"].append(k)
            continue
        box = nb
        if norm is not None:
            good = len(norm) == 4 and norm[2] >= norm[0] and norm[3] >= norm[1]
            box = tuple(v * s / 1000 for v, s in zip(norm, (w, h, w, h))) if good else None
        if op == "add":
            if not text or box is None:
                return None
            ref = f"#/refined-texts/{n}"
            n += 1
            out["add"].append((k, ref, box))
            if key:
                out["assign"][key] = ref
            continue
        if not fid or (op == "assign" and not key):
            return None
        if fid not in alias:
            out["orphan"].append(k)
        elif op == "assign":
            out["assign"][key] = fid
        elif op == "reject":
            out["reject"].append((k, fid))
        elif box is None:
            return None
        else:
            out["move"].append((k, alias[fid], boxes[alias[fid]], box))
            boxes[alias[fid]] = box
    out["boxes"] = boxes
    return out


def near(a, b):
    return a == b or (a is not None and b is not None and all(abs(x - y) < 1e-6 for x, y in zip(a, b)))


def test_random_against_sequential(spark):
    rng = random.Random(11)
    frags, patches, runs, want = [], [], [], {}
    for run in range(60):
        size = rng.choice([(600.0, 800.0), (None, None), (0.0, 700.0)])
        prior = rng.choice([None, 0, 2])
        runs.append((run, *size, prior))
        fs = [
            (i, rng.choice([f"#/texts/{rng.randint(0, 3)}", None, ""]), rng.choice([None, "f1"]), tuple(float(rng.randint(0, 9)) for _ in range(4)))
            for i in range(rng.randint(0, 5))
        ]
        frags += [(run, i, ref, id_, "t", box, "ocr", None) for i, ref, id_, box in fs]
        ps = []
        for k in range(rng.randint(0, 9)):
            op = rng.choice(["assign", "add", "reject", "move"])
            careless = rng.random() < 0.04
            ps.append(
                (
                    run, k, op,
                    None if op == "add" or careless else rng.choice(["f0", "f1", "f2", "#/texts/1", "#/texts/2", "zz"]),
                    rng.choice(["a", "b", "c"]) if op == "assign" or rng.random() < 0.5 else None,
                    tuple(float(rng.randint(0, 9)) for _ in range(4)) if op in ("add", "move") and not careless else None,
                    [1, 2, rng.choice([0, 3, 3, 3, 3, 3, 3, 3]), 40] if op in ("add", "move") and rng.random() < 0.3 else None,
                    "new" if op == "add" and not careless else None,
                    "why", rng.choice([0.2, 0.5, 0.9, 1.0]),
                )
            )
        patches += ps
        want[run] = sequential(fs, ps, size, prior or 0)
    result = P.apply_patches(
        spark.createDataFrame(frags, FRAG).repartition(4),
        spark.createDataFrame(patches, PATCH).repartition(3),
        spark.createDataFrame(runs, RUNS),
    )
    good = {r: w for r, w in want.items() if w is not None}
    assert 10 < len(good) < 60
    assert {(r.run_id, r.field_key): r.fragment_id for r in result.assignments.collect()} == {
        (r, k): v for r, w in good.items() for k, v in w["assign"].items()
    }
    assert {(r.run_id, r.patch_ord, r.fragment_id) for r in result.rejected.collect()} == {
        (r, *x) for r, w in good.items() for x in w["reject"]
    }
    added = {(r.run_id, r.patch_ord): (r.fragment_id, tuple(r.bbox)) for r in result.added.collect()}
    assert set(added) == {(r, k) for r, w in good.items() for k, _, _ in w["add"]}
    for r, w in good.items():
        for k, ref, box in w["add"]:
            assert added[r, k][0] == ref and near(added[r, k][1], box)
    moved = {(r.run_id, r.patch_ord): r for r in result.moved.collect()}
    assert set(moved) == {(r, k) for r, w in good.items() for k, *_ in w["move"]}
    for r, w in good.items():
        for k, frag, before, after in w["move"]:
            row = moved[r, k]
            assert row.frag_ord == frag and near(tuple(row.before), before) and near(tuple(row.after), after)
    for name, df in (("low", result.low), ("orphan", result.orphans)):
        assert {(r.run_id, r.patch_ord) for r in df.collect()} == {
            (r, k) for r, w in good.items() for k in w[name]
        }
    final = {(r.run_id, r.frag_ord): r for r in result.fragments.filter("source = 'ocr'").collect()}
    assert set(final) == {(r, i) for r, w in good.items() for i in w["boxes"]}
    for r, w in good.items():
        for i, box in w["boxes"].items():
            assert near(tuple(final[r, i].bbox), box)
    assert {r.run_id for r in result.violations.collect()} == set(want) - set(good)


def patch(k, op, conf=0.9, **more):
    row = {"fragment_id": None, "field_key": None, "new_bbox": None, "box_2d": None, "new_text": None}
    row.update(more)
    return (1, k, op, *row.values(), "why", conf)


def apply(spark, patches, **options):
    frags = [(1, 0, "#/texts/0", None, "t", BOX, "ocr", None), (1, 1, "#/texts/1", None, "u", BOX, "ocr", None)]
    return P.apply_patches(
        spark.createDataFrame(frags, FRAG),
        spark.createDataFrame(patches, PATCH),
        spark.createDataFrame([(1, 595.44, 842.04, None)], RUNS),
        **options,
    )


def test_single_cases(spark):
    added = apply(spark, [patch(0, "add", box_2d=[100, 100, 200, 150], new_text="x", field_key="k")])
    row = added.added.first()
    assert abs(row.bbox.l - 59.544) < 1e-9 and abs(row.bbox.t - 84.204) < 1e-9
    assert added.assignments.first().fragment_id == "#/refined-texts/0"
    assert added.fragments.filter("source = 'vlm'").first().frag_ord == 2
    given = apply(spark, [patch(0, "add", new_bbox=(10.0, 1.0, 2.0, 3.0), new_text="x")])
    assert given.added.first().bbox.l == 10.0
    low = apply(spark, [patch(0, "assign", 0.2, fragment_id="f0", field_key="k")])
    assert low.low.count() == 1 and low.assignments.count() == 0
    lost = apply(spark, [patch(0, "assign", fragment_id="f9", field_key="k")])
    assert lost.orphans.count() == 1 and lost.assignments.count() == 0
    twice = apply(spark, [patch(0, "reject", fragment_id="f0"), patch(1, "reject", fragment_id="#/texts/0")])
    assert twice.rejected.count() == 2 and twice.fragments.count() == 2
    assert P.visible_fragments(twice.fragments, twice.rejected).count() == 1


def test_contract(spark):
    for bad in (patch(0, "add", new_bbox=BOX), patch(0, "move", fragment_id="f0"), patch(0, "assign", fragment_id="f0")):
        out = apply(spark, [bad])
        assert out.violations.count() == 1 and out.fragments.count() == 0
        with pytest.raises(Exception, match="contract violated"):
            apply(spark, [bad], mode="fail").assignments.collect()
    # An unknown fragment is looked at before the missing box of a move.
    assert apply(spark, [patch(0, "move", fragment_id="zz")]).orphans.count() == 1


def test_prior_assignments(spark):
    prior = spark.createDataFrame(
        [(1, "k", "f1", 0.9, "old"), (1, "j", "f1", 0.9, "old")],
        "run_id long, field_key string, fragment_id string, confidence double, reason string",
    )
    out = apply(spark, [patch(0, "assign", fragment_id="f0", field_key="k")], prior_assignments=prior)
    assert {r.field_key: r.fragment_id for r in out.assignments.collect()} == {"k": "f0", "j": "f1"}


def test_parse(spark):
    ok = {"op": "assign", "reason": "r", "confidence": 1}
    cases = [
        ([ok, dict(ok, op="move")], 2, None), ([], 0, None), ([dict(ok, extra=1)], 0, "unknown key"),
        ([dict(ok, op="zap")], 0, "invalid value"), ([dict(ok, confidence=1.01)], 0, "invalid value"),
        ([{"op": "add", "confidence": 0.5}], 0, "invalid value"), ({"op": "add"}, 0, "not a list"),
    ]
    df = spark.createDataFrame([(i, json.dumps(c)) for i, (c, _, _) in enumerate(cases)], "run_id long, p string")
    good, refused = P.parse_patches(df, "p")
    counts = {r.run_id: r["count"] for r in good.groupBy("run_id").count().collect()}
    reasons = {r.run_id: r.reject_reason for r in refused.collect()}
    for i, (_, n, reason) in enumerate(cases):
        assert counts.get(i, 0) == n and reasons.get(i) == reason


def test_traces_and_usage(spark):
    df = spark.createDataFrame(
        [('{"visual_audit":"v","scaffold_match":{"a":[1]},"discrepancies":true}', '[{"usage":{"total_tokens":7}}]'), ("{}", "[]")],
        "t string, h string",
    ).select(P.coerce_trace(as_variant(F.col("t"))).alias("t"), P.token_usage(as_variant(F.col("h"))).alias("u"))
    a, b = df.collect()
    assert (a.t.visual_audit, a.t.scaffold_match, a.t.discrepancies) == ("v", '{"a":[1]}', "True")
    assert a.u.total_tokens == 7 and a.u.prompt_tokens is None and b.u is None


def test_texts_are_shuffled_once(spark):
    """Joins by run and position take the keys to the texts: one shuffle of each table that holds texts."""
    size = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(size)
    spark.conf.set(size, "-1")
    try:
        out = apply(spark, [patch(0, "add", new_bbox=BOX, new_text="x")])
        for df, most in ((out.fragments, 2), (out.added, 1), (out.visible, 1)):
            plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
            steps = re.findall(r"^\(\d+\) Exchange\nInput \[\d+\]: (.*)$", plan, re.M)
            assert steps and len([s for s in steps if re.search(r"\b(new_)?text#", s)]) <= most
    finally:
        spark.conf.set(size, before)


def test_quarantined_runs_and_runs_without_id(spark):
    """A quarantined run shows no fragment, moved or added; fragments without run or position stay."""
    frags = [(r, i, None, None, "t", BOX, "ocr", None) for r, i in ((1, 0), (2, 0), (2, None), (None, 0), (3, 0))]
    bad = patch(2, "add", new_bbox=BOX)
    moves = [patch(0, "move", fragment_id="f0", new_bbox=(5.0, 5.0, 6.0, 6.0)), patch(1, "add", new_bbox=BOX, new_text="x")]
    patches = [*moves, bad, *[(2, *p[1:]) for p in moves], (2, *patch(2, "reject", fragment_id="f0")[1:])]
    out = P.apply_patches(
        spark.createDataFrame(frags, FRAG), spark.createDataFrame(patches, PATCH), spark.createDataFrame([(1, None, None, 4)], RUNS)
    )
    got = sorted(((r.run_id, r.frag_ord, r.text, r.bbox.l) for r in out.fragments.collect()), key=repr)
    want = [(2, 0, "t", 5.0), (2, 1, "x", 1.0), (2, None, "t", 1.0), (3, 0, "t", 1.0), (None, 0, "t", 1.0)]
    assert got == sorted(want, key=repr)
    assert sorted(((r.run_id, r.frag_ord) for r in out.visible.collect()), key=repr) == [(2, None), (3, 0), (None, 0)]
    assert [r.fragment_id for r in out.added.collect()] == ["#/refined-texts/0"]
