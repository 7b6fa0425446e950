import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docgrain.functions.values import as_variant
from docgrain.operators import fields as O
from docgrain.operators import patterns as P
from docgrain.operators.patterns import payload_contains_many


def holds(v, p):
    """The rule, value by value."""
    if isinstance(p, dict):
        return isinstance(v, dict) and all(k in v and holds(v[k], x) for k, x in p.items())
    if isinstance(p, list):
        return isinstance(v, list) and all(any(holds(e, x) for e in v) for x in p)
    if isinstance(p, bool) or isinstance(v, bool) or p is None or v is None or isinstance(p, str) != isinstance(v, str):
        return p is v or (isinstance(p, bool) and isinstance(v, bool) and p == v)
    return not isinstance(v, dict | list) and v == p


def value(rng, depth):
    pick = rng.random()
    if depth == 0 or pick < 0.4:
        return rng.choice([1, 2, 2.0, 0, -0.0, True, False, None, "a", "1", "true", ""])
    if pick < 0.7:
        return {k: value(rng, depth - 1) for k in rng.sample(["a", "b", "c.d", "[]", "é"], rng.randrange(4))}
    return [value(rng, depth - 1) for _ in range(rng.randrange(4))]


def part(rng, v):
    """A pattern that the value holds, most of the time."""
    if isinstance(v, dict):
        return {k: part(rng, x) for k, x in v.items() if rng.random() < 0.6}
    if isinstance(v, list):
        return [part(rng, x) for x in rng.sample(v, rng.randint(0, len(v)))]
    return v if rng.random() < 0.9 else rng.choice([1, "a", None])


def tables(spark, values, asked):
    rows = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "k long, j string")
    pats = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(asked)], "pattern_id long, j string")
    v, p = as_variant(F.col("j")).alias("v"), as_variant(F.col("j")).alias("pattern")
    return rows.select("k", v).repartition(3), pats.select("pattern_id", p).repartition(2)


def test_random_patterns(spark):
    rng = random.Random(11)
    values = [value(rng, 4) for _ in range(60)]
    asked = [part(rng, rng.choice(values)) for _ in range(60)] + [{}, [], None, [[]], [{}], {"a": []}, [[1]], [{"a": 1}, {"b": 2}], "a", 2, True]
    rows, pats = tables(spark, values, asked)
    got = {(r.k, r.pattern_id) for r in payload_contains_many(rows, "v", ["k"], pats).collect()}
    want = {(i, j) for i, v in enumerate(values) for j, p in enumerate(asked) if holds(v, p)}
    assert got == want
    assert payload_contains_many(rows, "v", ["k"], pats).count() == len(want)
    assert payload_contains_many(rows, "v", ["k"], pats.limit(0)).collect() == []
    assert payload_contains_many(rows.limit(0), "v", ["k"], pats).collect() == []


def test_equals_the_filter_of_one_pattern(spark):
    values = [
        {"items": [{"q": 1, "n": "x"}, {"q": 2, "n": "y"}]},
        {"items": [{"q": 1, "n": "y"}, {"q": 2, "n": "x"}]},
        {"items": [{"q": 1, "n": "x", "sub": [[1, 2], [3]]}], "o": None},
        {"items": {"q": 1}},
    ]
    asked = [
        {"items": [{"q": 1, "n": "x"}]}, {"items": [{"q": 1}, {"n": "x"}]}, {"items": [{"sub": [[1], [3]]}]},
        {"items": [{"sub": [[1, 3]]}]}, {"o": None}, {"items": {}}, {"items": []},
    ]
    rows, pats = tables(spark, values, asked)
    got = {(r.k, r.pattern_id) for r in payload_contains_many(rows, "v", ["k"], pats).collect()}
    assert got == {(r.k, j) for j, p in enumerate(asked) for r in O.payload_contains(rows, "v", p).collect()}
    assert {k for k, j in got if j == 0} == {0, 2} and {k for k, j in got if j == 1} == {0, 1, 2}


def shuffled(spark):
    """Bytes shuffled so far in this session."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    summaries = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(summaries.apply(i).totalShuffleWrite() for i in range(summaries.size()))


def test_values_that_no_pattern_names_are_not_shuffled(spark):
    rng = random.Random(12)
    values = [{"id": i, "items": [{"q": i % 50, "n": "x"}] * 3, "rest": {f"k{rng.random()}": rng.random() for _ in range(40)}} for i in range(1500)]
    asked = [{"items": [{"q": q, "n": "x"}, {"n": "x"}]} for q in range(1000)]
    rows, pats = tables(spark, values, asked)
    rows = rows.select("k", F.col("v")).localCheckpoint()
    before = shuffled(spark)
    assert payload_contains_many(rows, "v", ["k"], pats).count() == len(values)
    assert shuffled(spark) - before < 2 * sum(len(json.dumps(v)) for v in values)


def test_values_that_patterns_name_are_shuffled_as_numbers(spark):
    rng = random.Random(13)
    values = [{"id": i, "text": f"{rng.getrandbits(2400):x}"} for i in range(3000)]
    asked = [{"id": v["id"], "text": v["text"]} for v in values[:40]]
    rows, pats = tables(spark, values, asked)
    rows = rows.select("k", F.col("v")).localCheckpoint()
    before = shuffled(spark)
    assert sorted(map(tuple, payload_contains_many(rows, "v", ["k"], pats).collect())) == [(i, i) for i in range(40)]
    assert shuffled(spark) - before < 0.5 * sum(len(v["text"]) for v in values)


@pytest.mark.parametrize("most", [0, 1000])
def test_keys_that_no_pattern_has_are_not_read(spark, monkeypatch, most):
    monkeypatch.setattr(P, "KEYS", most)
    values = [{"a": None, "x.y": 1, "'": [1], "é\\\"": {"a": 2}, "rest": "r"}, {"rest": {"a": 1}}, {}, [{"a": None}], [], "a", None, 1]
    asked = [{"a": None}, {"x.y": 1.0}, {"'": [1]}, {"é\\\"": {"a": 2}}, {}, [], [{"a": None}], "a", None, 1]
    rows, pats = tables(spark, values, asked)
    got = sorted(map(tuple, payload_contains_many(rows, "v", ["k"], pats).collect()))
    assert got == [(i, j) for i, v in enumerate(values) for j, p in enumerate(asked) if holds(v, p)]


@pytest.mark.parametrize("hot", [1, 2, 8])
def test_common_leaves_are_asked_for_last(spark, monkeypatch, hot):
    monkeypatch.setattr(P, "HOT", hot)
    rng = random.Random(hot)
    values = [{"n": i % 7, "tag": rng.choice("xxxxy"), "on": i % 3 > 0, "in": [{"q": i % 11, "t": "x"}, {"q": i, "t": None}]} for i in range(80)]
    asked = [part(rng, rng.choice(values)) for _ in range(50)] + [{"tag": "x"}, {"tag": "x", "on": True}, {"tag": "z", "on": True}, {"in": [{"q": 3, "t": "x"}]}]
    rows, pats = tables(spark, values, asked)
    got = sorted(map(tuple, payload_contains_many(rows, "v", ["k"], pats).collect()))
    assert got == sorted((i, j) for i, v in enumerate(values) for j, p in enumerate(asked) if holds(v, p))


def test_rows_that_come_twice_and_nulls(spark):
    rows, pats = tables(spark, [{"a": 1}, {"a": 1, "b": "x"}], [{"a": 1}, {"b": "x"}])
    rows = rows.union(rows.limit(1)).union(spark.sql("SELECT CAST(9 AS LONG), CAST(NULL AS VARIANT)")).union(spark.sql("SELECT CAST(NULL AS LONG), parse_json('{\"a\": 1}')"))
    pats = pats.union(spark.sql("SELECT CAST(NULL AS LONG), parse_json('{\"a\": 1}')")).union(spark.sql("SELECT CAST(7 AS LONG), CAST(NULL AS VARIANT)"))
    got = {tuple(r) for r in payload_contains_many(rows, "v", ["k"], pats).collect()}
    assert got == {(0, 0), (1, 0), (1, 1)}


def test_common_numbers_leave_lists_that_have_others():
    lists = pa.array([[1, 2], [1], [], [3, 1, 4], [2, 1]], pa.list_(pa.int64()))
    got = P._without(lists.slice(1), np.array([1, 4]))
    assert got.to_pylist() == [[1], [], [3], [2]]
    assert P._without(lists, np.array([], np.int64)).to_pylist() == lists.to_pylist()
