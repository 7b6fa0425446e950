import json

from pyspark.sql import functions as F

from docgrain.functions import geometry as G
from docgrain.functions import values as V
from docgrain.operators import fields as O
from docgrain.schemas import RECORDS
from docgrain.sources.payloads import parse_extracted, parse_ocr_payload, strict_errors


def test_coerce_edited(spark):
    cases = [
        ("number", "", "null"), ("number", "12", "12"), ("number", " 1.50 ", "1.5"),
        ("number", "0x10", "16"), ("number", "   ", "0"), ("number", "1e3", "1000"),
        ("number", "Infinity", '"Infinity"'), ("number", "12 t", '"12 t"'),
        ("number", ".5", "0.5"), ("number", "5.", "5"), ("number", "-3", "-3"),
        ("boolean", "TRUE", "true"), ("boolean", "yes", '"yes"'), ("boolean", "", "null"),
        ("string", "12", '"12"'), ("string", 'a"b\\', '"a\\"b\\\\"'), ("null", "true", '"true"'),
    ]
    df = spark.createDataFrame(cases, "kind string, raw string, want string")
    rows = df.withColumn("got", V.coerce_edited(F.col("kind"), F.col("raw"))).collect()
    for r in rows:
        assert r.got == r.want, r


def test_paths(spark):
    payload = '{"a":{"b":{"c":1}},"l":[{"q":2}],"n":null,"x.y":5}'
    df = spark.createDataFrame(
        [(payload, p) for p in ["a.b.c", "a.b", "l.q", "n", "a.z", "a..b"]], "j string, p string"
    )
    got = [r.v for r in df.select(V.get_at_path(F.col("j"), F.col("p")).alias("v")).collect()]
    assert got == ["1", '{"c":1}', None, None, None, None]


def test_contains(spark):
    doc = {"a": {"b": 1, "s": "x"}, "l": [{"q": 2, "r": True}, 7, None], "n": None}
    df = spark.createDataFrame([(json.dumps(doc),)], "j string").select(
        V.as_variant(F.col("j")).alias("v")
    )
    yes = [{}, {"a": {"b": 1}}, {"l": [7]}, {"l": [{"r": True}]}, {"n": None}, {"l": [None, {"q": 2}]}]
    no = [{"a": {"b": 2}}, {"a": 1}, {"l": [8]}, {"z": None}, {"l": [{"r": False}]}, {"a": {"s": 1}}]
    assert [O.payload_contains(df, "v", p).count() for p in yes] == [1] * len(yes)
    assert [O.payload_contains(df, "v", p).count() for p in no] == [0] * len(no)


def test_flatten(spark):
    doc = {"z": "t", "l": [1, None, {"k": True}], "e": {}, "f": [], "o": {"p": {"q": 1.5}}, "s": "[x"}
    df = spark.createDataFrame([(1, json.dumps(doc))], "id int, j string").withColumn(
        "v", V.as_variant(F.col("j"))
    )
    rows = O.flatten_scalars(df, "v", ["id"], depth=3).collect()
    assert {r.path: r.value for r in rows} == {
        "z": "t", "l[0]": "1", "l[2].k": "True", "o.p.q": "1.5", "s": "[x",
    }
    try:
        O.flatten_scalars(df, "v", ["id"], depth=2).collect()
    except Exception as exc:
        assert "nested deeper" in str(exc)
    else:
        raise AssertionError("depth was ignored")


def test_split(spark):
    doc = {"rows": [{"a": 1}, {"b": [1]}], "mixed": [1, {"a": 1}], "deep": {"k": "v", "o": {"x": 1}}}
    df = spark.createDataFrame([(json.dumps(doc),)], "j string").select(
        F.lit(1).alias("id"), V.as_variant(F.col("j")).alias("v")
    )
    scalars, tables = O.split_extraction(df, "v", ["id"])
    assert {(r.path, r.value, r.leaf_type) for r in scalars.collect()} == {
        ("mixed", "1, [object Object]", "string"), ("deep.k", "v", "string"),
    }
    assert {(r.row_no, r.column, r.value) for r in tables.collect()} == {
        (0, "a", "1"), (0, "b", None), (1, "a", None), (1, "b", None),
    }


def test_strict_records(spark):
    good = {"do_number": ["1"], "items": [{"description": "d", "quantity": None}], "sold_to": None}
    cases = [
        ("delivery_order", good, []),
        ("delivery_order", {"do_numbr": ["1"]}, ["unknown:do_numbr"]),
        ("delivery_order", {"do_number": "1"}, ["type:do_number"]),
        ("delivery_order", {"do_number": None}, ["type:do_number"]),
        ("delivery_order", {"do_number": ["1", None]}, ["type:do_number"]),
        ("delivery_order", {"sold_to": 5}, ["type:sold_to"]),
        ("delivery_order", {"items": [{"desc": "x"}]}, ["unknown:items.desc"]),
        ("delivery_order", {"items": [{"quantity": 2}]}, ["type:items.*"]),
        ("delivery_order", {"items": [3]}, ["type:items"]),
        ("weighing_bill", {"net_weight": "42.40 t"}, []),
        ("petrol_bill", {"litres": True}, ["type:litres"]),
        ("memo", {}, ["unknown doc_type"]),
        ("invoice", [1], ["not an object"]),
    ]
    df = spark.createDataFrame(
        [(i, t, json.dumps(d)) for i, (t, d, _) in enumerate(cases)], "i int, t string, j string"
    )
    rows = strict_errors(df, "j", "t").orderBy("i").collect()
    assert [r.errors for r in rows] == [e for _, _, e in cases]
    record = parse_extracted(df.filter("i = 0"), "j", "delivery_order").first().record
    assert record.do_number == ["1"] and record.po_number == [] and record.total_quantity is None
    leaves = (
        parse_extracted(df.filter("i = 0"), "j", "delivery_order")
        .select(F.inline(V.record_leaves(F.col("record"), RECORDS["delivery_order"])))
        .collect()
    )
    assert [(r.path, r.value) for r in leaves] == [("do_number[0]", "1"), ("items[0].description", "d")]


def test_ocr_payload(spark):
    df = spark.createDataFrame([('{"blocks":[{"id":"x","page":2}]}',), ("[1]",), (None,)], "j string")
    rows = parse_ocr_payload(df, "j").collect()
    assert rows[0].ocr.blocks[0].page == 2 and rows[1].ocr is None and rows[2].ocr is None


def test_comparisons(spark):
    df = spark.createDataFrame([("  A  b c ", "a b c")], "a string, b string")
    a, b, null = F.col("a"), F.col("b"), F.lit(None).cast("string")
    row = df.select(
        V.normalized_match(a, b), V.normalized_match(a, null), V.normalized_match(null, null),
        V.numeric_tolerance(F.lit("12.50 t"), F.lit("12.505MT")),
        V.numeric_tolerance(F.lit("12.50"), F.lit("12.52")),
        V.numeric_tolerance(F.lit("n/a"), F.lit("n/a")),
        V.numeric_tolerance(F.lit("1_0"), F.lit("10")),
        V.list_match(F.array(F.lit(" X")), F.array(F.lit("x "))),
        V.list_match(F.array(F.lit("x")), F.array(F.lit("x"), F.lit("y"))),
    ).first()
    assert list(row) == [True, False, True, True, False, True, True, True, False]


def test_geometry(spark):
    def value(c):
        return spark.range(1).select(c.alias("v")).first().v

    w, h = F.lit(595.44), F.lit(842.04)

    def ints(*v):
        return F.array(*[F.lit(x) for x in v])

    moved = value(G.norm_box_to_bbox(ints(700, 50, 900, 80), w, h))
    assert abs(moved.l - 416.808) < 1e-9 and abs(moved.b - 67.3632) < 1e-9
    assert value(G.norm_box_to_bbox(ints(5, 0, 4, 9), w, h)) is None
    assert value(G.norm_box_to_bbox(ints(5, 0, 9), w, h)) is None
    half = G.box(F.lit(0.5), F.lit(1.5), F.lit(2.5), F.lit(3.5))
    assert value(G.bbox_to_norm_box(half, F.lit(1000.0), F.lit(1000.0))) == [0, 2, 2, 4]

    def b(*v):
        return G.box(*[F.lit(float(x)) for x in v])

    assert value(G.iou(b(0, 0, 10, 10), b(0, 0, 10, 10))) == 1.0
    assert value(G.iou(b(10, 10, 20, 20), b(30, 30, 40, 40))) == 0.0
    assert abs(value(G.iou(b(0, 0, 10, 10), b(5, 0, 15, 10))) - 1 / 3) < 1e-12
    df = spark.createDataFrame(
        [([[0.0, 0.0], [2.0, 0.0], [2.0, None], [0.0, 3.0]], [1.0, 2.0, 3.0, 4.0])],
        "polygon array<array<double>>, bbox array<double>",
    )
    quad = df.select(G.block_quad(F.col("polygon"), F.col("bbox")).alias("q")).first().q
    assert quad == [[1.0, 2.0], [3.0, 2.0], [3.0, 4.0], [1.0, 4.0]]


def test_any_depth_is_flattened(spark):
    deep = 1
    for i in range(40):
        deep = {"k": deep} if i % 2 else [None, deep]
    text = json.dumps({"deep": deep, "s": 'a"]}[{\\', "e": {}})
    df = spark.createDataFrame([(1, text), (2, "7"), (3, None)], "id int, j string").selectExpr("id", "parse_json(j) AS v")
    rows = {(r.id, r.path): r.value for r in O.flatten_scalars(df, "v", ["id"]).collect()}
    path = "deep" + ".k[1]" * 20
    assert rows == {(1, path): "1", (1, "s"): 'a"]}[{\\', (2, ""): "7"}


def test_radix_numbers_of_any_length(spark):
    import random

    rng = random.Random(1)
    cases = ["0x" + "f" * 13, "0X" + "f" * 20, "0b" + "1" * 70, "0o" + "7" * 30, "0x0000000000000000000001", "0b" + "1" * 54]
    cases += ["0x" + "".join(rng.choices("0123456789abcdef", k=rng.randint(1, 40))) for _ in range(100)]
    cases += ["0x2000000000000" + "10000001", "0x2000000000000" + "10000000", "0x2000000000000" + "30000000"]
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    from docgrain.functions.values import coerce_edited

    got = [float(r[0]) for r in df.select(coerce_edited(F.lit("number"), F.concat(F.lit("\t "), "c", F.lit("\n")))).collect()]
    assert got == [float(int(c, 0)) for c in cases]
    text = df.limit(1).select(coerce_edited(F.lit("number"), F.lit("0x" + "f" * 300)), coerce_edited(F.lit("number"), F.lit("0xg"))).first()
    assert (text[0], text[1]) == ('"0x' + "f" * 300 + '"', '"0xg"')


def test_whole_numbers_keep_their_fraction(spark):
    texts = ["18.0", "18", "-7.00", "0.0", "1.50", "1e3", '"18"', "123456789012345678901"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, j string").withColumn("v", F.try_parse_json("j"))
    got = [r.value for r in O.flatten_scalars(df, "v", ["id"], depth=0).orderBy("id").collect()]
    assert got == ["18.0", "18", "-7.0", "0.0", "1.5", "1000.0", "18", "123456789012345678901"]
