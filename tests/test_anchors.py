import random
import re

from docgrain.operators import anchors as A

FIELDS = "array<struct<ord:bigint,path:string,value:string>>"
BLOCKS = "array<struct<id:string,html:string,markdown:string,page:int>>"


def norm(s):
    return re.sub("[^a-z0-9]+", "", s.lower())


def brute(fields, blocks, page=None):
    out = {}
    for _, path, value in fields:
        needle = norm(value)
        if len(needle) < 2:
            continue
        best = None
        for i, (bid, html, md, p) in enumerate(blocks):
            hay = norm(re.sub("<[^>]+>", " ", html or md or ""))
            if not bid or not hay or (page is not None and (-1 if p is None else p) != page - 1):
                continue
            if (needle in hay or hay in needle) and (best is None or len(hay) < best[0]):
                best = (len(hay), bid)
        if best:
            out[path] = best[1]
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    words = ["ab", "Ab-c", "x1", "x1 y", "z", "klang", "Klang, Selangor", "<b>ab</b>", "9", ""]
    docs = []
    for d in range(40):
        blocks = [
            (
                rng.choice([f"/page/{i // 3}/Text/{i}", None, ""]) if i % 5 == 4 else f"/page/{i // 3}/Text/{i}",
                " ".join(rng.choices(words, k=rng.randint(0, 3))) or None,
                rng.choice([None, "md klang"]),
                rng.choice([i // 3, i // 3, None]),
            )
            for i in range(rng.randint(0, 9))
        ]
        fields = [(i, f"f{i}", " ".join(rng.choices(words, k=rng.randint(1, 2)))) for i in range(5)]
        docs.append((d, fields, blocks))
    df = spark.createDataFrame(docs, f"doc int, fields {FIELDS}, blocks {BLOCKS}")
    table = spark.createDataFrame(
        [(d, i, *b) for d, _, bs in docs for i, b in enumerate(bs)],
        "doc int, ord int, block_id string, html string, markdown string, page int",
    ).repartition(5, "html")
    for page in (None, 1, 2):
        want = {(d, p): b for d, fs, bs in docs for p, b in brute(fs, bs, page).items()}
        inside = A.anchors_in_payload(df, "fields", "blocks", ["doc"], page).collect()
        joined = A.anchors_over_tables(df, "fields", table, "doc", page).collect()
        assert {(r.doc, r.path): r.block_id for r in inside} == want
        assert {(r.doc, r.path): r.block_id for r in joined} == want


def test_pages_and_inverse(spark):
    df = spark.createDataFrame(
        [(1, 0, "a", "/page/0/Text/1"), (1, 1, "b", "/page/0/Text/1"), (1, 2, "c", "odd")],
        "doc int, field_ord int, path string, block_id string",
    )
    assert {(r.path, r.page_no) for r in A.field_pages(df).collect()} == {("a", 1), ("b", 1)}
    rows = A.block_to_field(df, ["doc"]).collect()
    assert {(r.block_id, r.path) for r in rows} == {("/page/0/Text/1", "b"), ("odd", "c")}
