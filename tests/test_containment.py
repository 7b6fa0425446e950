import random

import pytest
from pyspark.sql import functions as F

from docgrain.operators import anchors as A
from docgrain.operators import blocks as B
from docgrain.operators import containment as C
from docgrain.plans import QUERIES


def words(rng, n, letters="abcé"):
    return ["".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(n)]


def test_occurrences_equal_search():
    rng = random.Random(1)
    for _ in range(40):
        small = [w.encode() for w in words(rng, 30)]
        large = ["".join(words(rng, rng.randrange(6))).encode() for _ in range(30)]
        got = set(zip(*(x.tolist() for x in C.occurrences(small, large)), strict=True))
        assert got == {(i, j) for i, s in enumerate(small) for j, t in enumerate(large) if s in t}


def test_term_table_equals_brute_force(spark):
    rng = random.Random(2)
    texts = [" ".join(words(rng, rng.randrange(8), "abcÉéß")) for _ in range(150)] + ["same line"] * 60 + [None, ""]
    terms = words(rng, 60) + ["", "ab", "AB", "ab", "É", "same line", "e", "not there at all", None]
    lines = spark.createDataFrame([(i // 7, i % 7, t, i / 100) for i, t in enumerate(texts)], "doc int, line_no int, text string, confidence double")
    table = spark.createDataFrame([(t,) for t in terms], "term string").repartition(3)
    want = sorted(
        (i // 7, i % 7, term, round(i / 100, 3), t)
        for i, t in enumerate(texts)
        for term in {t for t in terms if t is not None}
        if term.lower() in (t or "").lower()
    )
    got = B.line_term_table_hits(lines, table, ["doc"]).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    firsts = {(d, t): min(n for a, n, b, _, _ in want if (a, b) == (d, t)) for d, _, t, _, _ in want}
    found = B.first_of_table_terms(lines, table, ["doc"]).collect()
    assert {(r.doc, r.term): r.line_no for r in found} == firsts
    assert B.line_term_table_hits(lines, table.limit(0), ["doc"]).collect() == []
    assert B.line_term_table_hits(lines.limit(0), table, ["doc"]).collect() == []


def test_hundred_thousand_terms_need_no_nested_loop(spark):
    rng = random.Random(3)
    vocabulary = words(rng, 3000, "abcdefghijklmnop")
    terms = {" ".join(rng.choices(vocabulary, k=2)) for _ in range(100_000)}
    texts = [" ".join(rng.choices(vocabulary, k=12)) for _ in range(3000)]
    lines = spark.createDataFrame(list(enumerate(texts)), "line_no int, text string").withColumn("confidence", F.lit(1.0))
    found = B.line_term_table_hits(lines, spark.createDataFrame([(t,) for t in terms], "term string"), [])
    got = {(r.line_no, r.term) for r in found.collect()}
    pairs = {(i, f"{a} {b}") for i, t in enumerate(texts) for a, b in zip(t.split(), t.split()[1:])}
    assert {p for p in pairs if p[1] in terms} <= got
    assert all(t in texts[i] for i, t in got)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def shuffled(spark):
    """Bytes shuffled so far in this session."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    summaries = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(summaries.apply(i).totalShuffleWrite() for i in range(summaries.size()))


@pytest.mark.parametrize("search", [B.first_of_table_terms, B.line_term_table_hits])
def test_a_line_is_not_shuffled_once_per_term(spark, search):
    rng = random.Random(5)
    vocabulary = words(rng, 400, "abcdefghijklmnopqrstuvwxyz")
    texts = [" ".join(f"{rng.choice(vocabulary)} {rng.random()}" for _ in range(500)) for _ in range(30)]
    rows = [(i // 3, i % 3, t, 1.0) for i, t in enumerate(texts)]
    lines = spark.createDataFrame(rows, "doc int, line_no int, text string, confidence double")
    table = spark.createDataFrame([(w,) for w in set(vocabulary)] + [(w.upper(),) for w in vocabulary], "term string")
    before = shuffled(spark)
    assert search(lines, table, ["doc"]).toArrow().num_rows > 3000
    assert shuffled(spark) - before < 4 * sum(map(len, texts))


@pytest.mark.parametrize("search", [B.first_of_table_terms, B.line_term_table_hits])
def test_lines_stay_where_they_are_for_some_terms(spark, search):
    rng = random.Random(6)
    vocabulary = words(rng, 300, "abcdefghijklmnopqrstuvwxyz")
    texts = [" ".join(f"{rng.choice(vocabulary)} {rng.random()}" for _ in range(300)) for _ in range(300)]
    lines = spark.createDataFrame([(i, 0, t, 1.0) for i, t in enumerate(texts)], "doc int, line_no int, text string, confidence double")
    rare = [f" {t.split()[1]} " for t in texts[:20]]
    before = shuffled(spark)
    found = search(lines, spark.createDataFrame([(w,) for w in rare], "term string"), ["doc"]).select("doc", "term")
    assert sorted(map(tuple, found.collect())) == sorted(enumerate(rare))
    # First lines meet their texts once; otherwise only terms and counts move.
    assert shuffled(spark) - before < sum(map(len, texts)) * (1.0 if search is B.first_of_table_terms else 0.1)


def test_terms_beyond_what_is_sent_equal_those_sent(spark, monkeypatch):
    rng = random.Random(7)
    lines = spark.createDataFrame(
        [(i // 5, i % 5, " ".join(words(rng, rng.randrange(9), "abÉé")), 1.0) for i in range(200)],
        "doc int, line_no int, text string, confidence double",
    )
    table = spark.createDataFrame([(w,) for w in [*words(rng, 80, "abÉ"), "", "a b", "A B"]], "term string")
    sent = sorted(map(tuple, B.line_term_table_hits(lines, table, ["doc"]).collect()))
    monkeypatch.setattr(C, "SENT", 0)
    assert sorted(map(tuple, B.line_term_table_hits(lines, table, ["doc"]).collect())) == sent
    assert len(sent) > 1000


@pytest.mark.parametrize("query", ["term_table_hits", "term_hits"])
def test_documents_of_no_characters(spark, tmp_path, query):
    docs = [(1, "x outre y\nnone", 14), (2, "", 0), (3, None, None), (4, "Outre y", None)]
    spark.createDataFrame(docs, "doc_id long, text string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("i", "Outre y"), ("j", None), ("k", "")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    term = "Outre y" if query == "term_table_hits" else "Outre"
    want = [(1, 0, term, 0.643, "x outre y"), (4, 0, term, 0.0, "Outre y")]
    assert sorted(map(tuple, QUERIES[query](spark, str(tmp_path)).collect())) == want


def test_first_lines_of_odd_tables(spark):
    rows = [(1, 1, "b", 1.0), (1, 1, "ab", 1.0), (1, 1, "ab", 1.0), (1, 0, "A", 1.0), (None, 2, "b", 1.0), (3, None, None, 1.0)]
    lines = spark.createDataFrame(rows, "doc int, line_no int, text string, confidence double")
    table = spark.createDataFrame([("a",), ("B",), ("b",), ("",), (None,)], "term string")
    found = {(r.doc, r.term, r.line_no): r.text for r in B.first_of_table_terms(lines, table, ["doc"]).collect()}
    both = found.pop((1, "b", 1)), found.pop((1, "B", 1))
    assert set(both) <= {"b", "ab"}
    assert found == {
        (1, "a", 0): "A", (1, "", 0): "A", (None, "b", 2): "b", (None, "B", 2): "b", (None, "", 2): "b", (3, "", None): None,
    }


def anchored(df):
    return sorted((r.run, r.field_ord, r.path, r.block_id) for r in df.collect())


@pytest.mark.parametrize("chunk", [1 << 20, 400])
@pytest.mark.parametrize("page", [None, 1])
def test_long_documents_equal_the_pairwise_form(spark, chunk, page, monkeypatch):
    monkeypatch.setattr(A, "FEW_PAIRS", 50)
    rng = random.Random(4)
    fields, blocks = [], []
    for run in ("r1", "r2", "r3", None):
        n = {"r1": 300, "r2": 3, "r3": 40, None: 5}[run]
        for i in range(n):
            value = rng.choice(["", " ", None, "A", *words(rng, 3, "ab12"), " ".join(words(rng, 5, "ab1"))])
            fields.append((run, i, f"f{i}", value))
        for i in range(n * 2):
            html = rng.choice(["", None, "<b>x</b>", "<p>" + " ".join(words(rng, rng.randrange(9), "ab12")) + "</p>"])
            blocks.append((run, i, rng.choice(["", None, f"b{i}", f"b{i}"]), html, "md " if i % 9 == 0 else None, i % 2))
    f = spark.createDataFrame(fields, "run string, ord long, path string, value string").repartition(3)
    b = spark.createDataFrame(blocks, "run string, ord long, block_id string, html string, markdown string, page int").repartition(4)
    runs = f.groupBy("run").agg(F.collect_list(F.struct("ord", "path", "value")).alias("fields"))
    got = anchored(A.anchors_in_chunks(f, b, "run", page, chunk))
    assert got == anchored(A.anchors_over_tables(runs, "fields", b, "run", page))
    assert len(got) > 100
    assert anchored(A.anchors_in_chunks(f.limit(0), b, "run", page, chunk)) == []


def test_one_run_of_many_blocks_is_spread_over_tasks(spark):
    rows = 20_000
    blocks = spark.range(rows).select(
        F.lit("r").alias("run"), F.col("id").alias("ord"), F.concat(F.lit("b"), "id").alias("block_id"),
        F.concat(F.lit("item no "), F.col("id") * 7919 % rows, F.lit(" of the list")).alias("html"),
        F.lit(None).cast("string").alias("markdown"), F.lit(0).alias("page"),
    )
    fields = spark.range(2000).select(
        F.lit("r").alias("run"), F.col("id").alias("ord"), F.concat(F.lit("f"), "id").alias("path"),
        F.concat(F.lit("No. "), F.col("id") + 1000, F.lit(" of")).alias("value"),
    )
    got = A.anchors_in_chunks(fields, blocks, "run", chunk=20_000)
    assert got.count() == 2000
    html = {r.block_id: r.html for r in blocks.collect()}
    assert all(f"no {int(r.path[1:]) + 1000} of" in html[r.block_id] for r in got.collect())
    lists = A._chunks(blocks.withColumnRenamed("html", "hay"), "run", "hay", 20_000, "c").groupBy("c").count().collect()
    assert len(lists) > 20 and max(r["count"] for r in lists) < 2 * rows / len(lists)
