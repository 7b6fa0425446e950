import hashlib
import re

import pytest
from edge_cases import edge_docs
from pyspark.sql import functions as F

from docgrain.llm import substrings
from docgrain.llm.slices import Layout, sliced


def brute(rows, window=20, order=None):
    """rows: (id, text) -> (id, words, removed, digest), sorted. ``order``: text -> place among the rows without id."""
    place = lambda r: r[0] if r[0] is not None else (order or {}).get(r[1], 0)
    rows = sorted(rows, key=lambda r: (r[0] is not None, place(r), r[1] is not None, r[1] or ""))
    seen, out = set(), []
    for doc, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            if key in seen:
                gone[i : i + window] = [True] * window
            seen.add(key)
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((doc, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def result(df):
    return sorted((tuple(r) for r in substrings.kept_digest(df).collect()), key=repr)


@pytest.mark.parametrize("plan", [None, Layout(1, 1), Layout(37, 6)])
def test_equals_brute_force_in_any_layout(spark, sf, plan):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert sum(w[2] for w in want) > 100
    assert result(substrings.remove_repeats(docs, plan=plan)) == want


def test_edges(spark):
    docs = edge_docs(spark)
    got = result(substrings.remove_repeats(docs))
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert result(substrings.remove_repeats(docs.limit(0))) == []


def test_repeats_at_every_shift_inside_and_across_documents(spark):
    passage = [f"p{i}" for i in range(25)]
    rows = [(i, " ".join([f"d{i}x{j}" for j in range(i)] + passage + [f"e{i}"])) for i in range(23)]
    rows.append((50, " ".join(["z"] * 70)))  # overlaps itself
    rows.append((51, " ".join([f"q{i % 21}" for i in range(90)])))  # a period above the window
    rows.append((52, " ".join(passage[:19])))  # too short
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = substrings.remove_repeats(docs)
    assert result(got) == brute(rows)
    row = got.filter("doc_id = 7").first()
    assert [(s.start, s.end) for s in row.spans] == [(7, 32)]
    assert row.kept_text.split() == [f"d7x{j}" for j in range(7)] + ["e7"]


def test_other_windows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert result(substrings.remove_repeats(docs, window=6)) == brute(rows, 6)


@pytest.mark.parametrize("plan", [None, Layout(1, 1), Layout(40, 4)])
def test_many_rows_without_id_spread_over_slices(spark, sf, plan):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id")))
    hashed = {r.text: r.h for r in docs.select("text", F.xxhash64("text").alias("h")).collect()}
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = result(substrings.remove_repeats(docs, plan=plan))
    assert got == brute(rows, order=hashed) and sum(g[2] for g in got) > 100
    sizes = [r["count"] for r in sliced(docs, "doc_id", "text", Layout(10, 3)).filter("doc_id IS NULL").groupBy("slice").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 3 * sum(sizes) / len(sizes)


def test_ids_at_the_ends_of_their_range(spark):
    passage = " ".join(f"p{i}" for i in range(30))
    rows = [(-(2**63), passage + " a"), (2**63 - 1, passage + " b"), (None, passage + " c"), (0, passage + " d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(substrings.remove_repeats(docs)) == brute(rows)
    kept = {r.doc_id: r.n_removed for r in substrings.remove_repeats(docs).collect()}
    assert kept == {None: 0, -(2**63): 30, 0: 30, 2**63 - 1: 30}
