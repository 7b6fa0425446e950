import hashlib
import re

import pytest
from edge_cases import edge_docs

from docgrain.llm import contamination


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(docs, bench, window=10):
    windows = {}
    for item, text in bench:
        w = words_of(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(item)
    sizes = {len(k) for k in windows}
    out = []
    for doc, text in docs:
        w, hit, items = words_of(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit.update(range(i, i + n))
                    items |= windows[tuple(w[i : i + n])]
        names = sorted({str(i) for i in items if i is not None})
        out.append((doc, len(w), len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def result(df):
    columns = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    return sorted((tuple(r) for r in contamination.contamination_digest(df).select(*columns).collect()), key=repr)


@pytest.mark.parametrize("limit", [1 << 25, 9000])  # one block, and several
def test_equals_brute_force(spark, sf, limit):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert any(w[-1] for w in want)
    got = contamination.find_contamination(docs, bench, bench_bytes=limit)
    assert result(got) == want
    clean = {r.doc_id for r in contamination.decontaminate(docs, bench, bench_bytes=limit).collect()}
    assert clean == {w[0] for w in want if not w[-1]}


BENCH = [
    (1, "the lazy dog"),  # shorter than a window
    (2, " ".join(f"shared{i}" for i in range(5, 28))),
    (2, "läuft weg"),
    (None, "brown fox"),
    (4, None),
    (5, "!! --"),
    (6, "word that is nowhere else"),
    (7, " ".join(f"w{i}x{i}" for i in range(12))),
]


@pytest.mark.parametrize("limit", [1 << 25, 60])
def test_edges(spark, limit):
    docs = edge_docs(spark)
    bench = spark.createDataFrame(BENCH, "item_id long, text string")
    found = contamination.find_contamination(docs, bench, bench_bytes=limit)
    assert result(found) == brute([(r.doc_id, r.text) for r in docs.collect()], BENCH)
    kept = contamination.decontaminate(docs, bench, bench_bytes=limit)
    assert kept.columns == docs.columns
    assert kept.count() == sum(not w[-1] for w in brute([(r.doc_id, r.text) for r in docs.collect()], BENCH))
    assert result(contamination.find_contamination(docs.limit(0), bench)) == []
    none = contamination.find_contamination(docs, bench.limit(0))
    assert {r[2] for r in result(none)} == {0}


def test_matches_are_maximal_and_placed(spark):
    item = " ".join(f"a{i}" for i in range(40))
    text = "x y " + " ".join(f"a{i}" for i in range(3, 30)) + " z " + " ".join(f"a{i}" for i in range(20, 40))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    bench = spark.createDataFrame([(9, item)], "item_id long, text string")
    row = contamination.find_contamination(docs, bench).first()
    assert [(m.start, m.length, m.item_id, m.item_start) for m in row.matches] == [(2, 27, "9", 3), (30, 20, "9", 20)]
    assert (row.n_hit, row.longest) == (47, 27)
