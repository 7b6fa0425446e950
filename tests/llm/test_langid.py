import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from edge_cases import edge_docs

from docgrain.llm import langid


def out_of_training(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 3 == 1


def letters(text):
    runs, run = [], ""
    for c in (text or "").lower():
        if c.isalpha():
            run += c
        elif run:
            runs.append(run)
            run = ""
    return runs + ([run] if run else [])


def brute(rows, grams=4):
    """(lang, score) per row by plain counting over all training rows."""
    train = [(t, lang) for d, t, lang in rows if lang is not None and not out_of_training(d)]
    sizes = Counter(lang for _, lang in train)
    langs = sorted(sizes, key=lambda x: (-sizes[x], x))
    tables = []
    for n in range(grams + 1):
        c = {x: Counter() for x in langs}
        for t, lang in train:
            for w in letters(t):
                c[lang].update([w] if n == 0 else [w[i : i + n] for i in range(len(w) - n + 1)])
        seen = set().union(*c.values())
        whole = {x: sum(c[x].values()) + langid.SMOOTH * max(1, len(seen)) for x in langs}
        tables.append({g: [math.log((c[x][g] + langid.SMOOTH) / whole[x]) for x in langs] for g in seen})
    out = []
    for _, t, _ in rows:
        words = letters(t)
        if not words or not langs:
            out.append(("und", 0.0))
            continue
        total = np.log(np.array([sizes[x] for x in langs]) / sum(sizes.values()))
        for w in words:
            if w in tables[0]:
                total = total + tables[0][w]
                continue
            for n in range(grams, 0, -1):
                known = [tables[n][w[i : i + n]] for i in range(len(w) - n + 1) if w[i : i + n] in tables[n]]
                if known:
                    total = total + np.mean(known, 0)
                    break
        best = int(total.argmax())
        out.append((langs[best], float(1 / np.exp(total - total[best]).sum())))
    return out


@pytest.mark.parametrize("source", ["table", "edges"])
def test_equals_brute_force(spark, sf, source):
    docs = spark.read.parquet(f"{sf}/documents.parquet") if source == "table" else edge_docs(spark)
    rows = docs.collect()
    want = brute([(r.doc_id, r.text, r.lang) for r in rows])
    want = sorted(((r.doc_id, out_of_training(r.doc_id), p, round(s, 6)) for r, (p, s) in zip(rows, want, strict=True)), key=repr)
    got = langid.identify(docs).collect()
    assert sorted(((r.doc_id, r.held_out, r.lang_pred, round(r.score, 6)) for r in got), key=repr) == want


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 300
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.99


def test_rejects_only_texts_without_letters(spark):
    docs = edge_docs(spark)
    kept = langid.keep_identified(docs)
    assert kept.columns == docs.columns
    want = sorted((r.doc_id for r in docs.collect() if letters(r.text)), key=repr)
    assert sorted((r.doc_id for r in kept.collect()), key=repr) == want
    unlabelled = docs.drop("lang").withColumn("lang", langid.F.lit(None).cast("string"))
    assert langid.keep_identified(unlabelled).count() == len(want)
    assert {r.lang_pred for r in langid.identify(unlabelled).collect()} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0
    assert langid.keep_identified(docs.limit(0)).count() == 0


def test_the_sample_bound_keeps_every_language(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(docs, "doc_id", "text", "lang", sample=5, entries=200)
    assert sorted(model.languages) == ["de", "en", "es", "fr"]
    assert all(len(k) <= 200 for k in model.keys)


def test_letters_are_unicode_letters():
    texts = ["a1b", "Δοκιμή_x", "", None, "١٢٣ ́"]
    (part,) = [p for _, _, p in langid.letter_words(pa.array(texts))]
    assert part.letters.tolist() == [2, 7, 0, 0, 0]
    assert part.words.counts().tolist() == [2, 2, 0, 0, 0]
    assert re.sub(r"[\W\d_]", "", "a1b") == "ab"
