import random
from math import ceil

import pytest
from edge_cases import edge_docs

from docgrain.llm import licenses as L

LABELS = (("one", "alpha beta gamma delta"), ("two", "the quick brown fox jumps over the lazy dog"), ("three", "ß 2 µ"), ("none", " .-"))


def brute(text, templates, phrases, threshold):
    """All places and all blocks, counted one by one."""
    ws = L.lower_words(text or "")
    places = [(p, label, i) for p, label in phrases.items() for i in range(len(ws)) if L.lower_words(p) and ws[i : i + len(L.lower_words(p))] == L.lower_words(p)]
    found = []
    for label, template in templates:
        tokens = set(L.lower_words(template))
        if not tokens:
            continue
        half = L.block_words(len(L.lower_words(template)))
        for b in range(max(1, ceil(len(ws) / half) - 1)):
            block = ws[b * half : (b + 2) * half]
            common = len(tokens & set(block))
            if common >= max(1, ceil(threshold * len(tokens) - 1e-9)):
                found.append((label, template, b * half, len(block), common / len(tokens)))
    return len(ws), sorted(places, key=lambda p: (p[2], p[0])), sorted(found)


def result(df, **more):
    rows = L.scan(df, **more).collect()
    return [(r.doc_id, r.n_words, [tuple(p) for p in r.places], sorted(tuple(f) for f in r.found)) for r in rows]


@pytest.mark.parametrize("threshold", [0.3, 0.6, 0.85, 1.0])
def test_equals_brute_force(spark, threshold):
    rng = random.Random(5)
    pool = "alpha beta gamma delta the quick brown fox jumps over lazy dog ß 2 µ x1 x2 x3 x4 x5".split()
    phrases = {"alpha beta": "ab", "dog": "d", "x1 x1": "x"}
    texts = [" ".join(rng.choices(pool, k=rng.randrange(60))) + rng.choice(["", "!", "\nThe Quick, brown fox jumps over the LAZY dog"]) for _ in range(200)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = sorted(result(df, templates=LABELS, phrases=phrases, threshold=threshold))
    want = [(i, *brute(t, LABELS, phrases, threshold)) for i, t in enumerate(texts)]
    assert got == want
    assert any(r[3] for r in got)


def test_every_template_is_found_whole_and_in_part(spark):
    rows = []
    for i, (_, text) in enumerate(L.TEMPLATES):
        for shift in (0, 1, 7, 30):
            rows.append((100 * i + shift, "word " * shift + text.upper() + " tail" * 9))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r[0]: {f[0] for f in r[3]} for r in result(df)}
    for i, (label, _) in enumerate(L.TEMPLATES):
        assert all(label in found[100 * i + s] for s in (0, 1, 7, 30)), label


def test_clean_text_has_no_label(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet").filter("text not rlike '(?i)licen|CC BY|reserved'")
    assert all(not p and not f for _, _, p, f in result(df))


def test_vocabulary_compares_bytes():
    words = ["a", "ab", "abcdefgh", "abcdefghi", "abcdefghijklmnopq", "µ"]
    vocabulary = L.Vocabulary(words)
    vocabulary._hashes[:] = 0  # all words collide
    text = " ".join([*words, "abcdefgi", "b"]).encode()
    data = L.np.frombuffer(text, L.np.uint8)
    found = L.W.split(data, L.np.array([0, len(data)]), L.W.ALNUM, True)
    found.hashes = lambda: L.np.zeros(len(found.starts), L.np.uint64)
    numbers = vocabulary.numbers(found)
    assert all(n == -1 or words[n] == w for n, w in zip(numbers, [*words, "abcdefgi", "b"], strict=True))


def test_edges(spark):
    rows = [(20, "under the MIT License", "en", "a", 1), (21, "Under\tthe, mit-license CC BY-NC cc by nc", "en", "a", 1), (22, "apache license version 2", None, None, None)]
    rows += [(None, "Released under the MIT License.", None, None, None), (23, "cc by", "en", "a", 1)]
    df = edge_docs(spark).union(edge_docs(spark, rows))
    got = {r.doc_id: r for r in L.license_digest(L.scan(df)).collect()}
    assert L.scan(df).count() == df.count()
    assert (got[20].n_base, got[20].first_word, got[20].last_word, got[20].base_labels, got[20].score) == (1, 0, 0, "mit", 1.0)
    assert (got[21].n_base, got[21].first_word, got[21].last_word, got[21].base_labels) == (3, 0, 7, "cc-by-nc,mit")
    assert (got[22].base_labels, got[23].n_base, got[23].labels, got[23].score, got[23].first_word) == ("apache-2", 0, "", 0.0, None)
    assert got[None].labels == "mit"
    assert (got[2].n_words, got[3].n_words, got[2].labels) == (0, 0, "")
    assert result(df.limit(0)) == []
    assert all(not r[2] and not r[3] for r in result(df, templates=(), phrases={}))
