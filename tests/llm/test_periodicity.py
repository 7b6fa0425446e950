import hashlib
import random

from edge_cases import edge_docs
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docgrain.llm import periodicity as P


def brute(word, repeats=4, shortest=6):
    """Every stretch of equal letters q apart, for every q; smallest periods only."""
    n, out = len(word), []
    for q in range(1, n // 2 + 1):
        k = 0
        while k < n - q:
            if word[k] != word[k + q]:
                k += 1
                continue
            s = k
            while k < n - q and word[k] == word[k + q]:
                k += 1
            length = k - s + q
            smaller = any(all(word[s + t] == word[s + t + d] for t in range(length - d)) for d in range(1, q))
            if length >= max(shortest, repeats * q) and not smaller:
                out.append((s, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60))
def test_runs_of_random_words(word):
    assert P.word_runs(word) == brute(word)
    assert sorted(P.runs_of(word, 2, 2), key=lambda r: (r[0], r[2])) == brute(word, 2, 2)


def test_runs_inside_runs():
    rng = random.Random(7)
    for _ in range(300):
        word = [rng.randrange(40) for _ in range(rng.randrange(120))]
        for _ in range(rng.randrange(4)):
            if word:
                p, a = rng.randint(1, 9), rng.randrange(len(word))
                for i in range(a, rng.randint(a, len(word))):
                    word[i] = word[a + (i - a) % p]
        assert P.word_runs(word) == brute(word)


def test_link_cut_access_knows_the_last_occurrences():
    """Each path segment, against the last end of its strings found by search."""
    rng = random.Random(3)
    for _ in range(30):
        word = [rng.randrange(3) for _ in range(40)]
        longest, link, prefix = P.suffix_links(word)
        paths = P.PathColours(link)
        for i, state in enumerate(prefix):
            segments = list(paths.access(state, i))
            last = {}
            for deepest, j in segments:
                last[longest[deepest]] = j
            for size in range(1, i + 2):
                string = word[i + 1 - size : i + 1]
                ends = [e for e in range(size - 1, i) if word[e + 1 - size : e + 1] == string]
                covering = [s for s in last if s >= size]
                assert (last[min(covering)] if covering else None) == (ends[-1] if ends else None)


def test_long_runs_take_few_steps():
    word = [i % 7 for i in range(200_000)]
    assert P.word_runs(word) == [(0, 200_000, 7)]
    assert P.word_runs([0] * 100_000 + [1] * 100_000) == [(0, 100_000, 1), (100_000, 100_000, 1)]


def expected(doc_id, text, planted):
    words = (text or "").encode().split()
    if planted:
        words = P.repeat_tail(doc_id, words)
    runs = brute(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    best = P.best_run(runs)
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (
        doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
        hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(),
    )


def test_planted_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {tuple(r) for r in P.run_digest(P.find_runs(docs, rewrite=P.repeat_tail)).collect()}
    rows = docs.select("doc_id", "text").filter(F.length("text") < 6000).collect()
    assert len(rows) > 150
    want = {expected(r.doc_id, r.text, True) for r in rows}
    assert want <= got
    assert sum(r[1] for r in got) > 10


def test_edges(spark):
    rows = [(20, "a a a a a a b b", "en", "a", 1), (21, "x y x y x y x y", "en", "a", 1), (22, "x y x y x y x", "en", "a", 1)]
    rows += [(23, "ä\x1cb " * 8, "en", "a", 1), (None, "z " * 6, None, None, None), (None, "z " * 6, None, None, None)]
    df = edge_docs(spark, None).union(edge_docs(spark, rows))
    got = P.find_runs(df)
    small = df.filter("doc_id is null or doc_id <> 5")
    digests = sorted(map(repr, map(tuple, P.run_digest(P.find_runs(small)).collect())))
    assert digests == sorted(repr(expected(r.doc_id, r.text, False)) for r in small.collect())
    assert got.filter("doc_id = 5").first().n_words == 60_000
    assert got.count() == df.count()
    assert P.run_digest(P.find_runs(df.limit(0))).collect() == []
    assert got.filter("doc_id = 21").first().runs[0].asDict() == {"start": 0, "length": 8, "period": 2}
    assert got.filter("doc_id = 21").first().collapsed == "x y"
    assert got.filter("doc_id = 22").first().runs == []
