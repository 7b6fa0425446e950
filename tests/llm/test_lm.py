import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from edge_cases import edge_docs
from pyspark.sql import functions as F

from docgrain.llm import gru, lm_scoring
from docgrain.llm.slices import Layout, sliced


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def tokens(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def brute(rows):
    counts = Counter(w for d, t in rows if not held_out(d) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    out = []
    for d, t in rows:
        w = tokens(t)
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w)
        out.append((d, held_out(d), len(w), sum(counts[x] > 0 for x in w), n, round(base, 4)))
    return sorted(out, key=repr), counts


def base_part(rows):
    return sorted(
        ((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in rows), key=repr
    )


def slow_score(m, counts, text):
    """Log10 probability of one text, token by token and class by class."""
    column = pa.array([text or ""])
    hashes, tails, _ = lm_scoring.tokens(column)
    symbols, words, h, total = m.symbols(hashes, tails), tokens(text), np.zeros(m.hidden), 0.0
    n, p = len(m.head), {k: v.astype(float) for k, v in m.p.items()}
    sigmoid = lambda x: 1 / (1 + np.exp(-x))
    softmax = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    for w, s in zip(words, symbols.tolist(), strict=True):
        classes = softmax(h @ p["Wc"] + p["bc"])
        if s < n:
            c = s // m.width
            total += math.log10(classes[c]) + math.log10(softmax(h @ p["Wo"][c] + p["bo"][c])[s - c * m.width])
        else:
            mass = counts["tail"][s - n]
            total += math.log10(classes[m.groups + s - n]) + math.log10((counts["all"][w] + 1) / (mass + 1))
        x, u, k = p["E"][s] @ p["W"] + p["b"], h @ p["U"], m.hidden
        z, r = sigmoid(x[:k] + u[:k]), sigmoid(x[k : 2 * k] + u[k : 2 * k])
        h = (1 - z) * np.tanh(x[2 * k :] + r * u[2 * k :]) + z * h
    return total


@pytest.mark.parametrize("source", ["table", "edges"])
def test_equals_brute_force(spark, sf, source):
    docs = spark.read.parquet(f"{sf}/documents.parquet") if source == "table" else edge_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want, counts = brute(rows)
    model = lm_scoring.fit_model(docs, "doc_id", "text", head_words=300, epochs=1)
    got = lm_scoring.score_documents(docs, model=model, plan=Layout(5, 2)).collect()
    assert base_part(got) == want
    tail = np.zeros(gru.TAILS)
    for w, c in counts.items():
        if w is not None:
            hashes, tails, _ = lm_scoring.tokens(pa.array([w]))
            s = int(model.symbols(hashes, tails)[0])
            if s >= len(model.head):
                tail[s - len(model.head)] += c + 1
    score = {(r.doc_id, r.n_tokens): r.score for r in got}
    for d, t in sorted(rows, key=lambda r: len(r[1] or ""))[:: 7 if source == "table" else 1]:
        if len(t or "") < 50_000:
            mine = score[d, len(tokens(t))]
            assert mine == pytest.approx(slow_score(model, {"all": counts, "tail": tail}, t), rel=1e-3)


def test_beats_the_unigram_base_on_held_out_texts(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = lm_scoring.score_documents(docs).filter("held_out").toPandas()
    assert len(got) > 100
    assert got.score.sum() > 0.95 * got.base_score.sum()


def test_empty_table_and_nothing_to_learn_from(spark):
    docs = edge_docs(spark)
    assert lm_scoring.score_documents(docs.limit(0)).count() == 0
    only = docs.filter("doc_id = 2").withColumn("doc_id", lm_scoring.F.lit(next(i for i in range(99) if held_out(i))))
    row = lm_scoring.score_documents(only).first()
    assert (row.held_out, row.n_tokens, row.n_known, row.train_tokens, row.base_score) == (True, 1, 0, 0, 0.0)
    assert row.score < 0


def test_gradients_equal_finite_differences():
    rng = np.random.default_rng(1)
    hashes = rng.integers(1, 12, 160).astype(np.uint64)
    hashes[::9] = gru.END
    first = np.r_[0, np.flatnonzero(hashes == gru.END) + 1]
    tails = (hashes % np.uint64(5)).astype(np.uint8)
    m = gru.fit(hashes, tails, first, head_words=6, hidden=4, embed=3, epochs=1)
    m.p = {k: v.astype(np.float64) + rng.normal(0, 0.1, v.shape) for k, v in m.p.items()}
    symbols = m.symbols(hashes[:24], tails[:24]).reshape(8, 3)
    fresh = np.zeros((8, 3), bool)
    fresh[4, 1] = True
    h0 = rng.normal(0, 0.3, (3, 4))

    def loss():
        h, total = h0, 0.0
        for t in range(8):
            h = h * ~fresh[t][:, None]
            total -= m.log_probs(h, symbols[t]).sum()
            h = m.advance(h, m.step_table()[symbols[t]])
        return total / symbols.size

    grads, _ = gru._window_grads(m, symbols, fresh, h0)
    for name in ("E", "W", "b", "U", "Wc", "bc", "Wo", "bo"):
        flat, g = m.p[name].reshape(-1), grads[name].reshape(-1)
        for i in rng.choice(len(flat), min(6, len(flat)), replace=False):
            old = flat[i]
            flat[i] = old + 1e-5
            up = loss()
            flat[i] = old - 1e-5
            down = loss()
            flat[i] = old
            assert g[i] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def test_probabilities_of_all_symbols_sum_to_one():
    rng = np.random.default_rng(2)
    hashes = rng.integers(1, 50, 500).astype(np.uint64)
    m = gru.fit(hashes, (hashes % np.uint64(16)).astype(np.uint8), np.array([0, 500]), head_words=20)
    states = rng.normal(0, 1, (3, m.hidden)).astype(np.float32)
    n = len(m.head) + gru.TAILS
    for s in states:
        every = np.arange(n)
        assert np.exp(m.log_probs(np.repeat(s[None], n, 0), every)).sum() == pytest.approx(1, abs=1e-4)


def test_words_and_weights_come_from_all_training_rows(spark):
    """More rows than a sample of 1,024, in several tasks, and a text of over 64 KiB with words of its own."""
    rows = [(i, f"common word{i % 7} rest{i}") for i in range(3000) if not held_out(i)]
    long_id = next(i for i in range(3000, 3100) if not held_out(i))
    rows.append((long_id, "longtextword other " * 10_000))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3, "doc_id")
    counts = Counter(w for _, t in rows for w in tokens(t))
    hashes = {w: int(lm_scoring.tokens(pa.array([w]))[0][0]) for w in counts if w is not None} | {None: int(gru.END)}
    learned = lm_scoring.learned_rows(docs, "doc_id", "text")
    head, n, rest = lm_scoring.count_words(learned, 3, 12)
    want = sorted(((hashes[w], c) for w, c in counts.items()), key=lambda x: -x[1])
    assert sorted(n.tolist(), reverse=True) == n.tolist() == [c for _, c in want[:12]]
    assert set(want[:11]) <= set(zip(head.tolist(), n.tolist(), strict=True))
    assert n.sum() + rest.sum() == sum(counts.values())

    model = gru.start(head, n, rest)
    seen = 0
    for k in range(lm_scoring.ROUNDS):
        new, found = lm_scoring.train_round(learned.filter(learned["round"] == k), model, 0.01)
        assert found and all((new.p[x] != model.p[x]).any() for x in model.p)
        model, seen = new, seen + found
    assert seen == sum(counts.values())
    score = {r.doc_id: r.score for r in lm_scoring.score_documents(docs, model=model).collect()}
    before = {r.doc_id: r.score for r in lm_scoring.score_documents(docs, model=gru.start(head, n, rest)).collect()}
    assert score[long_id] > 0.8 * before[long_id]


def test_tokens_that_fill_up_the_streams_count_for_nothing():
    rng = np.random.default_rng(3)
    m = gru.start(np.r_[np.arange(1, 6).astype(np.uint64), gru.END], np.full(6, 2), np.zeros(gru.TAILS), 4, 3)
    m.p = {k: v + rng.normal(0, 0.1, v.shape) for k, v in m.p.items()}
    symbols, fresh, h = rng.integers(0, 6, (5, 1)), np.zeros((5, 1), bool), np.zeros((1, 4))
    want, _ = gru._window_grads(m, symbols, fresh, h)
    more = np.r_[symbols, rng.integers(0, 6, (2, 1))]
    got, _ = gru._window_grads(m, more, np.zeros((7, 1), bool), h, np.arange(7)[:, None] < 5)
    assert all(np.allclose(got[k], want[k], atol=1e-6) for k in want)


def test_rows_without_id_spread_over_slices(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("doc_id", F.lit(None).cast("long"))
    sizes = [r["count"] for r in sliced(docs, "doc_id", "text", Layout(10, 3), by_text=True).groupBy("slice").count().collect()]
    assert len(sizes) == 10 and max(sizes) < 3 * sum(sizes) / len(sizes)


def test_rows_far_below_the_others_keep_their_probability():
    logits = np.array([[300.0, 299.0, -50.0], [-300.0, -301.0, -299.5]], np.float32)
    at = np.array([1, 2])
    want = logits.astype(float) - np.log(np.exp(logits.astype(float) - logits.max(1, keepdims=True)).sum(1, keepdims=True)) - logits.max(1, keepdims=True)
    assert np.allclose(gru._log_pick(logits, at), want[[0, 1], at], atol=1e-4)
    grad = np.exp(want)
    grad[[0, 1], at] -= 1
    assert np.allclose(gru._softmax_grad(logits, at, np.array([0.5, 0.25], np.float32)), grad * [[0.5], [0.25]], atol=1e-5)


def test_hashes_are_numbered_as_by_sorting():
    hashes = np.random.default_rng(1).choice(np.array([7, 1 << 63, 3, (1 << 64) - 1], np.uint64), 50)
    kinds, number = lm_scoring.numbered(hashes)
    assert (kinds[number] == hashes).all() and (np.diff(kinds.astype(float)) > 0).all()
    assert len(lm_scoring.numbered(hashes[:0])[0]) == 0
    assert (lm_scoring.of_kinds(number, hashes, len(kinds)) == kinds).all()


def test_texts_together_score_as_one_by_one():
    """Streams, blocks of logits and shrinking sets of running texts change nothing but roundings."""
    rng = np.random.default_rng(5)
    lengths = np.r_[1, 3, 700, rng.integers(1, 60, 90)]
    hashes = rng.integers(1, 90, lengths.sum()).astype(np.uint64)
    first = np.r_[0, np.cumsum(lengths)]
    hashes[first[1:] - 1] = gru.END
    tails = (hashes % np.uint64(16)).astype(np.uint8)
    m = gru.fit(hashes, tails, first, head_words=40, epochs=1)
    symbols = m.symbols(hashes, tails)
    for cells in (64, 16384):
        got = m.text_scores(symbols, first, cells)
        for d, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
            h, want = np.zeros((1, m.hidden)), 0.0
            for t in range(a, b):
                want += float(m.log_probs(h, symbols[t : t + 1])[0])
                h = m.advance(h, m.step_table()[symbols[t : t + 1]])
            assert got[d] == pytest.approx(want, rel=1e-4, abs=1e-4)
    assert len(m.text_scores(symbols[:0], np.zeros(1, np.int64))) == 0
    empty = np.zeros((0, m.hidden), np.float32)
    assert len(m.log_probs(empty, symbols[:0])) == 0
