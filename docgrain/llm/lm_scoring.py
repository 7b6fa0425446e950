"""Document log-likelihood under a gated recurrent language model and a smoothed unigram base."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from . import gru
from . import words as W
from .gru import END, TAILS, Gru
from .slices import Layout, by_bucket, layout, sliced

ROUNDS = 4  # parts of the training rows, learned from one after the other
CHUNK = 1 << 19  # tokens a task lays out at a time
STREAMS = 256
WINDOW = 32
UPDATES = 64  # of the weights in a chunk, at least; a small chunk has fewer streams for it
HELD_WORDS = 1 << 20  # distinct words a task holds before it sends their counts
PIECE = 2048  # weights in one message
LANES = 64  # first sums of the messages of one piece

_COUNTS = "bucket int, slice int, hashes binary, counts binary, tails binary"
_WEIGHTS = "piece int, lane int, n long, data binary"
_TOTALS = "slice int, bucket int, counts binary, stats array<long>"
_SCORES = (
    "doc_id long, held_out boolean, n_tokens long, n_known long, base_sum double, model_sum double, "
    "tail_tokens array<long>"
)


def held_out(id_col: str) -> Column:
    """Whether crc32 of the id as text leaves remainder 2 by 7; such rows are never learned from."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 7 == 2


def tokens(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, tail classes, first) of the tokens of consecutive texts: words, then END."""
    hashes, tails, counts = [], [], []
    for _, _, words in W.split_pieces(column, W.NOT_SPACE, True):
        last = words.data[words.ends - 1]
        before = np.where(words.ends - words.starts > 1, words.data[np.maximum(words.ends - 2, 0)], 0)
        at = words.first[1:]
        hashes.append(np.insert(words.hashes(), at, END))
        tails.append(np.insert(gru.tail_class(last, before), at, 0))
        counts.append(words.counts() + 1)
    if not counts:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return np.concatenate(hashes), np.concatenate(tails), np.r_[0, np.cumsum(np.concatenate(counts))]


def numbered(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct hashes, sorted; the number of each hash among them); only the distinct ones are sorted."""
    coded = pa.array(hashes).dictionary_encode()
    kinds = coded.dictionary.to_numpy()
    order = np.argsort(kinds)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return kinds[order], rank[coded.indices.to_numpy()]


def of_kinds(number: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """The value of each of ``n`` distinct hashes, where equal hashes have equal values."""
    out = np.empty(n, values.dtype)
    out[number] = values
    return out


def learned_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(t, round) of all training rows."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    order = F.xxhash64(F.lit("lm round"), F.col(id_col).cast("string"), text)
    return docs.filter(~held_out(id_col)).select(text.alias("t"), F.pmod(order, F.lit(ROUNDS)).alias("round"))


def count_words(rows: DataFrame, bits: int, head_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(head, counts, tail_counts): END and the most frequent other words of all texts ``t``, the most
    frequent first, and the sum of the other words' counts in each tail class.

    A task sends its distinct words with their counts to the words' buckets; a bucket puts out its own
    most frequent words and sums, so only these are ordered.
    """

    def merged(h: list, n: list, tail: list):
        h, n, tail = (np.concatenate(x) for x in (h, n, tail))
        kinds, number = numbered(h)
        return kinds, np.bincount(number, n, len(kinds)).astype(np.int64), of_kinds(number, tail, len(kinds))

    def send(kinds, n, tail) -> pa.RecordBatch:
        names, edges = by_bucket((kinds >> np.uint64(64 - bits)).astype(np.int64))
        parts = [[x[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:], strict=True)] for x in (kinds, n, tail)]
        arrays = [pa.array(names, pa.int32()), *(pa.array(x, pa.binary()) for x in parts)]
        return pa.RecordBatch.from_arrays(arrays, names=["bucket", "hashes", "counts", "tails"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            hashes, tails, _ = tokens(batch.column(0))
            new = merged([hashes], [np.ones(len(hashes))], [tails])
            held = new if held is None else merged(*zip(held, new, strict=True))
            if len(held[0]) >= HELD_WORDS:
                yield send(*held)
                held = None
        if held is not None:
            yield send(*held)

    def most(table: pa.Table) -> pa.Table:
        read = lambda c, kind: [np.frombuffer(x, kind) for x in table.column(c).to_pylist()]
        kinds, n, tail = merged(read("hashes", np.uint64), read("counts", np.int64), read("tails", np.uint8))
        top = np.lexsort((kinds, -n, kinds != END))[:head_words]
        sums = np.bincount(tail, n, TAILS).astype(np.int64)
        h = pa.array([*kinds[top].view(np.int64).tolist(), *[None] * TAILS], pa.int64())
        return pa.table({"h": h, "n": pa.array(np.r_[n[top], sums]), "tail": pa.array(np.r_[tail[top], np.arange(TAILS)], pa.int32())})

    sent = rows.select("t").mapInArrow(count, "bucket int, hashes binary, counts binary, tails binary")
    words = stage(sent.groupBy("bucket").applyInArrow(most, "h long, n long, tail int"), "lm-words")
    end = F.col("h") == int(END.view(np.int64))
    top = words.filter("h IS NOT NULL").orderBy(end.desc(), F.col("n").desc(), "h").limit(head_words).toArrow()
    h, n, tail = (top.column(i).to_numpy() for i in range(3))
    head, n = (h.view(np.uint64), n) if len(h) else (np.array([END]), np.zeros(1, np.int64))
    sums = np.zeros(TAILS, np.int64)
    for r in words.filter("h IS NULL").groupBy("tail").agg(F.sum("n").alias("n")).collect():
        sums[r["tail"]] = r["n"]
    if len(tail):
        sums -= np.bincount(tail, n, TAILS).astype(np.int64)
    order = np.lexsort((head, -n))
    return head[order], n[order], sums


def train_round(rows: DataFrame, model: Gru, rate: float) -> tuple[Gru, int]:
    """(model, tokens): each task learns from all its texts ``t``, beginning with ``model``; the new weights
    are the mean of the tasks' weights by their tokens.

    A task holds a few chunks of tokens at a time, so texts of any length are learned from. The mean is
    summed up by pieces in two steps; one set of weights comes to the driver.
    """
    shared = rows.sparkSession.sparkContext.broadcast(model)
    names = sorted(model.p)

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trainer, seen = gru.Trainer(shared.value), 0
        symbols, begins = np.zeros(0, np.int32), np.zeros(0, bool)

        def learn(s: np.ndarray, b: np.ndarray) -> None:
            streams = min(STREAMS, len(s) // (WINDOW * UPDATES))
            trainer.learn(s, b, streams, WINDOW, rate)

        for batch in batches:
            hashes, tails, first = tokens(batch.column(0))
            fresh = np.zeros(len(hashes), bool)
            fresh[first[:-1]] = True
            symbols, begins = np.append(symbols, trainer.model.symbols(hashes, tails)), np.append(begins, fresh)
            seen += len(hashes)
            at = 0
            while len(symbols) - at >= 2 * CHUNK:
                learn(symbols[at : at + CHUNK], begins[at : at + CHUNK])
                at += CHUNK
            symbols, begins = symbols[at:], begins[at:]
        learn(symbols, begins)
        if seen:
            flat = np.concatenate([trainer.model.p[k].ravel() for k in names])
            parts = [flat[i : i + PIECE].tobytes() for i in range(0, len(flat), PIECE)]
            lane = TaskContext.get().partitionId() % LANES
            columns = [range(len(parts)), [lane] * len(parts), [seen] * len(parts), parts]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.binary()]
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["piece", "lane", "n", "data"])

    def mean(table: pa.Table) -> pa.Table:
        n, total = table.column("n").to_numpy(), 0.0
        for k in np.lexsort((table.column("data").to_pylist(), n)).tolist():
            total = total + np.frombuffer(table.column("data")[k].as_py(), np.float32).astype(float) * n[k]
        data = (total / n.sum()).astype(np.float32).tobytes()
        return table.slice(0, 1).set_column(2, "n", pa.array([int(n.sum())])).set_column(3, "data", pa.array([data], pa.binary()))

    sent = rows.select("t").mapInArrow(train, _WEIGHTS)
    sums = sent.groupBy("piece", "lane").applyInArrow(mean, _WEIGHTS).groupBy("piece").applyInArrow(mean, _WEIGHTS)
    found = sums.toArrow().sort_by("piece")
    shared.destroy()
    if not found.num_rows:
        return model, 0
    flat = np.frombuffer(b"".join(found.column("data").to_pylist()), np.float32)
    ends = np.cumsum([model.p[k].size for k in names])[:-1]
    p = {k: x.reshape(model.p[k].shape).copy() for k, x in zip(names, np.split(flat, ends), strict=True)}
    return replace(model, p=p), found.column("n")[0].as_py()


def fit_model(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    head_words: int = 2000,
    epochs: int = 1,
    rate: float = 0.01,
    plan: Layout | None = None,
    **options,
) -> Gru:
    """Fit the recurrent model on all training rows.

    Head words and output biases come from the counts over all of them. The weights are learned in
    ``ROUNDS`` rounds, each over another part of the rows (by a hash of id and text), so every token is
    learned from once in an epoch; see :func:`train_round`. The weights depend on how the input is
    split into tasks, as those of any training in parallel do.
    """
    rows = learned_rows(docs, id_col, text_col)
    plan = plan or layout(docs, text_col)
    model = gru.start(*count_words(rows, plan.bits, head_words), **options)
    for k in range(epochs * ROUNDS):
        model, _ = train_round(rows.filter(F.col("round") == k % ROUNDS), model, rate / (1 + k))
    return model


def score_documents(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    model: Gru | None = None,
    plan: Layout | None = None,
    **options,
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row.

    Tokens are runs of other characters than white space, A-Z in lower case, then one end.
    ``base_score`` sums log10((c + 1) / (N + V + 1)) with counts over all training rows.
    ``score`` is the log10 probability of the whole text under the recurrent model: head words by its factored
    softmax, other words by the probability of their tail class times (c + 1) / (N_k + V_k + 1),
    counts within the class.

    Counts cover every training row. Each slice of texts sends its distinct words with their counts to the
    words' buckets and gets the totals back; the texts are shuffled once, see :mod:`.slices`. The weights
    are learned from all training rows first (:func:`fit_model`) and sent to the tasks.

    A null text is empty: one token, the end. Repeated rows count each and score alike; rows
    without id are learned from. With nothing to learn from, N is 0 and all classes are equally
    likely. An empty table gives no rows. Only the two named columns are read.
    """
    plan = plan or layout(docs, text_col)
    if model is None:
        model = fit_model(docs, id_col, text_col, plan=plan, **options)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    bits = np.uint64(plan.bits)
    rows = sliced(docs, id_col, text_col, plan, held_out(id_col).alias("held_out"), by_text=True)

    def distinct(hashes: np.ndarray, tails: np.ndarray):
        """Distinct hashes, sorted by bucket, with their tail classes, and each token's number among them."""
        kinds, number = numbered(hashes)
        names, edges = by_bucket((kinds >> (np.uint64(64) - bits)).astype(np.int64))
        return kinds, of_kinds(number, tails, len(kinds)), number, names, list(zip(edges[:-1], edges[1:], strict=True))

    def count(table: pa.Table) -> pa.Table:
        hashes, tails, first = tokens(table.column("t"))
        learn = np.repeat(~table.column("held_out").to_numpy(), np.diff(first))
        kinds, tail, number, names, cuts = distinct(hashes, tails)
        n = np.bincount(number[learn], minlength=len(kinds)).astype(np.uint32)
        part = lambda x: pa.array([x[a:b].tobytes() for a, b in cuts], pa.binary())
        return pa.table(
            {
                "bucket": pa.array(names, pa.int32()),
                "slice": pa.array([table.column("slice")[0].as_py()] * len(names), pa.int32()),
                "hashes": part(kinds),
                "counts": part(n),
                "tails": part(tail),
            }
        )

    def total(table: pa.Table) -> pa.Table:
        read = lambda c, kind: [np.frombuffer(x, kind) for x in table.column(c).to_pylist()]
        parts = read("hashes", np.uint64)
        h, n, tail = np.concatenate(parts), np.concatenate(read("counts", np.uint32)), np.concatenate(read("tails", np.uint8))
        kinds, first, number = np.unique(h, return_index=True, return_inverse=True)
        sums = np.bincount(number, n, len(kinds)).astype(np.int64)
        m = shared.value
        symbol = m.symbols(kinds, tail[first]) - len(m.head)
        known = (symbol >= 0) & (sums > 0)
        stats = [
            int(sums.sum()),
            int((sums > 0).sum()),
            *np.bincount(symbol[known], sums[known], TAILS).astype(np.int64).tolist(),
            *np.bincount(symbol[known], minlength=TAILS).tolist(),
        ]
        ends = np.cumsum([len(p) for p in parts])
        return pa.table(
            {
                "slice": table.column("slice").cast(pa.int32()),
                "bucket": table.column("bucket").cast(pa.int32()),
                "counts": pa.array([sums[number[e - len(p) : e]].tobytes() for e, p in zip(ends, parts, strict=True)], pa.binary()),
                "stats": pa.array([stats] + [None] * (len(parts) - 1), pa.list_(pa.int64())),
            }
        )

    def score(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.table([pa.array([], f.type) for f in _SCHEMA], schema=_SCHEMA)
        m = shared.value
        hashes, tails, first = tokens(texts.column("t"))
        kinds, tail, number, names, _ = distinct(hashes, tails)
        said = dict(zip(answers.column("bucket").to_pylist(), answers.column("counts").to_pylist(), strict=True))
        c = np.concatenate([np.frombuffer(said[b], np.int64) for b in names.tolist()])
        symbol = m.symbols(kinds, tail)
        text, docs = np.repeat(np.arange(len(first) - 1), np.diff(first)), len(first) - 1
        log_c = np.log10(c + 1.0)
        tail = symbol - len(m.head)
        mine = tail[number] >= 0
        found = m.text_scores(symbol[number], first) / np.log(10)
        cells = np.bincount(text[mine] * TAILS + tail[number][mine], minlength=docs * TAILS).reshape(docs, TAILS)
        return pa.table(
            [
                texts.column("doc_id"),
                texts.column("held_out"),
                pa.array(np.diff(first), pa.int64()),
                pa.array(np.bincount(text, c[number] > 0, docs).astype(np.int64)),
                pa.array(np.bincount(text, log_c[number], docs)),
                pa.array(found + np.bincount(text[mine], log_c[number][mine], docs)),
                pa.array(cells.tolist(), pa.list_(pa.int64())),
            ],
            schema=_SCHEMA,
        )

    counted = rows.groupBy("slice").applyInArrow(count, _COUNTS)
    totals = counted.groupBy("bucket").applyInArrow(total, _TOTALS)
    scored = rows.groupBy("slice").cogroup(totals.select("slice", "bucket", "counts").groupBy("slice")).applyInArrow(score, _SCORES)
    stat = lambda i: F.coalesce(F.sum(F.col("stats")[i]), F.lit(0))
    summed = totals.filter("stats IS NOT NULL").agg(
        F.struct(
            stat(0).alias("n"),
            F.log10((stat(0) + stat(1) + 1).cast("double")).alias("all"),
            F.array(*[F.log10((stat(2 + k) + stat(2 + TAILS + k) + 1).cast("double")) for k in range(TAILS)]).alias("tails"),
        ).alias("s")
    )
    scored = scored.withColumn("s", summed.scalar())
    spread = F.aggregate(
        F.zip_with("tail_tokens", F.col("s.tails"), lambda n, z: n * z), F.lit(0.0), lambda a, x: a + x
    )
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.col("s.n").alias("train_tokens"),
        (F.col("base_sum") - F.col("n_tokens") * F.col("s.all")).alias("base_score"),
        (F.col("model_sum") - spread).alias("score"),
    )


_SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("held_out", pa.bool_()),
        ("n_tokens", pa.int64()),
        ("n_known", pa.int64()),
        ("base_sum", pa.float64()),
        ("model_sum", pa.float64()),
        ("tail_tokens", pa.list_(pa.int64())),
    ]
)
