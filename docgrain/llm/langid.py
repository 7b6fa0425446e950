"""Language identification: word frequencies first, character n-grams for unseen words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stage
from . import words as W

GRAMS = 4  # longest character n-gram
SAMPLE = 3000  # training documents per language, in expectation
LANGUAGES = 256  # most frequent languages that are learned
ENTRIES = 100_000  # words, and n-grams of each length, that the model keeps: the most frequent
SMOOTH = 0.5
UNKNOWN = "und"


@cache
def _letters() -> np.ndarray:
    """Unicode letters by code point."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@dataclass
class Letters:
    """Words (runs of letters) of consecutive texts, on the code points of the lower-cased text."""

    points: np.ndarray
    words: W.Words  # its data and places are in bytes, four to a letter
    letters: np.ndarray  # letters per text

    def word_hashes(self) -> np.ndarray:
        return self.words.hashes()

    def grams(self, size: int, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(hash, word) of every n-gram of the chosen words."""
        start, length = self.words.starts[chosen] // 4, (self.words.ends - self.words.starts)[chosen] // 4
        count = np.maximum(length - size + 1, 0)
        word = np.repeat(chosen, count)
        place = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(len(word))
        h = np.full(len(place), size, np.uint64)
        for k in range(size):
            h = h * np.uint64(0x9E3779B97F4A7C15) + self.points[place + k].astype(np.uint64)
        return W.mix(h), word


def letter_words(column) -> Iterator[tuple[int, int, Letters]]:
    """(first row, end, words) of pieces of an Arrow text column."""
    data, offsets = W.text_bytes(column)
    raw = data.tobytes()
    for lo, hi in W.pieces(offsets):
        texts = [raw[a:b].decode("utf-8", "replace").lower() for a, b in zip(offsets[lo:hi], offsets[lo + 1 : hi + 1], strict=True)]
        ends = np.r_[0, np.cumsum([len(t) for t in texts], dtype=np.int64)]
        points = np.frombuffer("".join(texts).encode("utf-32-le", "replace"), "<u4")
        inside = _letters()[points]
        begin, stop = inside.copy(), inside.copy()
        begin[1:] &= ~inside[:-1]
        stop[:-1] &= ~inside[1:]
        edges = ends[(ends > 0) & (ends < len(points))]
        begin[edges], stop[edges - 1] = inside[edges], inside[edges - 1]
        starts = np.flatnonzero(begin)
        first = np.searchsorted(starts, ends)
        words = W.Words(points.view(np.uint8), starts * 4, (np.flatnonzero(stop) + 1) * 4, first)
        seen = np.r_[0, np.cumsum(inside)]
        yield lo, hi, Letters(points, words, seen[ends[1:]] - seen[ends[:-1]])


@dataclass
class Model:
    """Log frequencies per language; table 0 holds words, table n the n-grams of length n."""

    languages: list[str]
    prior: np.ndarray
    keys: list[np.ndarray]  # sorted hashes
    logs: list[np.ndarray]  # a row per key, a column per language

    def lookup(self, table: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = self.keys[table]
        if not len(keys):
            return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
        place = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
        return place, keys[place] == hashes

    def scores(self, part: Letters) -> np.ndarray:
        """Sum over the words of a text of their log frequencies, a column per language.

        A word that is not known takes the mean over its known n-grams of the greatest length
        that has one.
        """
        sums = np.tile(self.prior, (len(part.letters), 1))
        text = part.words.text_of()
        place, known = self.lookup(0, part.word_hashes())
        self._add(sums, text[known], self.logs[0], place[known])
        left = np.flatnonzero(~known)
        for size in range(len(self.keys) - 1, 0, -1):
            if not len(left):
                break
            hashes, word = part.grams(size, left)
            place, known = self.lookup(size, hashes)
            place, word = place[known], word[known]
            n = np.bincount(word, minlength=len(text))
            self._add(sums, text[word], self.logs[size], place, 1.0 / n[word])
            left = left[n[left] == 0]
        return sums

    @staticmethod
    def _add(sums, text, logs, place, weight=None) -> None:
        for k in range(sums.shape[1]):
            values = logs[place, k] if weight is None else logs[place, k] * weight
            sums[:, k] += np.bincount(text, values, len(sums))


def held_out(id_col: str) -> Column:
    """Whether crc32 of the id as text leaves remainder 1 by 3; such rows are never learned from."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def train(
    docs: DataFrame,
    id_col: str,
    text_col: str,
    lang_col: str,
    grams: int = GRAMS,
    sample: int = SAMPLE,
    entries: int = ENTRIES,
) -> Model:
    """Fit on a bounded sample: about ``sample`` training documents of each language, by id hash.

    The sample's whole texts are counted in Spark; the ``entries`` most frequent words and n-grams of
    each length come to the driver, so the model's size is bounded by the parameters.
    """
    rows = docs.select(
        F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"), F.col(lang_col).cast("string").alias("l")
    ).filter(F.col("l").isNotNull() & ~held_out("i"))
    sizes = rows.groupBy("l").count().orderBy(F.desc("count"), "l").limit(LANGUAGES).collect()
    if not sizes:
        return Model([], np.zeros(0), [], [])
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["l"]), F.lit(min(1.0, sample / r["count"])))])
    drawn = F.pmod(F.xxhash64("i", F.lit("language sample")), F.lit(1 << 20)) < share[F.col("l")] * (1 << 20)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, lang = np.unique(np.array(batch.column(1).to_pylist(), object), return_inverse=True)
            for lo, hi, part in letter_words(batch.column(0)):
                owner = lang[lo:hi][part.words.text_of()]
                for size in range(grams + 1):
                    every = np.arange(len(owner))
                    h, word = (part.word_hashes(), every) if size == 0 else part.grams(size, every)
                    for k, name in enumerate(names):
                        keys, n = np.unique(h[owner[word] == k], return_counts=True)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([name] * len(keys), pa.string()),
                                pa.array(np.full(len(keys), size), pa.int32()),
                                pa.array(keys.view(np.int64)),
                                pa.array(n, pa.int64()),
                            ],
                            names=["l", "size", "h", "n"],
                        )

    counted = (
        rows.filter(drawn)
        .select("t", "l")
        .mapInArrow(count, "l string, size int, h long, n long")
        .groupBy("size", "h")
        .agg(
            F.sum("n").alias("all"),
            *[F.sum(F.when(F.col("l") == r["l"], F.col("n"))).alias(f"c{i}") for i, r in enumerate(sizes)],
        )
    )
    counted = stage(counted, "language-counts")
    keys, logs = [], []
    for size in range(grams + 1):
        top = counted.filter(F.col("size") == size).orderBy(F.desc("all"), "h").limit(entries).toArrow()
        h = top.column("h").to_numpy().view(np.uint64)
        c = np.stack([top.column(f"c{i}").fill_null(0).to_numpy() for i in range(len(sizes))], 1).astype(float)
        order = np.argsort(h)
        keys.append(h[order])
        logs.append(np.log((c[order] + SMOOTH) / (c.sum(0) + SMOOTH * max(1, len(h)))))
    n = np.array([r["count"] for r in sizes], float)
    return Model([r["l"] for r in sizes], np.log(n / n.sum()), keys, logs)


def predict(model: Model, part: Letters) -> tuple[np.ndarray, np.ndarray]:
    """(number of the language, posterior) per text; the number after the last one is ``und``."""
    n, some = len(part.letters), part.letters > 0
    pred, score = np.full(n, len(model.languages)), np.zeros(n)
    if model.languages:
        sums = model.scores(part)
        top = 1.0 / np.exp(sums - sums.max(1, keepdims=True)).sum(1)
        pred[some], score[some] = sums.argmax(1)[some], top[some]
    return pred, score


def keep_identified(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    model: Model | None = None,
    min_score: float = 0.0,
) -> DataFrame:
    """Rows of ``docs`` that are not ``und`` and score ``min_score`` at least, columns unchanged.

    Where no language can be learned, rows with a letter stay. See :func:`identify`.
    """
    if model is None:
        model = train(docs, id_col, text_col, lang_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for lo, hi, part in letter_words(batch.column(at)):
                score = predict(m, part)[1]
                keep[lo:hi] = (part.letters > 0) & ((score >= min_score) | (not m.languages))
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)


def identify(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    model: Model | None = None,
    grams: int = GRAMS,
    sample: int = SAMPLE,
    entries: int = ENTRIES,
) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, n_letters) of every row, from its whole text alone.

    The text is lower-cased and cut into runs of letters. A known word adds its log frequency
    in each language; an unseen word the mean of its known n-grams of ``grams`` letters, or
    of the next shorter length that has any. ``score`` is the posterior of the best language, ties go to
    the more frequent language, then by name.

    A null text, or one without a letter, is ``und`` with score 0; so is everything if no row
    has a language to learn from. A text of letters never seen takes the most frequent language. Rows without id are learned
    from and predicted. Repeated rows get the same result; an empty table gives no rows. One map over
    the rows, no shuffle; the model is sent to the tasks, its size is bounded by ``entries``.
    """
    if model is None:
        model = train(docs, id_col, text_col, lang_col, grams, sample, entries)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*shared.value.languages, UNKNOWN], object)
        for batch in batches:
            for lo, hi, part in letter_words(batch.column(2)):
                pred, score = predict(shared.value, part)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        batch.column(1).slice(lo, hi - lo),
                        pa.array(names[pred].tolist(), pa.string()),
                        pa.array(score, pa.float64()),
                        pa.array(part.letters, pa.int64()),
                    ],
                    names=["doc_id", "held_out", "lang_pred", "score", "n_letters"],
                )

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("t")
    )
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, n_letters long")
