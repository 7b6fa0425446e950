"""Periodic runs of words: suffix automaton, last occurrences by link-cut access, squares extended to runs."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHORTEST = 6  # words
REPEATS = 4  # periods
OUT_BYTES = 4 << 20

_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
_RESULT = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


# ---- suffix automaton and its link tree ------------------------------------------------------------


def suffix_links(word: list[int]) -> tuple[list[int], list[int], list[int]]:
    """(longest, link, prefix): per state the length of its longest string and its suffix link (-1 at the
    root), and the state of each prefix of ``word``."""
    longest, link, edges, prefix = [0], [-1], [{}], []
    last = 0
    for letter in word:
        state = len(longest)
        longest.append(longest[last] + 1)
        link.append(0)
        edges.append({})
        at = last
        while at >= 0 and letter not in edges[at]:
            edges[at][letter] = state
            at = link[at]
        if at >= 0:
            to = edges[at][letter]
            if longest[to] == longest[at] + 1:
                link[state] = to
            else:
                split = len(longest)
                longest.append(longest[at] + 1)
                link.append(link[to])
                edges.append(dict(edges[to]))
                link[to] = link[state] = split
                while at >= 0 and edges[at].get(letter) == to:
                    edges[at][letter] = split
                    at = link[at]
        prefix.append(state)
        last = state
    return longest, link, prefix


class PathColours:
    """Link tree whose root paths are recoloured by link-cut access.

    A preferred path is a splay tree keyed by depth. All its nodes have one colour, kept at the root
    of the splay tree: the last position whose access went through them. States are numbered
    from 1 here, 0 is no state.
    """

    def __init__(self, link: list[int]):
        self.up = [0, *(p + 1 for p in link)]
        self.shallow = [0] * len(self.up)
        self.deep = [0] * len(self.up)
        self.colour = [-1] * len(self.up)

    def _lift(self, x: int) -> None:
        """Rotate x above its parent in the splay tree."""
        up, shallow, deep = self.up, self.shallow, self.deep
        p = up[x]
        g = up[p]
        if shallow[p] == x:
            c = deep[x]
            shallow[p], deep[x] = c, p
        else:
            c = shallow[x]
            deep[p], shallow[x] = c, p
        if c:
            up[c] = p
        if shallow[g] == p:
            shallow[g] = x
        elif deep[g] == p:
            deep[g] = x
        else:
            self.colour[x] = self.colour[p]
        up[p], up[x] = x, g

    def _splay(self, x: int) -> None:
        up, shallow, deep = self.up, self.shallow, self.deep
        while True:
            p = up[x]
            if not p or (shallow[p] != x and deep[p] != x):
                return
            g = up[p]
            if g and (shallow[g] == p or deep[g] == p):
                self._lift(p if (shallow[g] == p) == (shallow[p] == x) else x)
            self._lift(x)

    def access(self, state: int, colour: int) -> Iterator[tuple[int, int]]:
        """Recolour the path from ``state`` to the root. Yields, from the deep end, (deepest state,
        former colour) of each coloured path segment that it meets."""
        up, shallow, deep, colours = self.up, self.shallow, self.deep, self.colour
        x, below = state + 1, 0
        while x:
            self._splay(x)
            former = colours[x]
            if deep[x]:
                colours[deep[x]] = former
            if former >= 0:
                yield x - 1, former
            deep[x] = below
            below, x = x, up[x]
        colours[below] = colour


def runs_of(word: list[int], repeats: int = REPEATS, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs: stretches of smallest period q and at least ``repeats`` periods and
    ``shortest`` letters that no neighbouring letter extends.

    When letter i is appended, a segment of last occurrence j on the path of prefix i holds strings of up to
    its length that end at i and, before that, at j. If the distance i - j is no greater, a square of that
    period ends at i. The first square found of a run is extended to the whole run; later squares
    of the run end inside it. A square found this way has its root's own smallest period: the last
    occurrence of a string of a period or more lies one smallest period back.
    """
    longest, link, prefix = suffix_links(word)
    paths = PathColours(link)
    done: dict[int, int] = {}  # period -> end of its latest run or shorter repetition
    found, n = [], len(word)
    for i, state in enumerate(prefix):
        for deepest, j in paths.access(state, i):
            q = i - j
            if q > longest[deepest] or done.get(q, -1) >= i:
                continue
            end = i + 1
            while end < n and word[end] == word[end - q]:
                end += 1
            start = i - 2 * q + 1
            while start > 0 and word[start - 1] == word[start - 1 + q]:
                start -= 1
            done[q] = end - 1
            if end - start >= max(shortest, repeats * q):
                found.append((start, end - start, q))
    return found


def stretches(ids: np.ndarray, repeats: int, shortest: int) -> list[tuple[int, int]]:
    """Stretches that hold every run whole, by a test that no run fails.

    A run of period q and at least 4 q letters, 6 at least, consists of triples that each occur three times in it.
    So a letter in no triple that occurs three times in its stretch parts two stretches; this is repeated until
    nothing changes. Triples are compared by a hash, so a collision keeps a letter too many at worst.
    """
    n = len(ids)
    if n < shortest:
        return []
    if repeats < 4 or shortest < 6:
        return [(0, n)]
    x = ids.astype(np.uint64)
    a, b = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    triple = (x[:-2] * a + x[1:-1]) * b + x[2:]
    at = np.arange(n - 2)  # starts of the triples left
    part = np.zeros(n, np.int64)
    while True:
        order = np.lexsort((triple[at], part[at]))
        key, of = triple[at][order], part[at][order]
        edge = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (of[1:] != of[:-1])])
        times = np.diff(np.r_[edge, len(key)])
        often = np.zeros(n - 2, bool)
        often[at[order]] = np.repeat(times >= 3, times)
        kept = np.zeros(n, bool)
        for k in range(3):
            kept[k : n - 2 + k] |= often
        # A stretch also ends between two letters that no triple left spans.
        joined = np.zeros(n, bool)
        joined[1 : n - 1] |= often
        joined[2:] |= often
        first = np.flatnonzero(kept & ~joined)
        stop = np.flatnonzero(kept & ~np.r_[joined[1:], False]) + 1
        long = stop - first >= shortest
        first, stop = first[long], stop[long]
        part = np.zeros(n, np.int64)
        part[first] = 1
        part = np.cumsum(part)
        inside = np.zeros(n + 1, np.int64)
        inside[first] += 1
        inside[stop] -= 1
        inside = np.cumsum(inside)[:n].astype(bool)
        left = np.flatnonzero(often & inside[: n - 2] & inside[2:])
        if len(left) == len(at):
            return list(zip(first.tolist(), stop.tolist(), strict=True))
        at = left
        if not len(at):
            return []


def word_runs(words: list, repeats: int = REPEATS, shortest: int = SHORTEST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a list of words, by start and period."""
    numbers: dict = {}
    ids = [numbers.setdefault(w, len(numbers)) for w in words]
    found = []
    for a, b in stretches(np.array(ids, np.int64), repeats, shortest):
        found += [(a + s, n, q) for s, n, q in runs_of(ids[a:b], repeats, shortest)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapse(words: list, runs: list[tuple[int, int, int]]) -> list:
    """Words that no run contains after its first period."""
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    gone = np.cumsum(gone)
    return [w for w, g in zip(words, gone.tolist(), strict=False) if not g]


# ---- documents -------------------------------------------------------------------------------------


def find_runs(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    repeats: int = REPEATS,
    shortest: int = SHORTEST,
    rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) per row: all runs of its words, by start and period, and the text with each
    run cut back to its first period, words joined by one space. No shuffle: a row is worked on alone.

    Words are maximal stretches without ASCII white space. ``rewrite`` may change the words of a row first. Letters that
    provably lie in no run part a text into stretches, and each stretch gets its automaton: memory is linear
    in the longest stretch (about 700 bytes a word), time is its length times a logarithm.

    Null and empty texts: no words, no runs, empty collapsed text. A row without id is worked on like any other. Repeated
    rows give the same result each. An empty table gives no rows. Only the two named columns are read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            held = 0
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                words = (text.as_buffer().to_pybytes() if text.is_valid else b"").split()
                key = doc_id.as_py()
                if rewrite is not None:
                    words = rewrite(key, words)
                runs = word_runs(words, repeats, shortest)
                kept = b" ".join(collapse(words, runs) if runs else words)
                out.append((key, len(words), [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], kept))
                held += len(kept)
                if held > OUT_BYTES:
                    yield _batch(out)
                    out, held = [], 0
            yield _batch(out)

    return rows.mapInArrow(run, _RESULT)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    ids, n, runs, kept = zip(*rows, strict=True) if rows else ((), (), (), ())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(ids, pa.int64()),
            pa.array(n, pa.int64()),
            pa.array(runs, pa.list_(_RUN)),
            pa.array(kept, pa.binary()).cast(pa.string()),
        ],
        names=["doc_id", "n_words", "runs", "collapsed"],
    )


def repeat_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Every tenth document by the CRC of its id: the words from some word on repeat with a period."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def run_digest(found: DataFrame) -> DataFrame:
    """doc_id, number of runs, the run of the greatest length per period, digests of the runs and of the text."""
    run = F.col("best")
    # Exact order of length / period: a / b > c / d as a d > c b. Lengths stay far below the root of a long.
    better = lambda a, b: (b["length"] * a["period"] > a["length"] * b["period"]) | (
        (b["length"] * a["period"] == a["length"] * b["period"])
        & ((b["start"] < a["start"]) | ((b["start"] == a["start"]) & (b["period"] < a["period"])))
    )
    best = F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0))), F.get("runs", F.lit(0)), lambda a, b: F.when(better(a, b), b).otherwise(a))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n")))
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        run["start"].alias("start"),
        run["length"].alias("length"),
        run["period"].alias("period"),
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def best_run(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest exponent; ties go to the smallest start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
