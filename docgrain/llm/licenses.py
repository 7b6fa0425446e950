"""License scans: exact set-similarity join of text blocks with license templates, and fixed phrases."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W

THRESHOLD = 0.85

# Phrases and the labels they give.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Notices by which texts name their license: (label, text).
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("apache-2", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("all-rights-reserved", "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form"),
)


def lower_words(text: str) -> list[str]:
    """Words of one text by the rule of the scan: lower-cased A-Z, digits and all that is not ASCII."""
    data = np.frombuffer(text.encode(), np.uint8)
    found = W.split(data, np.array([0, len(data)]), W.ALNUM, True) if len(data) else None
    if found is None:
        return []
    raw = found.data.tobytes()
    return [raw[a:b].decode() for a, b in zip(found.starts.tolist(), found.ends.tolist(), strict=True)]


def block_words(n: int) -> int:
    """Half the size of the blocks that a template of ``n`` words is compared with: a power of two, 4 at least."""
    return max(4, 1 << (n - 1).bit_length())


@dataclass
class Template:
    label: str
    tokens: list[int]  # distinct, rarest first
    need: int  # tokens that a block must hold
    half: int
    text: str = field(repr=False)

    @property
    def prefix(self) -> list[int]:
        """A block that holds ``need`` tokens holds one of these."""
        return self.tokens[: len(self.tokens) - self.need + 1]


class Vocabulary:
    """Words of the templates and phrases, looked up in arrays of words without a false match."""

    def __init__(self, words: list[str]):
        raw = [w.encode() for w in words]
        ends = np.cumsum([len(w) for w in raw]).astype(np.int64) if raw else np.zeros(0, np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        starts = np.r_[np.zeros(1, np.int64), ends[:-1]] if raw else ends
        self.size = len(raw)
        self._lanes = -(-max((len(w) for w in raw), default=1) // 8)
        mine = W.Words(data, starts, ends, np.array([0, len(raw)]))
        h = mine.hashes()
        self._order = np.argsort(h)
        self._hashes = h[self._order]
        self._length = ends - starts
        self._bytes = self._chunks(mine, np.arange(len(raw)))

    def _chunks(self, found: W.Words, at: np.ndarray) -> np.ndarray:
        padded = np.concatenate([found.data, np.zeros(8 * self._lanes + 8, np.uint8)])
        view = np.ndarray((len(padded) - 7,), dtype="<u8", buffer=padded, strides=(1,))
        length = found.ends[at] - found.starts[at]
        masks = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
        out = np.empty((len(at), self._lanes), np.uint64)
        for k in range(self._lanes):
            out[:, k] = view[found.starts[at] + 8 * k] & masks[np.clip(length - 8 * k, 0, 8)]
        return out

    def numbers(self, found: W.Words) -> np.ndarray:
        """Number of each word, -1 for words that are not in the vocabulary. Hashes find, bytes decide."""
        out = np.full(len(found.starts), -1, np.int32)
        if not self.size or not len(out):
            return out
        h = found.hashes()
        spot = np.minimum(np.searchsorted(self._hashes, h), self.size - 1)
        at = np.flatnonzero(self._hashes[spot] == h)
        no = self._order[spot[at]]
        same = self._length[no] == found.ends[at] - found.starts[at]
        same &= (self._bytes[no] == self._chunks(found, at)).all(1)
        out[at[same]] = no[same]
        return out


def template_words(templates, phrases) -> list[str]:
    """Distinct words of templates and phrases, sorted."""
    return sorted({w for text in [*(t for _, t in templates), *phrases] for w in lower_words(text)})


def word_counts(docs: DataFrame, text_col: str, words: list[str]) -> dict[str, int]:
    """How often each of the given words stands in all texts. One row per task and word is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(words)
        total = np.zeros(len(words), np.int64)
        for batch in batches:
            for _, _, found in W.split_pieces(batch.column(0), W.ALNUM, True):
                no = vocabulary.numbers(found)
                total += np.bincount(no[no >= 0], minlength=len(words))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(words)), pa.int32()), pa.array(total)], names=["w", "n"])

    rows = docs.select(F.col(text_col).cast("string").alias("t")).mapInArrow(run, "w int, n long")
    found = {r.w: r.n for r in rows.groupBy("w").agg(F.sum("n").alias("n")).collect()}
    return {w: found.get(i, 0) for i, w in enumerate(words)}


def prepared(templates, counts: dict[str, int], threshold: float) -> list[Template]:
    """Templates with their distinct words in the global order: rarest in the corpus first, then by word."""
    numbers = {w: i for i, w in enumerate(sorted(counts))}
    out = []
    for label, text in templates:
        ws = lower_words(text)
        if not ws:
            continue
        distinct = sorted(set(ws), key=lambda w: (counts[w], w))
        need = max(1, ceil(threshold * len(distinct) - 1e-9))
        out.append(Template(label, [numbers[w] for w in distinct], need, block_words(len(ws)), text))
    return out


def matches(no: np.ndarray, n: int, templates: list[Template], ranks: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(template, block, common tokens) of every block that holds enough of a template's tokens.

    ``no``: numbers of the ``n`` words of one text. Blocks of a template are stretches of twice ``half``
    words at a stride of ``half``, so a copy of it lies whole in one block.
    """
    by_half: dict[int, list[int]] = defaultdict(list)
    for t, template in enumerate(templates):
        by_half[template.half].append(t)
    known = np.flatnonzero(no >= 0)
    present = set(no[known].tolist())
    for half, mine in by_half.items():
        index: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t in mine:
            for i, token in enumerate(templates[t].prefix):
                if token in present:
                    index[token].append((t, i))
        if not index:
            continue
        anchors = known[np.isin(no[known], list(index))]
        last = max(0, -(-n // half) - 2)  # the last block reaches the end of the text
        blocks = np.unique(np.concatenate([anchors // half, np.maximum(anchors // half - 1, 0)]))
        for b in blocks[blocks <= last].tolist():
            inside = no[b * half : (b + 2) * half]
            held = np.unique(inside[inside >= 0])
            held = held[np.argsort(ranks[held])].tolist()
            tried: set[int] = set()
            for j, token in enumerate(held):
                for t, i in index.get(token, ()):
                    template = templates[t]
                    if t in tried or len(held) < template.need:  # length filter
                        continue
                    tried.add(t)
                    # This is the first common token in the global order: what may follow bounds the overlap.
                    if 1 + min(len(template.tokens) - i - 1, len(held) - j - 1) < template.need:
                        continue
                    common = len(set(template.tokens).intersection(held))
                    if common >= template.need:
                        yield t, b, common


def scan(
    docs: DataFrame,
    templates: tuple[tuple[str, str], ...] = TEMPLATES,
    phrases: dict[str, str] | None = None,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_words, places, found) per row of ``docs``.

    ``places``: (phrase, label, start word) of every place where the words of a phrase stand one after another, by
    start. ``found``: (label, template, first word, words, containment) of every text block whose set of words holds at
    least ``threshold`` of a template's distinct words.

    The words of all templates are ordered by their frequency in the whole corpus, rarest first. Of a template of m
    distinct words that needs a, a block that qualifies holds one of its first m - a + 1 words, so only blocks
    around these words are looked at (prefix filter); blocks with fewer than a words of the vocabulary go
    (length filter), and so do those where the first common word leaves too few behind it on either side (positional
    filter). The rest is counted exactly. Words are compared by their bytes.

    Two scans, no shuffle of text: the first counts the words of the templates, the second looks for blocks. Templates and
    phrases are arguments, so they and their words are as small as the caller keeps them.

    Null and empty texts: no words, nothing found. Rows without id and repeated rows are scanned like any other. A template
    or phrase without words is never found. An empty table gives no rows. Only the two named columns are read.
    """
    phrases = PHRASES if phrases is None else phrases
    listed = template_words(templates, phrases)
    counts = word_counts(docs, text_col, listed)
    ready = prepared(templates, counts, threshold)
    ranks = np.empty(len(listed), np.int64)
    ranks[sorted(range(len(listed)), key=lambda i: (counts[listed[i]], listed[i]))] = np.arange(len(listed))
    numbers = {w: i for i, w in enumerate(listed)}
    wanted = [(p, label, [numbers[w] for w in lower_words(p)]) for p, label in phrases.items()]
    wanted = [p for p in wanted if p[2]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(listed)
        for batch in batches:
            for at, to, found in W.split_pieces(batch.column(1), W.ALNUM, True):
                no = vocabulary.numbers(found)
                n = found.counts()
                text_of = found.text_of()
                places: list[list[dict]] = [[] for _ in range(to - at)]
                for phrase, label, parts in wanted:
                    hit = np.flatnonzero(no == parts[0])
                    hit = hit[hit + len(parts) <= len(no)]
                    for k, part in enumerate(parts[1:], 1):
                        hit = hit[no[hit + k] == part]
                    hit = hit[text_of[hit] == text_of[hit + len(parts) - 1]]
                    for i in hit.tolist():
                        d = int(text_of[i])
                        places[d].append({"phrase": phrase, "label": label, "start": i - int(found.first[d])})
                blocks: list[list[dict]] = [[] for _ in range(to - at)]
                some = np.unique(text_of[np.isin(no, [x for t in ready for x in t.prefix])])
                for d in some.tolist():
                    for t, b, common in matches(no[found.first[d] : found.first[d + 1]], int(n[d]), ready, ranks):
                        template = ready[t]
                        first = b * template.half
                        blocks[d].append(
                            {
                                "label": template.label,
                                "template": template.text,
                                "first": first,
                                "words": min(2 * template.half, int(n[d]) - first),
                                "containment": common / len(template.tokens),
                            }
                        )
                for p in places:
                    p.sort(key=lambda x: (x["start"], x["phrase"]))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, to - at),
                        pa.array(n, pa.int64()),
                        pa.array(places, pa.list_(_PLACE)),
                        pa.array(blocks, pa.list_(_BLOCK)),
                    ],
                    names=["doc_id", "n_words", "places", "found"],
                )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, _RESULT)


_PLACE = pa.struct([("phrase", pa.string()), ("label", pa.string()), ("start", pa.int64())])
_BLOCK = pa.struct(
    [("label", pa.string()), ("template", pa.string()), ("first", pa.int64()), ("words", pa.int64()), ("containment", pa.float64())]
)
_RESULT = (
    "doc_id long, n_words long, places array<struct<phrase: string, label: string, start: long>>, "
    "found array<struct<label: string, template: string, first: long, words: long, containment: double>>"
)


def license_digest(scanned: DataFrame) -> DataFrame:
    """Counts and labels per row. ``score`` is the greatest containment of a template in a block, 1 where a phrase
    stands, 0 where nothing was found."""
    names = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    base, own = F.col("places.label"), F.col("found.label")
    return scanned.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.start").alias("first_word"),
        F.array_max("places.start").alias("last_word"),
        names(base).alias("base_labels"),
        names(F.concat(base, own)).alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max("found.containment"), F.lit(0.0))).alias("score"),
    )
