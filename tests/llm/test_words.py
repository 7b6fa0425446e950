import re

import numpy as np
import pyarrow as pa
from hypothesis import given
from hypothesis import strategies as st

from docgrain.llm import words as W

TEXT = st.lists(st.one_of(st.none(), st.text(alphabet=" \t\nAbc9é-ß\x0b\x1f語", max_size=40)), max_size=6)


def found(words):
    return [
        [bytes(words.data[words.starts[i] : words.ends[i]]) for i in range(words.first[d], words.first[d + 1])]
        for d in range(len(words.first) - 1)
    ]


@given(TEXT)
def test_split_equals_regex(texts):
    data, offsets = W.text_bytes(pa.array(texts, pa.string()))
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    space = [[w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] for t in texts]
    alnum = [[w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))] for t in texts]
    assert found(W.split(data, offsets, W.NOT_SPACE, False)) == space
    assert found(W.split(data, offsets, W.ALNUM, True)) == alnum


def test_hashes_tell_words_apart_and_equal_words_agree():
    words = [f"{'x' * (i % 23)}{i}" for i in range(5000)]
    data, offsets = W.text_bytes(pa.array([" ".join(words), " ".join(reversed(words))]))
    w = W.split(data, offsets, W.NOT_SPACE, False)
    h = w.hashes()
    assert len(set(h[:5000].tolist())) == 5000
    assert (h[:5000] == h[5000:][::-1]).all()


def test_windows_follow_order_and_content():
    values = np.arange(1, 60, dtype=np.uint64)
    values[30:50] = values[:20]
    for size in (1, 2, 3, 10, 13, 20):
        h = W.windows(values, size)
        assert (h[: 20 - size + 1] == h[30 : 50 - size + 1]).all()
        assert len(set(h[:30].tolist())) == 30
        if size > 1:
            assert W.windows(values[:size][::-1].copy(), size)[0] != h[0]


def test_pieces_cover_all_texts_once():
    offsets = np.array([0, 5, 5, 100, 101, 300, 301])
    for size in (1, 50, 1000):
        got = list(W.pieces(offsets, size))
        assert [a for a, _ in got] == [0, *[b for _, b in got[:-1]]]
        assert got[-1][1] == 6
