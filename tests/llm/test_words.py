from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from tesserae.llm import words as W

TEXT = st.text(alphabet="aAbZ é日\t\n\x0b\x0c\r\x1c\xa0.", max_size=60)


def split_of(texts):
    for first, last, buf, offsets in W.chunks(pa.array(texts, pa.string()), 40):
        w = W.split(buf, offsets)
        h = w.hashes()
        for k in range(last - first):
            a, b = w.bounds[k], w.bounds[k + 1]
            yield [bytes(buf[s:e]) for s, e in zip(w.starts[a:b], w.ends[a:b], strict=True)], h[a:b]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), TEXT), max_size=8))
def test_words_are_those_of_the_pattern(texts):
    got = list(split_of(texts))
    assert [g for g, _ in got] == [re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()) for t in texts]
    seen: dict[int, bytes] = {}
    for ws, hs in got:
        for word, h in zip(ws, hs, strict=True):
            low = bytes(c + 32 if 65 <= c <= 90 else c for c in word)
            assert seen.setdefault(int(h), low) == low


def test_hash_is_the_same_across_blocks(monkeypatch):
    text = " ".join(f"word{i} Xy" for i in range(3000)).encode()
    buf = np.frombuffer(text, np.uint8)
    whole = W.split(buf, np.array([0, len(buf)])).hashes()
    monkeypatch.setattr(W, "CHUNK_BYTES", 100)
    assert (W.split(buf, np.array([0, len(buf)])).hashes() == whole).all()


def test_powers_are_kept_for_a_block_not_a_chunk():
    W._POWERS.clear()
    text = b"some words " * 100_000
    assert len(set(W.split(np.frombuffer(text, np.uint8), np.array([0, len(text)])).hashes().tolist())) == 2
    assert sum(p.nbytes for p in W._POWERS.values()) <= 8 << 20


def test_shingles_by_brute_force():
    ws = "a b c a b c d".split()
    assert len(W.text_shingle_set(" ".join(ws).encode(), 3)) == len({tuple(ws[i : i + 3]) for i in range(5)})
    assert len(W.text_shingle_set(b"a b", 5)) == 1 and len(W.text_shingle_set(b" \n", 5)) == 0 and len(W.text_shingle_set(None, 5)) == 0
    assert W.text_shingle_set(b"A b", 5)[0] == W.text_shingle_set(b"a B", 5)[0]
