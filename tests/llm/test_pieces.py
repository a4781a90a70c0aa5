from __future__ import annotations

import math
import random
import re

import numpy as np
import pytest

from tesserae.llm import pieces as P


@pytest.fixture(scope="module")
def model():
    with open(P.MODEL, "rb") as f:
        return P.Model(f.read())


@pytest.fixture(scope="module")
def library():
    spm = pytest.importorskip("sentencepiece")
    return spm.SentencePieceProcessor(model_file=P.MODEL)


def texts():
    rnd = random.Random(3)
    odd = ["", " ", "   ", " a", "a ", "a" * 3000, "ab" * 900, "  lots   of    spaces     ", "日本語", "🙂🙂 x", "\n\n\tfoo\n", "▁x▁▁y", "\x00a", "====-----" * 90, "the" * 400]
    return odd + ["".join(rnd.choice("ab the▁ion\n.é") for _ in range(rnd.randrange(1, 300))) for _ in range(150)]


def test_ids_are_the_library_s(model, library):
    for t in texts():
        assert model.encode(t).tolist() == library.encode(t), t[:40]
        assert model.decode(library.encode(t)) == library.decode(library.encode(t))


def test_stream_by_parts_is_the_same(model, library):
    for t in texts()[:60]:
        x = "".join(model.normalised(t))
        for step in (1, 7, 1000):
            parts = [x[i : i + step] for i in range(0, len(x), step)]
            assert model._ids_of(model.window(parts)) == library.encode(t)
            assert np.frombuffer(b"".join(model.stream(parts)), np.int32).tolist() == library.encode(t)


def test_every_text_goes_through_the_stream(model, monkeypatch):
    calls, inner = [], model.stream
    monkeypatch.setattr(model, "stream", lambda parts: calls.append(1) or inner(parts))
    for t in texts():
        model.encode(t)
    assert len(calls) == len(texts())


def test_normalised_parts(monkeypatch):
    rnd = random.Random(7)
    m = P.Model.of([("<unk>", 0.0, P.UNKNOWN), ("▁", -1.0, P.NORMAL)], P.UNIGRAM, squeeze=True)
    for _ in range(300):
        t = "".join(rnd.choice("  ab") for _ in range(rnd.randrange(0, 25)))
        monkeypatch.setattr(P, "PART", rnd.randrange(1, 9))
        want = re.sub(" +", " ", t).strip(" ")
        assert "".join(m.normalised(t)) == (f" {want}".replace(" ", "▁") if want else "")


def test_unigram_against_full_viterbi():
    rows = [("<unk>", 0.0, P.UNKNOWN)] + [(p, s, P.NORMAL) for p, s in (("a", -1.0), ("b", -1.3), ("c", -2.0), ("ab", -1.7), ("bc", -2.2), ("abc", -2.9), ("ca", -2.1), ("aab", -2.4), ("▁", -1.1), ("▁a", -1.2))]
    m = P.Model.of(rows, P.UNIGRAM)
    rnd = random.Random(1)
    score = {p: s for p, s, _ in rows}
    for _ in range(120):
        t = "".join(rnd.choice("abcx▁") for _ in range(rnd.randrange(1, 90)))
        best = [0.0] + [-math.inf] * len(t)
        for e in range(1, len(t) + 1):
            for b in range(max(0, e - m.longest), e):
                if t[b:e] in m.ids or e - b == 1:
                    best[e] = max(best[e], best[b] + score.get(t[b:e], m.worst))
        got = list(m.window(t[i : i + 5] for i in range(0, len(t), 5)))
        assert "".join(got) == t and math.isclose(sum(score.get(p, m.worst) for p in got), best[-1], abs_tol=1e-9)


def test_window_stays_bounded(model):
    seen = []
    inner = model._common

    def watch(back, longest):
        seen.append(len(back))
        return inner(back, longest)

    model._common = watch
    list(model.window(["abcdefgh" * 2000]))
    del model._common
    assert max(seen) < 12 * model.longest


def test_neighbours_fit_as_merging_tells(model):
    rnd = random.Random(5)
    rows = [(a + b, float(rnd.choice((-1, -2, -3))), P.NORMAL) for a in "ab" for b in "abc"] + [(p, float(rnd.choice((-1, -2, -3))), P.NORMAL) for p in ("aab", "abab", "bca", "aabc", "abc", "baba", "a", "b")]
    for m, names in ((P.Model.of(rows, P.BPE), [r[0] for r in rows] + ["c"]), (model, rnd.sample([p for p in model.ids if len(p) < 9], 150) + ["\u2603"])):
        for right in names:
            assert m.fits("", right) == (m.merged(right) == [right])
            for left in names:
                alone = m.merged(left) == [left] and m.merged(right) == [right]
                assert m.fits(left, right) == (alone and m.merged(left + right) == [left, right]), (left, right)


def test_rare_words_do_not_push_out_frequent_ones(model, monkeypatch):
    monkeypatch.setattr(P, "KEPT_WORDS", 40)
    monkeypatch.setattr(model, "_kept", {})
    monkeypatch.setattr(model, "_kept_before", {})
    met, inner = [], model._find
    monkeypatch.setattr(model, "_find", lambda text, *rest: met.append(text) or inner(text, *rest))
    model.encode(" ".join(f"often z{i}q" for i in range(500)))
    assert sum("often" in t for t in met) == 1 and len(met) > 500 and len(model._kept) + len(model._kept_before) <= 40


def test_frames(spark):
    rows = [(1, "a b", "x"), (None, None, "y"), (2, "", "z"), (2, "a b", "z"), (3, "w" * 50_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = P.encode(df).collect()
    assert sorted((r.doc_id or 0, r.n_ids > 0, r.round_trip) for r in out) == [(0, False, True), (1, True, True), (2, False, True), (2, True, True), (3, True, True)]
    back = {(r.doc_id, r.text) for r in P.decode(P.encode(df.filter("doc_id = 1"))).collect()}
    assert back == {(1, "a b")}
    assert P.encode(df.limit(0)).count() == 0
