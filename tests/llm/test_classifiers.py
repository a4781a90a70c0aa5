from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.llm import quality, toxicity
from tesserae.llm import words as W
from tesserae.llm.common import trained_in_a_task


def split(texts):
    raw = [t.encode() for t in texts]
    return W.split(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in raw])]))


def corpus(n, seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice(["ta", "ri", "no", "sel", "mu"]) for _ in range(rnd.randrange(1, 4)))
    texts, labels = [], []
    for _ in range(n):
        ws = [word() for _ in range(rnd.randrange(5, 150))]
        bad = rnd.random() < 0.3
        if bad:
            for _ in range(3):
                ws.insert(rnd.randrange(len(ws) + 1), "gruk" + word())
        texts.append(" ".join(ws))
        labels.append(int(bad))
    return texts, labels


@pytest.fixture(scope="module")
def net():
    texts, labels = corpus(400, 1)
    return toxicity.train([t.encode() for t in texts], labels, steps=120)


def test_gradients_by_differences(monkeypatch):
    monkeypatch.setattr(toxicity, "_F", np.float64)
    n = toxicity.Network()
    n.p = {k: v.astype(np.float64) for k, v in n.p.items()}
    w = split(["you odd thing word here now", "nice day", "x"])
    f = toxicity.Features(w)
    rows = np.append(f.token, -1)[toxicity.windows(w.bounds)[0]]
    y = np.array([1.0, 0, 1])
    _, g = n.gradients(f, rows, y)
    rng = np.random.default_rng(0)
    for k in ("x", "h", "b", "a", "ab", "v", "o", "ob"):
        at = tuple(rng.integers(0, s) for s in n.p[k].shape)
        sides = []
        for e in (1e-5, -2e-5):
            n.p[k][at] += e
            sides.append(n.gradients(f, rows, y)[0])
        n.p[k][at] += 1e-5
        assert abs((sides[0] - sides[1]) / 2e-5 - g[k][at]) < 1e-7


def test_held_out_accuracy_on_unseen_forms(net):
    texts, labels = corpus(300, 2)
    got = net.scores(split(texts)) >= toxicity.CUT
    assert (got == np.array(labels)).mean() > 0.95


def test_every_window_counts(net):
    clean = corpus(1, 7)[0][0]
    long = " ".join(["tari nosel muta"] * 2000)
    end = long + " grukta grukri gruksel"
    a, b, c = net.scores(split([long, end, clean]))
    assert b > 0.5 > a


def test_every_byte_of_a_long_word_counts(net):
    clean = "tari_nosel_muta_" * 200
    a, b, c = net.scores(split([clean, clean + "grukta_grukri_gruksel", clean + "grukta_grukri_gruksel_" + clean]))
    assert b > 0.5 > a and c > 0.5
    w = split(["x" * 64 + " " + "".join(map(chr, range(200, 291))), "", "y" * 65])
    parts = toxicity.bounded(w)
    for d in (0, 1, 2):
        at = {p for x, y in list(zip(parts.starts, parts.ends, strict=True))[parts.bounds[d] : parts.bounds[d + 1]] for p in range(x, y)}
        assert at == {p for x, y in list(zip(w.starts, w.ends, strict=True))[w.bounds[d] : w.bounds[d + 1]] for p in range(x, y)}
    assert (parts.ends - parts.starts).max() == 64 and toxicity.bounded(parts) is parts


def test_scores_do_not_depend_on_the_batch(net):
    texts = corpus(40, 3)[0] + ["", "  "]
    alone = np.concatenate([net.scores(split([t])) for t in texts])
    assert np.allclose(alone, net.scores(split(texts)), atol=2e-6)


def test_windows_cover_and_overlap():
    at, first = toxicity.windows(np.array([0, 0, 5, 5 + 24, 5 + 24 + 61]))
    assert first.tolist() == [0, 1, 2, 3]
    for k, (lo, hi) in enumerate(((0, 0), (0, 5), (5, 29), (29, 90))):
        last = first[k + 1] if k < 3 else len(at)
        got = at[first[k] : last]
        assert set(got[got >= 0].tolist()) == set(range(lo, hi))


def test_without_both_labels():
    assert toxicity.train([], []).scores(split(["a", ""])).tolist() == [0, 0]
    assert toxicity.train([b"a"], [1]).scores(split(["a"])).tolist() == [1]
    assert quality.train([], []).judged(split(["a"]))[0].tolist() == [0]
    assert quality.train([b"a"], [2.0]).judged(split(["a", ""]))[0].tolist() == [2, 2]


def test_toxicity_frames(spark, net):
    rows = [(1, "tari gruksel", 9.0), (None, None, 1.0), (2, "", None), (2, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double")
    out = toxicity.score_rows(df, net)
    assert out.columns == ["doc_id", "text", "score", "_score"] and out.count() == 4
    assert toxicity.score(df.limit(0), net).count() == 0
    assert len({r.score for r in toxicity.score(df.filter("doc_id = 2"), net).collect()}) == 1


def test_fit_never_sees_held_out_rows(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(200)] + [(None, "n")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(150)] + [(None, 1), (7, None), (999, 1), (3, 1)], "doc_id long, toxic int")
    seen = trained_in_a_task(toxicity.sample(docs, labels), lambda texts, labels: (texts, labels))
    want = {i for i in range(150) if zlib.crc32(str(i).encode()) % 4 != 2}
    assert {int(t[1:]) for t in seen[0]} == want and len(seen[0]) == len(want)
    assert dict(zip(seen[0], seen[1], strict=True)) == {f"t{i}".encode(): i % 2 for i in want}
    got = docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).collect()
    assert all(r.h == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)


def test_forward_pass_by_brute_force(net):
    """Logits of whole documents from plain loops over windows, words and gates."""
    texts = ["", "gruk", "tari gruksel " * 30 + "sel", corpus(1, 5)[0][0]]
    p, H, sig = {k: v.astype(np.float64) for k, v in net.p.items()}, toxicity.HIDDEN, lambda x: 1 / (1 + np.exp(-x))
    f = toxicity.Features(split(texts))
    x, at = net.inputs(f).astype(np.float64), 0
    for t, got in zip(texts, net.logits(split(texts)), strict=True):
        ws = [x[f.token[at + k]] for k in range(len(t.split()))]
        at += len(ws)
        best = -np.inf
        for lo in range(0, max(1, len(ws) - toxicity.WINDOW + toxicity.STRIDE), toxicity.STRIDE):
            part, states = ws[lo : lo + toxicity.WINDOW], []
            for d in (0, 1):
                h, out = np.zeros(H), []
                for v in part[:: -1 if d else 1]:
                    i, u = v @ p["x"][d] + p["b"][d, 0], h @ p["h"][d]
                    z, r = sig(i[:H] + u[:H]), sig(i[H : 2 * H] + u[H : 2 * H])
                    c = np.tanh(i[2 * H :] + r * u[2 * H :])
                    h = (1 - z) * c + z * h
                    out.append(h)
                states.append(out[:: -1 if d else 1])
            s = [np.concatenate(pair) for pair in zip(*states, strict=True)]
            e = [np.exp(np.tanh(v @ p["a"] + p["ab"]) @ p["v"]) for v in s]
            best = max(best, (sum(w * v for w, v in zip(e, s, strict=True)) / sum(e) @ p["o"] if s else 0.0) + p["ob"][0])
        assert abs(best - got) < 1e-3


def test_three_grades(spark):
    rnd = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        k = i % 3
        rows.append((i, " ".join(rnd.choice(("good", "fine", "text", *[("odd", "junk"), ("nasty", "fine"), ("good", "nice")][k] * 2)) for _ in range(40))))
        labels.append((i, int(k > 0), int(k == 1)))
    docs = spark.createDataFrame([*rows, (900, None), (None, "x")], "doc_id long, text string")
    ratings = spark.createDataFrame([*labels, (7, None, 1), (None, 1, 0), (5000, 1, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit(docs, ratings, quality.grade())
    assert model.grades.tolist() == [0, 1, 2] and (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    assert all(1 == r.tails[0] >= r.tails[1] >= r.tails[2] >= 0 for r in got.values()) and len(got) == 402
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    guess = {i: int(np.argmax(-np.diff([*got[i].tails, 0]))) for i in held}
    assert np.mean([guess[i] == i % 3 for i in held]) > 0.9


def test_ordinal_grades_in_order():
    rnd = random.Random(0)
    texts, grades = [], []
    for _ in range(700):
        k = rnd.randrange(3)
        texts.append(" ".join("good" if rnd.random() < 0.3 * k + 0.1 else "bad" for _ in range(30)))
        grades.append(float(k))
    m = quality.train([t.encode() for t in texts[:500]], grades[:500])
    assert (np.diff(m.thresholds) > 0).all()
    e, tail = m.judged(split(texts[500:]))
    means = [e[np.array(grades[500:]) == k].mean() for k in range(3)]
    assert means[0] < means[1] < means[2] and np.corrcoef(e, grades[500:])[0, 1] > 0.7
    assert ((tail >= 0) & (tail <= 1)).all() and (m.at_most(m.line(split(texts[:5]))) <= 1).all()


def test_quality_held_out(spark, small):
    out = {r.doc_id: r for r in quality.op8_quality(spark, small).collect()}
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{small}/labels.parquet").collect()}
    held = [d for d in truth if out[d].held_out]
    assert len(out) == spark.read.parquet(f"{small}/documents.parquet").count()
    assert np.mean([out[d].selected == bool(truth[d]) for d in held]) > 0.7


def test_scoring_holds_a_bounded_part_of_the_texts():
    import pyarrow as pa

    from tesserae.llm import toxicity

    net, sizes, inner = toxicity.Network(), [], toxicity.Network.scores
    net.scores = lambda words: sizes.append(len(words.buf)) or inner(net, words)
    texts = [b"some words of a text " * n for n in (0, 5000, 9000, 20, 3, 40_000, 7, 9000, 0)]
    parts = list(toxicity.scored_parts(net, pa.array(texts, pa.binary())))
    assert [(a, z) for a, z, _ in parts][0][0] == 0 and parts[-1][1] == len(texts) and sum(len(x) for *_, x in parts) == len(texts)
    assert max(sizes) == len(texts[5]) and sum(n > 1 << 19 for n in sizes) == 1  # only a longer text alone
