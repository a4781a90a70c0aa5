"""Toxicity by a bidirectional gated recurrent network with attention pooling, in numpy.

A word's input is its hashed word vector, plus a vector of its opening (its first 5 bytes, or all if fewer), beside
the mean of its character n-gram vectors (n-grams of the bytes between marks for the word's ends). A word of more than LONGEST bytes is cut after marks,
and what is longer still counts as several that overlap by half, so that all its bytes are read. Two gated recurrent passes read each window of WINDOW words, which overlap by half;
attention pools their states, a logit follows, and a document scores its highest window. Every window of the whole text
is scored.

Training (one task, bounded): at most POSITIVES and NEGATIVES labelled documents of at most TRAIN_BYTES, chosen by a hash
of their id among those whose crc32(id) mod 4 is not 2; only text enters the network. A document of label 1 is told by
its highest window, one of label 0 by all its windows. The first components of the input vectors start at the log odds
of the sample. A fifth of the sample, chosen by its texts, is kept for the last shift, which places CUT where the F1 of those
documents is highest; a sample with too few of either label there serves whole.

Defined results: null and empty texts get the score of an empty window; a text of fewer than WINDOW words is one window;
equal texts get equal scores (6 decimals); without labels of both kinds every score is the share of label 1, or 0;
labels that are null or without a document are ignored; a document with clashing labels counts as toxic; repeated rows are
scored each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tesserae.llm import words as W
from tesserae.llm.common import fresh, table, text_bytes, trained_in_a_task

WINDOW, STRIDE = 24, 12
WORD_BUCKETS, GRAM_BUCKETS = 1 << 15, 1 << 15
WORD_DIM, GRAM_DIM, HIDDEN, ATTENTION = 6, 6, 8, 8
GRAMS = (3, 4)
OPENINGS = (5,)
POSITIVES, NEGATIVES, TRAIN_BYTES = 1200, 2400, 12_000
STEPS, BATCH, RATE = 260, 384, 0.01
CUT = 0.3
#: Share of words that lose their own vector at a training step.
UNSEEN = 0.5
#: Documents of average share that each bucket's log odds start from.
PRIOR = 20
#: Documents of each label that suffice to place CUT.
FEW = 12
#: A word of more than LONGEST bytes is read in parts of PART bytes, each APART bytes after the one before.
LONGEST, PART, APART = 64, 24, 12
BLOCK = 4096
#: Bytes of texts that are scored at once, one text at least: a worker stays in memory beside those of other stages.
SCORED = 1 << 19
_F = np.float32
_MARK = np.zeros(256, bool)
_MARK[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def unglued(words: W.Words) -> W.Words:
    """words, with those of more than LONGEST bytes cut after runs of ASCII marks."""
    sizes = words.ends - words.starts
    if not len(sizes) or sizes.max() <= LONGEST:
        return words
    cut = np.flatnonzero(_MARK[words.buf[:-1]] & ~_MARK[words.buf[1:]]) + 1
    word = np.searchsorted(words.starts, cut, side="right") - 1
    cut = cut[(word >= 0) & (cut < words.ends[word]) & (cut > words.starts[word]) & (sizes[word] > LONGEST)]
    starts = np.sort(np.concatenate([words.starts, cut]))
    of = np.searchsorted(words.starts, starts, side="right") - 1
    ends = np.minimum(np.append(starts[1:], len(words.buf)), words.ends[of])
    return W.Words(words.buf, words.offsets, starts, ends, np.searchsorted(starts, np.append(words.starts, len(words.buf))[words.bounds]))


def bounded(words: W.Words) -> W.Words:
    """words with the parts of each long word in its place."""
    words = unglued(words)
    sizes = words.ends - words.starts
    if not len(sizes) or sizes.max() <= LONGEST:
        return words
    counts = np.where(sizes > LONGEST, 1 - (PART - sizes) // APART, 1)
    first = np.cumsum(counts) - counts
    starts = np.repeat(words.starts, counts) + (np.arange(counts.sum()) - np.repeat(first, counts)) * APART
    ends = np.minimum(starts + np.repeat(np.where(counts > 1, PART, sizes), counts), np.repeat(words.ends, counts))
    return W.Words(words.buf, words.offsets, starts, ends, np.append(first, counts.sum())[words.bounds])


class Features:
    """Distinct words of some documents: word buckets, buckets of their openings (in the same table), and flat n-gram buckets with counts; token holds each word's row."""

    def __init__(self, words: W.Words) -> None:
        h = words.hashes()
        _, first, token = np.unique(h, return_index=True, return_inverse=True)
        self.token = token.astype(np.int32)
        del token
        self.word = (h[first] % np.uint64(WORD_BUCKETS)).astype(np.int32)
        starts, sizes = words.starts[first], words.ends[first] - words.starts[first]
        at = np.concatenate([[0], np.cumsum(sizes + 2)])
        n = len(sizes)
        code = np.zeros(at[-1], np.uint32)
        owner = np.repeat(np.arange(n), sizes)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        letters = words.buf[starts[owner] + inner].astype(np.uint32)
        letters += 32 * ((letters >= 65) & (letters <= 90)).astype(np.uint32)
        code[at[:-1]] = 1
        code[at[1:] - 1] = 2
        code[at[owner] + 1 + inner] = letters
        v, opens = np.full(n, 7, np.uint32), []
        for k in range(max(OPENINGS, default=0)):
            v = np.where(k < sizes, (v ^ code[at[:-1] + np.minimum(k, sizes - 1) + 1]) * np.uint32(0x01000193), v)
            v ^= v >> np.uint32(15)
            if k + 1 in OPENINGS:
                opens.append((v ^ np.uint32(k + 1)) * np.uint32(0x9E3779B1) >> np.uint32(8))
        self.opening = (np.array(opens, np.uint32).reshape(len(opens), n).T % np.uint32(WORD_BUCKETS)).astype(np.int32)
        flat, who = [], []
        for g in GRAMS:
            counts = np.maximum(sizes + 2 - g + 1, 0)
            w = np.repeat(np.arange(n), counts)
            p = at[w] + np.arange(len(w)) - np.repeat(np.cumsum(counts) - counts, counts)
            v = np.full(len(w), g, np.uint32)
            for k in range(g):
                v = (v ^ code[p + k]) * np.uint32(0x01000193)
                v ^= v >> np.uint32(15)
            flat.append(v % np.uint32(GRAM_BUCKETS))
            who.append(w)
        flat, who = np.concatenate(flat), np.concatenate(who)
        order = np.argsort(who, kind="stable")
        self.gram = flat[order].astype(np.int32)
        self.counts = np.bincount(who, minlength=n)  # one n-gram at least, as every word has a letter and two marks

    def gram_starts(self) -> np.ndarray:
        return np.cumsum(self.counts) - self.counts


def windows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token numbers (windows x WINDOW, -1 past a document's end) and each document's first window; one window at least."""
    sizes = np.diff(bounds)
    counts = np.maximum(1, -(-(sizes - WINDOW) // STRIDE) + 1)
    first = np.concatenate([[0], np.cumsum(counts)])
    doc = np.repeat(np.arange(len(sizes)), counts)
    begin = bounds[doc] + (np.arange(first[-1]) - first[doc]) * STRIDE
    at = begin.astype(np.int32)[:, None] + np.arange(WINDOW, dtype=np.int32)
    at[at >= bounds[doc + 1].astype(np.int32)[:, None]] = -1
    return at, first[:-1]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return _F(0.5) * np.tanh(_F(0.5) * x) + _F(0.5)


class Network:
    """Parameters in a dict p, all float32: word, gram, x (inputs to gates), h (states to gates), b, a, ab, v, o, ob."""

    def __init__(self, seed: int = 11) -> None:
        r = np.random.default_rng(seed)
        normal = lambda *shape, scale: (r.standard_normal(shape) * scale).astype(_F)
        d = WORD_DIM + GRAM_DIM
        self.p = {
            "word": normal(WORD_BUCKETS, WORD_DIM, scale=0.05), "gram": normal(GRAM_BUCKETS, GRAM_DIM, scale=0.05),
            "x": normal(2, d, 3 * HIDDEN, scale=d**-0.5), "h": normal(2, HIDDEN, 3 * HIDDEN, scale=HIDDEN**-0.5), "b": np.zeros((2, 1, 3 * HIDDEN), _F),
            "a": normal(2 * HIDDEN, ATTENTION, scale=0.3), "ab": np.zeros(ATTENTION, _F), "v": normal(ATTENTION, scale=0.3), "o": normal(2 * HIDDEN, scale=0.3), "ob": np.full(1, -1, _F),
        }
        self.shift = 0.0
        self.constant: float | None = None

    def inputs(self, f: Features, unseen: np.ndarray | None = None) -> np.ndarray:
        """A row for each distinct word; unseen ones lack their own vector."""
        if not len(f.word):
            return np.zeros((0, WORD_DIM + GRAM_DIM), _F)
        grams = np.add.reduceat(self.p["gram"][f.gram], f.gram_starts(), axis=0) / f.counts[:, None].astype(_F)
        own = self.p["word"][f.word]
        if unseen is not None:
            own[unseen] = 0
        for k in range(f.opening.shape[1]):
            own += self.p["word"][f.opening[:, k]]
        return np.concatenate([own, grams], axis=1)

    def forward(self, gates: np.ndarray, rows: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of windows. gates: (2, distinct words + 1, 3 HIDDEN) input parts, the last row unused; rows: (windows x WINDOW), -1 for none."""
        p, n, H = self.p, len(rows), HIDDEN
        states = np.zeros((WINDOW, 2, n, H), _F)
        h = np.zeros((2, n, H), _F)
        there = rows >= 0
        for t in range(WINDOW):
            back = WINDOW - 1 - t
            x = np.stack([gates[0][rows[:, t]], gates[1][rows[:, back]]])
            u = h @ p["h"]
            zr = _sigmoid(x[..., : 2 * H] + u[..., : 2 * H])
            z, r = zr[..., :H], zr[..., H:]
            c = np.tanh(x[..., 2 * H :] + r * u[..., 2 * H :])
            new = c + z * (h - c)
            live = np.stack([there[:, t], there[:, back]])
            if not live.all():
                new = np.where(live[..., None], new, h)
            if keep is not None:
                keep.setdefault("steps", []).append((h, u, z, r, c, live))
            h = new
            states[t, 0], states[back, 1] = h[0], h[1]
        s = np.concatenate([states[:, 0], states[:, 1]], axis=2)
        e = np.tanh(s @ p["a"] + p["ab"])
        score = np.where(there.T, e @ p["v"], _F(-30))
        weight = np.exp(score - score.max(axis=0))
        weight /= weight.sum(axis=0)
        weight = np.where(there.T, weight, _F(0))
        pooled = np.einsum("tn,tnk->nk", weight, s)
        if keep is not None:
            keep.update(s=s, e=e, weight=weight, pooled=pooled, there=there)
        return pooled @ p["o"] + p["ob"]

    def gates(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((2, len(x) + 1, 3 * HIDDEN), _F)
        out[:, :-1] = x @ self.p["x"] + self.p["b"]
        return out

    def logits(self, words: W.Words) -> np.ndarray:
        """Each document's highest window."""
        words = bounded(words)
        f = Features(words)
        gates = self.gates(self.inputs(f))
        at, first = windows(words.bounds)
        token = np.append(f.token, -1)
        out = np.concatenate([self.forward(gates, token[at[k : k + BLOCK]]) for k in range(0, len(at), BLOCK)])
        return np.maximum.reduceat(out, first)

    def scores(self, words: W.Words) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(words.bounds) - 1, self.constant)
        x = self.logits(words).astype(np.float64) - self.shift
        return np.round(1 / (1 + np.exp(-x)), 6)

    def gradients(self, f: Features, rows: np.ndarray, target: np.ndarray, unseen: np.ndarray | None = None) -> tuple[float, dict[str, np.ndarray]]:
        """Mean log loss of windows and its gradients; word and gram get (rows, values) pairs. unseen: words told by openings and n-grams alone."""
        p, H, n, keep = self.p, HIDDEN, len(rows), {}
        x = self.inputs(f, unseen)
        logit = self.forward(self.gates(x), rows, keep)
        prob = _sigmoid(logit)
        loss = float(np.mean(np.logaddexp(0, logit) - target * logit))
        g: dict[str, np.ndarray] = {}
        d = ((prob - target) / n).astype(_F)
        s, e, weight, pooled = keep["s"], keep["e"], keep["weight"], keep["pooled"]
        g["o"], g["ob"] = pooled.T @ d, d.sum(keepdims=True)
        dpool = d[:, None] * p["o"]
        dweight = np.einsum("nk,tnk->tn", dpool, s)
        dscore = weight * (dweight - (weight * dweight).sum(axis=0))
        g["v"] = np.einsum("tn,tna->a", dscore, e)
        de = dscore[..., None] * p["v"] * (1 - e * e)
        g["a"], g["ab"] = np.einsum("tnk,tna->ka", s, de, optimize=True), de.sum(axis=(0, 1))
        ds = weight[..., None] * dpool + de @ p["a"].T
        g["h"] = np.zeros_like(p["h"])
        dx_all = np.empty((2, WINDOW, n, 3 * H), _F)
        dh = np.zeros((2, n, H), _F)
        for t in range(WINDOW - 1, -1, -1):
            back = WINDOW - 1 - t
            h, u, z, r, c, live = keep["steps"][t]
            dh = dh + np.stack([ds[t, :, :H], ds[back, :, H:]])
            own = np.where(live[..., None], dh, _F(0))
            dz, dc = own * (h - c) * z * (1 - z), own * (1 - z) * (1 - c * c)
            dr = dc * u[..., 2 * H :] * r * (1 - r)
            dx = np.concatenate([dz, dr, dc], axis=2)
            du = np.concatenate([dz, dr, dc * r], axis=2)
            g["h"] += h.transpose(0, 2, 1) @ du
            dh = np.where(live[..., None], own * z, dh) + du @ p["h"].transpose(0, 2, 1)
            dx_all[0, t], dx_all[1, back] = dx[0], dx[1]
        # Sums over the places of each distinct word.
        place = rows.T.ravel()
        order = np.argsort(place, kind="stable")[(place < 0).sum() :]
        edge = np.flatnonzero(np.diff(place[order], prepend=-1))
        dgates = np.zeros((2, len(x), 3 * H), _F)
        dgates[:, place[order][edge]] = np.add.reduceat(dx_all.reshape(2, -1, 3 * H)[:, order], edge, axis=1)
        g["b"] = dgates.sum(axis=1, keepdims=True)
        g["x"] = x.T @ dgates
        dinput = (dgates @ p["x"].transpose(0, 2, 1)).sum(axis=0)
        dword = dinput[:, :WORD_DIM]
        own = dword if unseen is None else np.where(unseen[:, None], _F(0), dword)
        g["word"] = (np.concatenate([f.word, f.opening.T.ravel()]), np.concatenate([own, *[dword] * f.opening.shape[1]]))
        g["gram"] = (f.gram, np.repeat(dinput[:, WORD_DIM:] / f.counts[:, None].astype(_F), f.counts, axis=0))
        return loss, g


class _Adam:
    def __init__(self, p: dict[str, np.ndarray], rate: float) -> None:
        self.p, self.rate, self.n = p, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def step(self, g: dict) -> None:
        self.n += 1
        fix = (1 - 0.999**self.n) ** 0.5 / (1 - 0.9**self.n)
        for k, d in g.items():
            if isinstance(d, tuple):  # rows of a table: only those move
                rows, inverse = np.unique(d[0], return_inverse=True)
                total = np.stack([np.bincount(inverse, d[1][:, j], len(rows)) for j in range(d[1].shape[1])], axis=1).astype(_F)
                m, v = self.m[k], self.v[k]
                m[rows] = 0.9 * m[rows] + 0.1 * total
                v[rows] = 0.999 * v[rows] + 0.001 * total**2
                self.p[k][rows] -= _F(self.rate * fix) * m[rows] / (np.sqrt(v[rows]) + _F(1e-7))
            else:
                self.m[k] = 0.9 * self.m[k] + 0.1 * d
                self.v[k] = 0.999 * self.v[k] + 0.001 * d * d
                self.p[k] -= (self.rate * fix * self.m[k] / (np.sqrt(self.v[k]) + 1e-7)).astype(_F)


def _log_odds(per_doc: Iterator[np.ndarray], label: np.ndarray, buckets: int) -> np.ndarray:
    """Of each bucket, log odds of the two classes' shares of documents that hold it, shrunk for rare ones."""
    held = np.zeros((2, buckets))
    for c, keys in zip(label, per_doc, strict=True):
        held[c, np.unique(keys)] += 1
    neg, pos = held
    share = (label == 1).mean()
    return (np.log((pos + PRIOR * share) / (neg + PRIOR * (1 - share))) - np.log(share / (1 - share))).clip(-3, 3).astype(_F)


def train(texts: list[bytes], labels: list[int], steps: int | None = None, seed: int = 5) -> Network:
    """A network for documents with labels 0 and 1."""
    label = np.array(labels, np.int64)
    if not len(label) or label.min() == label.max():
        net = Network()
        net.constant = float(label.mean()) if len(label) else 0.0
        return net
    kept = np.array([zlib.crc32(t) % 5 == 0 for t in texts])
    if min(np.bincount(label[kept], minlength=2)) < FEW:
        kept[:] = False
    net = _learned([t for t, k in zip(texts, kept, strict=True) if not k], label[~kept], STEPS if steps is None else steps, seed)
    judge, label = ([t for t, k in zip(texts, kept, strict=True) if k], label[kept]) if kept.any() else (texts, label)
    logit = np.concatenate([net.logits(W.split(buf, offsets)) for *_, buf, offsets in W.chunks(pa.array(judge, pa.binary()))]).astype(np.float64)
    order = np.argsort(-logit, kind="stable")
    hits = np.cumsum(label[order])
    f1 = 2 * hits / (np.arange(1, len(hits) + 1) + label.sum())
    k = int(np.argmax(f1))
    edge = (logit[order[k]] + logit[order[min(k + 1, len(order) - 1)]]) / 2
    net.shift = float(edge - np.log(CUT / (1 - CUT)))
    return net


def _learned(texts: list[bytes], label: np.ndarray, steps: int, seed: int) -> Network:
    net = Network()
    buf = np.frombuffer(b"".join(texts), np.uint8)
    words = bounded(W.split(buf, np.concatenate([[0], np.cumsum([len(t) for t in texts])])))
    f = Features(words)
    starts = f.gram_starts()

    def grams(tokens: np.ndarray) -> np.ndarray:
        """All n-grams of some distinct words."""
        counts = f.counts[tokens]
        return f.gram[np.repeat(starts[tokens], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)]

    in_doc = [np.unique(f.token[a:b]) for a, b in zip(words.bounds[:-1], words.bounds[1:], strict=True)]
    net.p["word"][:, 0] = _log_odds((np.append(f.word[t], f.opening[t].ravel()) for t in in_doc), label, WORD_BUCKETS)
    net.p["gram"][:, 0] = 2 * _log_odds((grams(t) for t in in_doc), label, GRAM_BUCKETS)
    del in_doc
    rows, first = windows(words.bounds)
    doc = np.repeat(np.arange(len(texts)), np.diff(np.append(first, len(rows))))
    token = np.append(f.token, np.int32(-1))
    for k in range(0, len(rows), BLOCK):
        rows[k : k + BLOCK] = token[rows[k : k + BLOCK]]
    rng, adam = np.random.default_rng(seed), _Adam(net.p, RATE)
    negatives = np.flatnonzero(label[doc] == 0)
    # Before the first pass, a document's window with the largest log odds of words and n-grams stands for it.
    hint = np.append(net.inputs(f)[:, [0, WORD_DIM]].sum(axis=1), -9)
    score = np.concatenate([np.partition(hint[rows[k : k + BLOCK]], -3, axis=1)[:, -3:].sum(axis=1) for k in range(0, len(rows), BLOCK)])

    def top() -> np.ndarray:
        order = np.lexsort((score, doc))
        return order[np.append(np.flatnonzero(np.diff(doc[order])), len(order) - 1)]

    for step in range(steps):
        if step in (steps // 3, 2 * steps // 3):
            gates = net.gates(net.inputs(f))
            score = np.concatenate([net.forward(gates, rows[k : k + BLOCK]) for k in range(0, len(rows), BLOCK)])
        if step in (0, steps // 3, 2 * steps // 3):
            best = top()
            good, hard = best[label[doc[best]] == 1], best[label[doc[best]] == 0]
            hard = hard[np.argsort(-score[hard], kind="stable")[: max(64, len(hard) // 8)]]
        pick = np.concatenate([rng.choice(good, BATCH // 3), rng.choice(hard, BATCH // 3), rng.choice(negatives, BATCH - 2 * (BATCH // 3))])
        used, local = np.unique(rows[pick], return_inverse=True)
        local = local.reshape(-1, WINDOW) - (used[0] < 0)
        used = used[used >= 0]
        part = Features.__new__(Features)
        part.word, part.opening, part.counts = f.word[used], f.opening[used], f.counts[used]
        part.gram = grams(used)
        adam.rate = RATE * (1 - step / steps) + 1e-4
        # Some words lose their own vector at each step, so that openings and n-grams learn to tell words never met.
        _, g = net.gradients(part, local, (label[doc[pick]] == 1).astype(_F), rng.random(len(used)) < UNSEEN)
        adam.step(g)
    return net


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(raw, toxic) of the bounded sample of labelled documents. docs: doc_id, text; labels: doc_id, toxic."""
    known = labels.select("doc_id", F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    share = {c: min(1.0, most / counts[c]) if counts.get(c) else 0.0 for c, most in ((1, POSITIVES), (0, NEGATIVES))}
    draw = F.pmod(F.xxhash64("doc_id", F.lit(17)), F.lit(1_000_000)) < F.when(F.col("toxic") == 1, share[1]).otherwise(share[0]) * 1_000_000
    drawn = F.broadcast(known.filter(draw))  # about POSITIVES + NEGATIVES rows of two numbers, whatever the input
    return docs.select("doc_id", text_bytes(F.col("text")).alias("raw")).filter(F.octet_length("raw") <= TRAIN_BYTES).join(drawn, "doc_id").select("raw", "toxic")


def fit(docs: DataFrame, labels: DataFrame) -> Network:
    """A network trained on the bounded sample."""
    return trained_in_a_task(sample(docs, labels), train)


def scored_parts(net: Network, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray]]:
    """Scores of the texts from each first to each last (exclusive)."""
    for first, last, buf, offsets in W.chunks(column, SCORED):
        yield first, last, net.scores(W.split(buf, offsets))


def score(docs: DataFrame, net: Network, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs' key and score."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # two tables of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for b in batches:
            for first, last, found in scored_parts(net, b.column(1)):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, last - first), pa.array(found, pa.float64())], ["key", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), text_bytes(F.col(text)).alias("raw")).mapInArrow(run, f"key {kind}, score double").withColumnRenamed("key", key)


def score_rows(docs: DataFrame, net: Network, text: str = "text") -> DataFrame:
    """docs with one more column, score, or with underscores before that name if docs has it."""
    shared, at = docs.sparkSession.sparkContext.broadcast(net), len(docs.columns)
    (name,) = fresh(docs, "score")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        for b in batches:
            found = [x for *_, x in scored_parts(net, b.column(at))]
            columns = [b.column(k) for k in range(at)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(found) if found else [], pa.float64())], [*b.schema.names[:at], name])

    return docs.select("*", text_bytes(F.col(text)).alias("raw")).mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
