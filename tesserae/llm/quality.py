"""Document quality by ordinal cumulative-link regression on graded ratings.

One weight vector is shared by all grades: over hashed words (log counts, unit length) and over buckets of shape measures
(shares of capitals, digits, symbols and non-ASCII bytes, word length, repetition). Grade thresholds t_1 < ... < t_K-1,
kept in order by positive steps, cut the same line: P(grade <= k) = sigmoid(t_k - score). The expected grade and the tail
probabilities P(grade >= k) follow, and documents of tail probability KEEP or more at the grade asked for are selected.

Grades come from the labels together: 0 for low quality, 1 for good quality that is toxic, 2 for good quality that is not;
where there is no word on toxicity, 2. The query selects by P(grade >= 1).

Training (one task, bounded): at most SAMPLE rated documents of at most TRAIN_BYTES, chosen by a hash of their id among
those whose crc32(id) mod 4 is not 2. Any distinct ratings serve as grades; with one grade or none the model is constant.

Defined results: null and empty texts have no features and get the base score; equal texts get equal values (6
decimals); null ratings and ratings without a document are ignored, of clashing ones the lowest holds; repeated rows are
scored each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm import words as W
from tesserae.llm.common import table, text_bytes, trained_in_a_task
from tesserae.llm.toxicity import held_out

BUCKETS = 1 << 17
BINS = 12
SAMPLE, TRAIN_BYTES = 4000, 20_000
STEPS, BATCH, RATE, DECAY = 900, 128, 0.03, 1e-4
KEEP = 0.5
MEASURES = ("capitals", "digits", "symbols", "beyond_ascii", "word_length", "repeated_next", "distinct", "ends_odd")
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:'\"-"]] = True


def _share(flags: np.ndarray, bounds: np.ndarray, of: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return (total[bounds[1:]] - total[bounds[:-1]]) / np.maximum(of, 1)


def features(words: W.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, bucket and value of each non-zero feature, sorted by document."""
    n, buf = len(words.offsets) - 1, words.buf
    h, counts = words.hashes(), np.diff(words.bounds)
    doc = np.repeat(np.arange(n), counts)
    order = np.lexsort((h, doc))
    first = np.ones(len(h), bool)
    first[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
    at = np.flatnonzero(first)
    d, b = doc[order][at], (h[order][at] % np.uint64(BUCKETS)).astype(np.int64)
    v = np.log1p(np.diff(np.append(at, len(h))))
    norm = np.sqrt(np.bincount(d, v * v, n))
    v = v / norm[d]
    letters = np.diff(words.offsets)
    sizes = words.ends - words.starts
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    last = buf[words.ends - 1] if len(h) else buf[:0]
    measures = np.stack([
        _share((buf >= 65) & (buf <= 90), words.offsets, letters), _share((buf >= 48) & (buf <= 57), words.offsets, letters), _share(_SYMBOL[buf], words.offsets, letters), _share(buf >= 128, words.offsets, letters),
        _share(sizes, words.bounds, counts) / 16, _share(same, words.bounds, counts), np.bincount(d, minlength=n) / np.maximum(counts, 1), _share(_SYMBOL[last], words.bounds, counts),
    ])
    bins = np.minimum(BINS - 1, np.sqrt(np.minimum(measures, 1)) * BINS).astype(np.int64)
    some = np.flatnonzero(counts > 0)
    shape_d = np.repeat(some, len(MEASURES))
    shape_b = (BUCKETS + np.arange(len(MEASURES))[None, :] * BINS + bins.T[some]).ravel()
    d, b, v = np.concatenate([d, shape_d]), np.concatenate([b, shape_b]), np.concatenate([v, np.full(len(shape_d), 0.5)])
    order = np.argsort(d, kind="stable")
    return d[order], b[order], v[order]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Ordinal:
    """grades ascending; weights; the first threshold and the logs of the steps to the others."""

    def __init__(self, grades: list[float], weights: np.ndarray, first: float = 0.0, steps: np.ndarray | None = None) -> None:
        self.grades, self.weights, self.first = np.array(grades, np.float64), weights, first
        self.steps = np.zeros(max(0, len(grades) - 2)) if steps is None else steps

    @property
    def thresholds(self) -> np.ndarray:
        return self.first + np.concatenate([[0.0], np.cumsum(np.exp(self.steps))])

    def line(self, words: W.Words) -> np.ndarray:
        d, b, v = features(words)
        return np.bincount(d, self.weights[b] * v, len(words.offsets) - 1)

    def at_most(self, line: np.ndarray) -> np.ndarray:
        """P(grade <= k) for each document and k, the last 1."""
        return np.concatenate([_sigmoid(self.thresholds[None, :] - line[:, None]), np.ones((len(line), 1))], axis=1)

    def judged(self, words: W.Words, tail: float | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade, and probability of grade tail (the highest, if not given) or more."""
        expected, tails = self.graded(words)
        if len(self.grades) < 2:
            return expected, np.ones(len(expected))
        k = int(np.searchsorted(self.grades, self.grades[-1] if tail is None else tail))
        return expected, tails[:, k] if k < len(self.grades) else np.zeros(len(expected))

    def graded(self, words: W.Words) -> tuple[np.ndarray, np.ndarray]:
        """Expected grade, and the probability of each grade or a higher one (a column a grade; the first is 1)."""
        n = len(words.offsets) - 1
        if len(self.grades) < 2:
            return np.full(n, self.grades[0] if len(self.grades) else 0.0), np.ones((n, len(self.grades)))
        most = self.at_most(self.line(words))
        return np.round(np.diff(most, axis=1, prepend=0) @ self.grades, 6), np.round(np.concatenate([np.ones((n, 1)), 1 - most[:, :-1]], axis=1), 6)


def train(texts: list[bytes], ratings: list[float], steps: int = STEPS, seed: int = 3) -> Ordinal:
    grades = sorted(set(ratings))
    model = Ordinal(grades, np.zeros(BUCKETS + len(MEASURES) * BINS))
    if len(grades) < 2:
        return model
    parts = [(first, features(W.split(buf, offsets))) for first, _, buf, offsets in W.chunks(pa.array(texts, pa.binary()))]
    d, b, v = np.concatenate([f[0] + first for first, f in parts]), np.concatenate([f[1] for _, f in parts]), np.concatenate([f[2] for _, f in parts])
    del parts
    starts = np.searchsorted(d, np.arange(len(texts) + 1))
    y = np.searchsorted(grades, ratings)
    share = np.cumsum(np.bincount(y, minlength=len(grades)))[:-1] / len(y)
    cuts = np.log(share / (1 - share))
    model.first, model.steps = float(cuts[0]), np.log(np.maximum(np.diff(cuts), 1e-3))
    rng, square, square_t = np.random.default_rng(seed), np.full(len(model.weights), 1e-8), np.full(len(grades) - 1, 1e-8)
    for step in range(steps):
        pick = rng.integers(0, len(texts), BATCH)
        sizes = starts[pick + 1] - starts[pick]
        at = np.repeat(starts[pick], sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        row = np.repeat(np.arange(BATCH), sizes)
        line = np.bincount(row, model.weights[b[at]] * v[at], BATCH)
        cum = np.concatenate([np.zeros((BATCH, 1)), model.at_most(line)], axis=1)
        density = cum * (1 - cum)
        k = y[pick]
        i = np.arange(BATCH)
        p = np.maximum(cum[i, k + 1] - cum[i, k], 1e-9)
        # The loss is -log p; its slopes at the line and at the two thresholds around the grade.
        dline = (density[i, k + 1] - density[i, k]) / p / BATCH
        dcut = np.bincount(np.append(k, k - 1).clip(0, None), np.append(np.where(k < len(grades) - 1, -density[i, k + 1] / p, 0), np.where(k > 0, density[i, k] / p, 0)), len(grades))[:-1] / BATCH
        g = np.bincount(b[at], dline[row] * v[at], len(model.weights))
        used = g != 0
        square[used] += g[used] ** 2
        model.weights[used] -= RATE * 10 * g[used] / np.sqrt(square[used]) * (1 - step / steps + 0.02)
        model.weights *= 1 - DECAY
        dsteps = np.exp(model.steps) * np.cumsum(dcut[::-1])[::-1][1:]
        dt = np.append(dcut.sum(), dsteps)
        square_t += dt**2
        move = RATE * dt / np.sqrt(square_t)
        model.first -= float(move[0])
        model.steps = model.steps - move[1:]
    return model


def grade(quality: str = "quality", toxic: str = "toxic") -> Column:
    """0 for low quality, 1 for good but toxic, 2 for good."""
    return F.when(F.col(quality) == 0, 0.0).when((F.col(quality) == 1) & (F.col(toxic) == 1), 1.0).when(F.col(quality) == 1, 2.0)


def sample(docs: DataFrame, ratings: DataFrame, rating: str | Column = "quality") -> DataFrame:
    """(raw, grade) of the bounded sample of rated documents. docs: doc_id, text; ratings: doc_id and a number."""
    rating = F.col(rating) if isinstance(rating, str) else rating
    known = ratings.select("doc_id", rating.cast("double").alias("grade")).filter(F.col("grade").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("grade").alias("grade"))
    share = min(1.0, SAMPLE / max(1, known.count()))
    drawn = F.broadcast(known.filter(F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1_000_000)) < share * 1_000_000))  # about SAMPLE rows of two numbers
    return docs.select("doc_id", text_bytes(F.col("text")).alias("raw")).filter(F.octet_length("raw") <= TRAIN_BYTES).join(drawn, "doc_id").select("raw", "grade")


def fit(docs: DataFrame, ratings: DataFrame, rating: str | Column = "quality") -> Ordinal:
    return trained_in_a_task(sample(docs, ratings, rating), train)


def score(docs: DataFrame, model: Ordinal, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs' key, expected_grade and tails, the probability of each of the model's grades or a higher one."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a table of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, last, buf, offsets in W.chunks(b.column(1)):
                expected, tails = shared.value.graded(W.split(buf, offsets))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(tails) + 1, dtype=np.int32) * tails.shape[1]), pa.array(tails.ravel(), pa.float64()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, last - first), pa.array(expected, pa.float64()), lists], ["key", "expected_grade", "tails"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("key"), text_bytes(F.col(text)).alias("raw")).mapInArrow(run, f"key {kind}, expected_grade double, tails array<double>").withColumnRenamed("key", key)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tail_probability is P(grade >= 1), top_probability P(grade >= 2); with fewer grades the probability of the highest one."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), grade())
    tail = lambda k: F.coalesce(F.get("tails", F.lit(min(k, max(0, len(model.grades) - 1)))), F.lit(1.0))
    scored = score(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "expected_grade", tail(1).alias("tail_probability"), tail(2).alias("top_probability"))
    return scored.withColumn("selected", F.col("tail_probability") >= KEEP)
