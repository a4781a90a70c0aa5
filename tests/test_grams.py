"""Pairs of words counted in numpy, against Spark's folding and brute force."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tesserae.functions import grams
from tesserae.functions import text as t
from tesserae.plans.registry import QUERIES


def fold(texts, marks="\u0301"):
    raw = [x.encode() for x in texts]
    offsets = np.cumsum([0, *map(len, raw)])
    out, offsets = grams.folded(np.frombuffer(b"".join(raw), np.uint8), offsets, marks)
    return [out[a:b].tobytes().decode().strip() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def test_every_character_is_folded_as_by_spark(spark):
    points = [chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["a" + "b".join(points[k : k + 64]) + "c" for k in range(0, len(points), 64)]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, s string").select("k", t.normalize_text(F.col("s")).alias("s")).orderBy("k").collect()
    assert [(k, x) for k, x in enumerate(fold(texts, grams.marks(spark))) if x != rows[k].s] == []


def test_pairs_are_counted_once_a_text(monkeypatch):
    texts = ["", None, "One two, one  TWO one", "two\n", "é́ È", "one", "two one", "x" * 5000 + " one two", "one two one", "--", "đĐ one\ttwo"] * 3
    want = Counter()
    for x in texts:
        w = fold([x or ""])[0].split()
        want.update({f"{a} {b}" for a, b in zip(w[:-1], w[1:], strict=True)})
    assert want["one two"] == 12 and want["e e"] == 3
    for chunk, held in ((1, 1), (64, 100), (1 << 20, 1 << 20)):
        monkeypatch.setattr(grams, "CHUNK_BYTES", chunk)
        monkeypatch.setattr(grams, "HELD_BYTES", held)
        got = Counter()
        batch = pa.record_batch({"text": pa.array([x if x is None else x.encode() for x in ["cut off", *texts]], pa.binary())}).slice(1)
        for b in grams.counted("\u0301")(iter([batch.slice(0, 7), batch.slice(7), batch.slice(0, 0)])):
            for g, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                got[g] += n
        assert got == want


def test_no_row_for_each_pair_of_each_text(spark, small):
    """Pairs are counted in a task before they are rows: exploded, they took most of the time."""
    plan = QUERIES["bigram_trending"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "Generate" not in plan
