from __future__ import annotations

import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tesserae.llm import mixing as M


def test_tokens_are_words(spark):
    rows = ["a b  c", "", None, " x\ty\n\x0bz\r\x0c", "é ü 日本", "one", "a\x1cb\xa0c"]
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    assert [r.n for r in df.select(M.tokens(F.col("t")).alias("n")).collect()] == [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in rows]


def test_words_between_any_separators_are_counted(spark):
    rows = ["\n\t", " a", "\r\n" * 9 + "é\x85 b", "w " * 30_000, "x" * 300_000, "\x1c \x1f\x08\x0e", " $1 \\ . "]
    df = spark.createDataFrame([(t,) for t in rows], "t string")
    assert [r.n for r in df.select(M.tokens(F.col("t")).alias("n")).collect()] == [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in rows]


def test_exponent_for_repetition_and_entropy():
    shares = {"a": 0.9, "b": 0.09, "c": 0.01}
    a = M.solve(shares, max_repeat=3)
    assert math.isclose(M.repetition(shares, a), 3, rel_tol=1e-6)
    e = M.solve(shares, None, target_entropy=0.8)
    assert math.isclose(M.entropy(M.weights(shares, e)), 0.8, rel_tol=1e-6)
    assert M.entropy(M.weights(shares, M.solve(shares, None, target_entropy=9))) == pytest.approx(math.log(3))
    assert M.solve({"a": 1.0}) == 0 and M.solve({}) == 0
    assert M.solve(shares, 3, 0.8) == max(a, e) and M.solve(shares, None) == 1
    twice = {"a": 0.6, "b": 0.1}
    assert math.isclose(M.solve(twice, None, 1.2, {"a": 1, "b": 4}), M.solve({"a": 0.6, **{f"b{i}": 0.1 for i in range(4)}}, None, 1.2))


def docs(spark):
    rows = [(i, "w " * (1 + i % 7), "big", i) for i in range(900)] + [(1000 + i, "w w w", "mid", 0) for i in range(150)] + [(2000 + i, "w w", None, 0) for i in range(60)] + [(3000, "", "none", 0), (3001, None, "none", 0), (None, "w", "big", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, pass long")


def test_no_document_is_dropped_and_weights_hold(spark):
    df = docs(spark)
    out = M.mix(df, max_repeat=2.5)
    assert out.columns == ["doc_id", "text", "source", "pass", "block", "_pass", "weight", "place"] or "_pass" in out.columns
    rows = out.collect()
    counts = Counter((r.doc_id, r.source) for r in rows)
    assert len(counts) == df.count() and max(counts.values()) <= 3
    total = Counter()
    for r in rows:
        total[r.source] += len((r.text or "").split())
    weight = {r.source: r.weight for r in rows}
    for s in ("big", "mid", None):
        assert total[s] / sum(total.values()) == pytest.approx(weight[s], abs=0.01)
    assert weight["none"] == 0 and math.isclose(sum(weight.values()), 1)
    assert {r["_pass"] for r in rows if r.source == "none"} == {0}


def test_part_passes_take_whole_blocks_within_the_budget(spark):
    df = docs(spark)
    out = M.mix(df, budget=1500, blocks=64).collect()
    used = Counter()
    for r in out:
        used[r.source] += len((r.text or "").split())
    assert all(used[s] <= round(1500 * w) for s, w in {r.source: r.weight for r in out}.items() if w)


def order(spark, source, number, blocks):
    """Blocks in the order of a pass's permutation."""
    rows = spark.range(blocks).select("id", M.rank_of(F.col("id"), F.lit(source).cast("string"), F.lit(number), blocks).alias("r")).collect()
    assert sorted(r.r for r in rows) == list(range(blocks))
    return [r.id for r in sorted(rows, key=lambda r: r.r)]


def test_permutations_differ_by_source_and_pass(spark):
    seen = {tuple(order(spark, s, n, 64)) for s in ("big", "mid", None) for n in (0, 1, 2)}
    assert len(seen) == 9 and tuple(range(64)) not in seen


@pytest.mark.parametrize("budget", [700, 1500, 5000, 40_000])
def test_mixture_by_brute_force(spark, budget):
    """Whole passes, and blocks filled in by a pass's permutation, from plain loops over the rows."""
    rows = docs(spark).withColumn("b", M.block_of(F.col("doc_id"), 64)).collect()
    out = M.mix(docs(spark), budget=budget, blocks=64, max_repeat=2).collect()
    weight, want = {r.source: r.weight for r in out}, Counter()
    for s in {r.source for r in rows}:
        own = [r for r in rows if r.source == s]
        size = lambda r: len((r.text or "").split())
        total = sum(map(size, own))
        passes, left = divmod(round(weight.get(s, 0) * budget), total) if total else (1, 0)
        blocks = []
        for k in order(spark, s, passes, 64) if left else []:
            t = sum(size(r) for r in own if r.b == k)
            if t <= left and any(r.b == k for r in own):
                left -= t
                blocks.append(k)
        for r in own:
            want.update((r.doc_id, s, n) for n in range(passes + (r.b in blocks)))
    assert Counter((r.doc_id, r.source, r["_pass"]) for r in out) == want and sum(want.values()) > 0
    for s in ("big", "mid"):
        first = [r.block for r in sorted((r for r in out if r.source == s and r["_pass"] == 0 and r.place < 1), key=lambda r: r.place)]
        at = order(spark, s, 0, 64)
        assert [at.index(k) for k in first] == sorted(at.index(k) for k in first) and all(0 <= r.place <= 1 for r in out)


def test_the_query_s_exponent_lies_inside(spark, small):
    d = spark.read.parquet(f"{small}/documents.parquet")
    plan = M.plan(d, "doc_id", "text", "source", evenness=M.EVENNESS).collect()
    assert len({round(r.weight, 6) for r in plan}) > 1
    whole = sum(r.total for r in plan)
    slopes = {round(math.log(r.weight / plan[0].weight) / math.log(r.total / plan[0].total), 6) for r in plan if r.total != plan[0].total}
    assert len(slopes) == 1 and 0.1 < slopes.pop() < 0.95 and whole > 0


def test_clashing_columns(spark):
    df = docs(spark).selectExpr("*", "1 passes", "2 last_block", "3 plan_source", "4 part", "5 total", "6 weight", "7 plan_part")
    out = M.mix(df)
    assert out.columns[: len(df.columns)] == df.columns and out.filter("passes = 1 and last_block = 2 and plan_source = 3 and part = 4 and total = 5 and weight = 6 and plan_part = 7").count() == out.count() > 0


def test_no_rows(spark):
    assert M.mix(docs(spark).limit(0)).count() == 0
