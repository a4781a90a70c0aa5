"""The similarity join, its reductions and the queries on it, by brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from tesserae.operators import similar as S
from tesserae.plans.registry import QUERIES


def sets_of(seed: int, groups: int = 12, each: int = 30) -> dict[int, list[str]]:
    """Near copies in groups, some of them linked, and sets by themselves."""
    rnd = random.Random(seed)
    out: dict[int, list[str]] = {}
    for g in range(groups):
        base = [f"w{rnd.randrange(400)}" for _ in range(rnd.choice([4, 12, 40]))]
        for _ in range(each):
            own = [x for x in base if rnd.random() < 0.9] + [f"w{rnd.randrange(400)}" for _ in range(rnd.randrange(4))]
            out[len(out) * 7 - 50] = list(dict.fromkeys(own)) or ["none"]
    return out


def brute(sets: dict[int, list[str]], least: float) -> dict[tuple[int, int], float]:
    found = {}
    for a in sets:
        for b in sets:
            if a < b:
                both = len({*sets[a]} & {*sets[b]})
                if (sim := round(both / (len(sets[a]) + len(sets[b]) - both), 6)) >= least:
                    found[a, b] = sim
    return found


@pytest.mark.parametrize("block,small,columns", [(1024, 24, 4096), (7, 0, 5), (20, 4, 64)])
def test_pairs_are_those_of_brute_force_once_each(spark, monkeypatch, block, small, columns):
    for name, v in (("BLOCK", block), ("SMALL", small), ("COLUMNS", columns)):
        monkeypatch.setattr(S, name, v)
    sets = sets_of(block)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        df = spark.createDataFrame(list(sets.items()), "rep long, sh array<string>")
        got = sorted((r.a, r.b, r.sim) for r in S.similar(df, 0.6).collect())
        best = {(r.b, r.a, r.sim) for r in S.similar(df, 0.6, S.senior).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = brute(sets, 0.6)
    assert len(want) > 1000 and got == sorted((a, b, s) for (a, b), s in want.items())
    for b in {b for _, b in want}:
        sim, a = max((s, -a) for (a, y), s in want.items() if y == b)
        assert (b, -a, sim) in best


def test_senior_keeps_one_pair_of_each():
    a, b, sim = S.senior(np.array([3, 1, 2, 9]), np.array([5, 5, 5, 7]), np.array([0.7, 0.8, 0.8, 0.6]))
    assert list(zip(a.tolist(), b.tolist(), sim.tolist(), strict=True)) == [(1, 5, 0.8), (9, 7, 0.6)]
    assert all(len(x) == 0 for x in S.senior(*(np.array([], d) for d in (np.int64, np.int64, float))))


def docs(spark, path, titles):
    spark.createDataFrame([(i, t + ".\nrest", "en", "abc"[i % 3]) for i, t in enumerate(titles)], "doc_id long, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    return str(path)


def near_titles(n: int) -> list[str]:
    """Near copies of one title: each has one word of its own at the end."""
    return [" ".join([*(f"word{k}" for k in range(20)), f"own{i}"]) for i in range(n)]


def test_lineage_gathers_one_pair_a_title(spark, tmp_path):
    """What leaves the join for the best parents of n near copies, each with a copy, is n rows and not n * n."""
    n = 60
    d = docs(spark, tmp_path, near_titles(n) * 2)
    from tesserae.plans import texts

    titles = texts.classed(texts.titled(texts._docs(spark, d)))
    assert texts.similar_titles(titles, keep=S.senior).count() == n - 1
    rows = {r.child: (r.parent, r.sim) for r in QUERIES["lineage_similarity"](spark, d).collect()}
    sim = round(18 / 20, 6)
    assert rows == {i: (0, sim) if i < n else (i - n, 1.0) for i in range(1, 2 * n)}


def test_components_come_from_as_few_pairs_as_link_the_nodes(spark, tmp_path):
    rnd = random.Random(3)
    a, b = np.array([rnd.randrange(300) for _ in range(200)]), np.array([300 + rnd.randrange(300) for _ in range(200)])
    x, y, _ = S.forest(a, b, np.ones(200))

    def roots(edges):
        root = list(range(600))
        for p, q in edges:
            lo, hi = sorted((root[p], root[q]))
            root = [lo if r == hi else r for r in root]
        return root

    assert roots(zip(a, b, strict=True)) == roots(zip(x, y, strict=True)) and len(x) == len({*a, *b}) - len({roots(zip(a, b, strict=True))[k] for k in {*a, *b}})
    from tesserae.plans import texts

    d = docs(spark, tmp_path, near_titles(60))
    assert texts.similar_titles(texts.classed(texts.titled(texts._docs(spark, d))), keep=S.forest).count() == 59
    assert {(r.node, r.component) for r in QUERIES["near_dup_components"](spark, d).collect()} == {(i, 0) for i in range(60)}


@pytest.mark.parametrize("spread,most", [(2, 1024), (1, 1024), (1, 15)])
def test_blocks_of_several_tiles_find_the_same(spark, monkeypatch, spread, most):
    for name, v in (("BLOCK", 7), ("SPREAD", spread), ("MOST", most)):
        monkeypatch.setattr(S, name, v)
    sets = sets_of(11, groups=6, each=70)
    df = spark.createDataFrame(list(sets.items()), "rep long, sh array<string>")
    want = brute(sets, 0.6)
    assert len(want) > 1000 and sorted((r.a, r.b, r.sim) for r in S.similar(df, 0.6).collect()) == sorted((a, b, s) for (a, b), s in want.items())
    best = {(r.b, r.a, r.sim) for r in S.similar(df, 0.6, S.senior).collect()}
    for b in {b for _, b in want}:
        sim, a = max((s, -a) for (a, y), s in want.items() if y == b)
        assert (b, -a, sim) in best


def test_long_lists_are_dealt_in_proportion(spark):
    """A set is copied SPREAD times at most, up to SPREAD x MOST sets in a list."""
    c = [2, 1024, 1025, 8192, 20_000, S.SPREAD * S.MOST, 1 << 20]
    got = [r.n for r in spark.createDataFrame([(x,) for x in c], "c long").select("c", S._blocks(S.F.col("c")).alias("n")).orderBy("c").collect()]
    assert got == [1, 1, 2, 8, 8, 8, 64]
