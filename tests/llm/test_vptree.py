from __future__ import annotations

import numpy as np
import pytest

from tesserae.llm import vptree


def brute(rows, k, every):
    ok = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and all(c is not None and np.isfinite(c) for c in v) and any(v)]
    out = set()
    for i, q in ok:
        if i % every == 0:
            d = sorted((float(np.sqrt(((v - q) ** 2).sum())), j) for j, v in ok if j != i)[:k]
            out |= {(i, r, j, round(s, 9)) for r, (s, j) in enumerate(d, 1)}
    return out


def found(spark, rows, **how):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string")
    return {(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in vptree.search(df, **how).collect()}


def rows(n=700, dim=6, seed=0):
    r = np.random.default_rng(seed)
    out = [(int(i), [float(x) for x in v]) for i, v in enumerate(r.normal(size=(n, dim)).round(1))]
    out[5:25] = [(i, out[200][1]) for i in range(5, 25)]  # ties
    out += [(9000, None), (9001, [0.0] * dim), (9002, [float("nan")] * dim), (9003, [None] * dim), (9004, [float("inf")] * dim), (9005, []), (None, [1.0] * dim)]
    return out


@pytest.mark.parametrize("shard_rows", [10_000, 100])
def test_exact_at_factor_one(spark, shard_rows):
    data = rows()
    assert found(spark, data, every=20, shard_rows=shard_rows) == brute(data, 10, 20)


def test_relaxed_recall(spark):
    data = rows()
    want = {(q, j) for q, _, j, _ in brute(data, 10, 20)}
    got = {(q, j) for q, _, j, _ in found(spark, data, every=20, relax=1.5, shard_rows=200)}
    assert len(want & got) / len(want) >= 0.9


def test_few_and_none(spark):
    assert found(spark, [(0, [1.0, 0.0]), (1, [0.0, 1.0])]) == {(0, 1, 1, round(2**0.5, 9))}
    assert found(spark, [(0, [1.0])]) == set()
    assert vptree.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_all_equal_vectors(spark):
    data = [(i, [1.0, 2.0]) for i in range(600)]
    assert found(spark, data, every=100) == brute(data, 10, 100)


@pytest.mark.parametrize("shard_rows", [10_000, 60])
def test_repeated_rows(spark, shard_rows):
    data = rows(300, 4)
    twice = [*data, (100, data[100][1]), (100, data[100][1]), (200, data[31][1])]
    got = found(spark, twice, every=100, shard_rows=shard_rows)
    assert {x for x in got if x[0] == 0} == {x for x in brute([*data, *data[100:101] * 2, (200, data[31][1])], 10, 100) if x[0] == 0}
    assert sorted(x[1] for x in got if x[0] == 100) == sorted(x[1] for x in got if x[0] == 200) == list(range(1, 11))
    assert {x for x in got if x[0] == 100} == {x for x in brute([*data[:100], (100, data[100][1]), *data[101:], (200, data[31][1])], 10, 100) if x[0] == 100}


def test_a_query_leaves_regions_out(spark):
    r = np.random.default_rng(3)
    centres = r.normal(size=(16, 8)) * 20
    x = (centres[np.arange(4000) % 16] + r.normal(size=(4000, 8)))
    tree = vptree.Regions(x[::3], 16)
    q = x[::100]
    d = np.sort(np.sqrt(((q[:, None] - x[None]) ** 2).sum(axis=2)), axis=1)[:, 10]
    row, region = tree.reached(q, d, 1.0)
    assert tree.leaves == 16 and len(row) < len(q) * 4
    of = tree.of(x)
    for k in range(len(q)):  # nothing within a query's limit lies elsewhere
        near = np.sqrt(((x - q[k]) ** 2).sum(axis=1)) <= d[k]
        assert set(of[near]) <= set(region[row == k])
    data = [(i, v.tolist()) for i, v in enumerate(x[:1600])]
    assert found(spark, data, every=100, shard_rows=100) == brute(data, 10, 100)


def test_relaxed_recall_on_the_table(spark, small):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    want = {(q, j) for q, _, j, _ in brute(rows, 10, 10)}
    got = {(q, j) for q, _, j, _ in found(spark, rows, every=10, relax=1.2, shard_rows=100)}
    assert len(want & got) >= 0.9 * len(want)


def test_query_is_exact_on_the_table(spark, small):
    data = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{small}/embeddings.parquet").collect()]
    got = {(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in vptree.op4_nearest(spark, small).collect()}
    assert got == brute(data, 10, 100)
