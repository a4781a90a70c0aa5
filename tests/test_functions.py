"""Functions, versions and graph operators on hand-made rows."""

from __future__ import annotations

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tesserae.functions import numeric as n
from tesserae.functions import text as t
from tesserae.operators import graph
from tesserae.operators import versions as v


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_folding(spark):
    assert one(spark, t.normalize_text(F.col("s")), s="  Việt  Nam: ĐẸP! ") == "viet nam dep"
    assert one(spark, t.fold_search(F.col("s")), s="Đường Ấp") == "đuong ap"
    assert one(spark, t.strip_marks(F.col("s")), s="é") == "e"


def test_tokens_numbers_and_keys(spark):
    assert one(spark, t.number_tokens(F.col("s")), s="In 2024, 1,500 and 7 or 12.5%") == ["1500", "125"]
    assert one(spark, t.title_key(F.col("s")), s="Big news today - The Outlet") == "big news today"
    assert one(spark, t.locale_number(F.col("s"), F.col("l")), s="1.234,5", l="vi") == 1234.5
    assert one(spark, t.locale_number(F.col("s"), F.col("l")), s="1,234.5", l="en") == 1234.5
    assert one(spark, t.canonical_url(F.col("s")), s="https://x.org/a/?utm_source=b&id=1&fbclid=z#top") == "https://x.org/a/?id=1"
    assert one(spark, t.has_word(F.col("s"), "C++"), s="uses c++ daily") and not one(spark, t.has_word(F.col("s"), "cat"), s="concatenate")
    assert one(spark, t.jaccard(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"))), s=1) == 0.5
    assert one(spark, t.shingles(F.split("s", " "), 3), s="a b") == ["a b"]
    assert t.fnv1a_32(b"a") == 0xE40C292C


def test_decimals(spark):
    for s, want in (("100", "100"), ("100.000", "100"), ("-0.0", "0"), ("+007.50", "7.5"), (".5", "0.5"), ("1e3", None), ("abc", None), ("9007199254740993", "9007199254740993")):
        assert one(spark, n.decimal_text(F.col("s")), s=s) == want
    assert one(spark, n.decimal(F.col("s")) == n.decimal(F.lit("100")), s="100.000")
    assert one(spark, n.shifted(F.col("s").cast("decimal(18,8)"), 3), s="1.25") == Decimal(1250)
    assert one(spark, n.is_bigint(F.col("s")), s="9223372036854775807") and not one(spark, n.is_bigint(F.col("s")), s="9223372036854775808")


def test_versions_are_idempotent(spark):
    rows = spark.createDataFrame([("k", 1, "a"), ("k", 2, "a"), ("k", 3, None), ("k", 4, None), ("k", 5, "a")], "k string, at int, f string")
    first = v.numbered(rows, ["k"], ["at"], ["f"])
    assert [(r.at, r.version_no, r.previous_version_no) for r in first.orderBy("at").collect()] == [(1, 1, None), (3, 2, 1), (5, 3, 2)]
    again = v.numbered(first.select("k", "at", "f").unionByName(rows), ["k"], ["at"], ["f"])
    assert again.count() == 3


def test_backward_as_of_is_strict(spark):
    left = spark.createDataFrame([("k", 1), ("k", 5), ("j", 9)], "k string, t int")
    right = spark.createDataFrame([("k", 1, 10, "x"), ("k", 4, 11, "y"), ("k", 4, 12, "z"), ("k", 5, 13, "w")], "k string, rt int, id int, val string")
    got = {(r.k, r.t): r.val for r in v.backward_as_of(left, right, ["k"], "t", "rt", ["val"], "id").collect()}
    assert got == {("k", 1): None, ("k", 5): "z", ("j", 9): None}


def test_components_against_union_find(spark):
    rnd = random.Random(5)
    edges = [(rnd.randrange(200), rnd.randrange(200)) for _ in range(150)] + [(i, i + 1) for i in range(300, 340)] + [(500, 500), (None, 3)]
    parent: dict[int, int] = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert got == {x: find(x) for x in parent}


def test_components_of_no_edges(spark):
    assert graph.components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_roots_stop_at_hops_and_unknown_parents(spark):
    chain = [(i, i - 1 if i else None) for i in range(12)] + [(100, 999), (200, 201), (201, 200)]
    got = {r.child: (r.root, r.hops) for r in graph.roots(spark.createDataFrame(chain, "child int, parent int"), 8).collect()}
    assert got[8] == (0, 8) and got[11] == (3, 8) and got[0] == (0, 0) and got[200][1] == 8


@pytest.mark.parametrize("few,tables", [(graph.FEW, 2), (0, None)])
def test_few_links_need_no_passes(spark, monkeypatch, few, tables):
    """A path in any order, a star and a far pair: in one task two tables are written, by passes one each; the results are the same."""
    made = []
    monkeypatch.setattr(graph, "stored", lambda df, label, f=graph.stored: made.append(label) or f(df, label))
    monkeypatch.setattr(graph, "FEW", few)
    path = [(k * 37) % 101 for k in range(101)]
    edges = [*zip(path[1:], path[:-1]), *((1000, 1000 + k) for k in range(5)), (1 << 60, -5), (7, 7), (None, 1), (path[0], path[1])]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == dict.fromkeys(path, 0) | dict.fromkeys(range(1000, 1005), 1000) | {1 << 60: -5, -5: -5}
    assert len(made) == tables if tables else len(made) > 3
