"""Operators without SQL by brute force: the seeded shuffle, greedy stories and the diverse feed."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tesserae.functions import story
from tesserae.functions.fixed import LINEAGE_REASONS, RESOLVER_PATHS
from tesserae.operators import stories
from tesserae.plans.registry import QUERIES


def shuffled(items, seed):
    out, s = list(items), seed % 2**32 or 1
    for i in range(len(out) - 1, 0, -1):
        s = (s * 1664525 + 1013904223) % 2**32
        j = s % (i + 1)
        out[i], out[j] = out[j], out[i]
    return out


def test_lcg_shuffle(spark, small):
    rows = QUERIES["lcg_shuffle"](spark, small).collect()
    assert rows and all(r.shuffled == shuffled(r.keys, r.o_custkey) for r in rows)
    cases = [([], 1), ([5], 0), ([1, 2, 3, 4, 5, 6, 7], 0), ([1, 2, 3], -1), ([None, 2, 2], 4294967301)]
    got = spark.createDataFrame(cases, "a array<int>, seed long").select("a", "seed", story.lcg_shuffled(F.col("a"), F.col("seed")).alias("b")).collect()
    assert all(r.b == shuffled(r.a, r.seed) for r in got)


def test_greedy_stories(spark):
    rnd = random.Random(1)
    start = datetime(2024, 1, 1)
    rows = [(i, start + timedelta(hours=rnd.randrange(0, 60)), rnd.sample("abcdefghij", rnd.randrange(1, 7)), rnd.sample("pqr", rnd.randrange(0, 3)), rnd.sample("xyz", rnd.randrange(0, 3)), i % 3) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, at timestamp, tokens array<string>, bigrams array<string>, entities array<string>, block int")
    got = {r.id: r.story for r in stories.greedy_stories(df, "block").collect()}
    again = {r.id: r.story for r in stories.greedy_stories(df.orderBy(F.desc("id")), "block").collect()}
    assert got == again and len(got) == 120
    want: dict = {}
    for block in range(3):
        left = sorted((r for r in rows if r[5] == block), key=lambda r: (-r[1].timestamp(), r[0]))
        while left:
            seed, rest = left[0], []
            want[seed[0]] = seed[0]
            for r in left[1:]:
                words, sw = set(r[2]), set(seed[2])
                sim = len(words & sw) / len(words | sw)
                pairs, named = len(set(r[3]) & set(seed[3])), len(set(r[4]) & set(seed[4]))
                near = abs(r[1] - seed[1]) <= timedelta(hours=48)
                if near and (named >= 2 or sim >= 0.4 or (pairs and sim >= 0.26) or (named and pairs and sim >= 0.18)):
                    want[r[0]] = seed[0]
                else:
                    rest.append(r)
            left = rest
    assert got == want


def test_outcomes_are_the_fixed_ones(spark, small):
    assert {r.path for r in QUERIES["resolver_decision"](spark, small).select("path").distinct().collect()} <= set(RESOLVER_PATHS)
    unknown = QUERIES["lineage_cascade"](spark, small).filter("relation = 'unknown'").select("rule").distinct().collect()
    assert unknown and {r.rule for r in unknown} <= set(LINEAGE_REASONS)


def test_parts_of_stories(spark):
    df = spark.createDataFrame([("6,6 tỉ euro", None, 6.6), ("500", None, 500.0), ("tỉnh", "usd", 3.0), ("1", "ty_vnd", 1.0), ("2", "usd_bn", 2.0)], "t string, u string, n double")
    assert [r.v for r in df.select(story.approximate_usd(F.col("n"), F.col("t"), F.col("u")).alias("v")).collect()] == [6.6e9 * 1.08, None, 3.0, 1e9 / 25000, 2e9]
    one = spark.createDataFrame([("12.50", " 7 ", "1e3", "x7", "", None)], "a string, b string, c string, d string, e string, f string")
    assert tuple(one.select(*(story.canonical_value(F.col(c)).alias(c) for c in "abcdef")).first()) == ("12.5", "7", "1000", "x7", "", None)
    sig = one.select(story.event_signature(F.lit("eco"), F.lit("46 bong da nam tai viet nam 2026 gia vang"), ["gia", "vang"], ["viet_nam"]).alias("s")).first().s
    assert sig == "eco|bong gia nam nam tai vang viet|46|bong_da nam_tai tai_viet"


def test_diverse_feed(spark, small):
    """The feed from plain loops over the scored head."""
    from tesserae.plans import claims

    items = claims.radar_items(spark.read.parquet(f"{small}/events.parquet"), F.lit("2024-01-31").cast("timestamp_ntz")).filter("score >= 8").collect()
    kept: list = []
    for r in sorted(items, key=lambda r: (-r.score, r.event_id))[:500]:
        hour = r.ts.replace(minute=0, second=0, microsecond=0)
        if len(kept) < 40 and all(k.user_id != r.user_id or (k.event_type != r.event_type and k.ts.replace(minute=0, second=0, microsecond=0) != hour) for k in kept):
            kept.append(r)
    got = QUERIES["greedy_diverse_feed"](spark, small).orderBy("place").collect()
    assert [(r.event_id, r.place) for r in got] == [(r.event_id, n) for n, r in enumerate(kept, 1)] and len(got) > 1
