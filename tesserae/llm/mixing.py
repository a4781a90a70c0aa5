"""Mixing sources to target weights by temperature.

Token shares p_s of the sources are raised to an exponent a in [0, 1] and normalised: w_s ~ p_s ** a. a = 1 keeps the
corpus, a = 0 gives equal weights. a is bisected for a target entropy of w, and for the largest repetition of a source,
w_s / p_s over its smallest, to stay within a limit; the larger exponent holds. The query's target lies halfway between the
corpus's entropy and that of equal weights. The budget of tokens defaults to the least with which every source is passed
through once at least, so that mixing repeats and drops nothing.

A source's tokens then are whole passes and a part of one. Documents are dealt to blocks by a hash of id and seed. Each pass
of a source visits the blocks in a permutation of its own, drawn by source, pass and seed; the part takes blocks in the order
of its pass's permutation, skips those that the rest of the budget has no room for, and goes on. place orders the mixture: a
document's place within its source's tokens as a share of that source's target (1 for filled-in blocks), so that sources keep
their weights all along.

Only sums of (source, block) are shuffled, and one task sees at most the blocks of a source; the bisection sees a table of
shares rounded to 4096ths of a doubling with their numbers of sources. The plan has one row a source.

Defined results: tokens are runs of bytes outside 0x20 and 0x09-0x0D; null and empty texts have none; a null source is a
source; a source without tokens gets weight 0 and one pass; repeated rows are dealt alike and repeated alike; without
rows there is no output. Extra columns are kept, whatever their names.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.llm.common import fresh, stored, table

MAX_REPEAT = 2.0
EVENNESS = 0.5
#: A power of two of blocks; a plan's row has a bit for each.
BLOCKS = 1 << 14
SEED = 42
HALVINGS = 60
STEPS = 4096


def tokens(text: Column) -> Column:
    """Words of a text: the length once separators before the first word are gone, and each word with those after it is one mark. (translate and regexp_count make an object a character and a word.)"""
    begun = F.ltrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\u000b\f\r"))
    return F.length(F.regexp_replace(begun, r"[^ \t-\r]++[ \t-\r]*+", ".")).cast("long")


def weights(shares: dict, exponent: float, counts: dict | None = None) -> dict:
    """The weight of a source of each share; counts: how many sources have it, one if not given."""
    raised = {s: p**exponent if p > 0 else 0.0 for s, p in shares.items()}
    total = sum(x * (counts[s] if counts else 1) for s, x in raised.items())
    return {s: x / total for s, x in raised.items()} if total else raised


def entropy(w: dict, counts: dict | None = None) -> float:
    return -sum(x * math.log(x) * (counts[s] if counts else 1) for s, x in w.items() if x > 0)


def repetition(shares: dict, exponent: float) -> float:
    """The largest number of passes if the source passed least often is passed once."""
    ratios = [x / shares[s] for s, x in weights(shares, exponent).items() if shares[s] > 0]
    return max(ratios) / min(ratios) if ratios else 1.0


def solve(shares: dict, max_repeat: float | None = MAX_REPEAT, target_entropy: float | None = None, counts: dict | None = None) -> float:
    """The smallest exponent in [0, 1] with which the repetition is max_repeat at most and the entropy target_entropy at most, as far as the corpus allows."""
    tests = []
    if target_entropy is not None:
        tests.append(lambda a: entropy(weights(shares, a, counts), counts) > target_entropy)  # falls as a rises
    if max_repeat is not None:
        tests.append(lambda a: repetition(shares, a) > max_repeat)
    return max((_least(over) for over in tests), default=1.0)


def _least(over) -> float:
    low, high = 0.0, 1.0
    if not over(low):
        return low
    for _ in range(HALVINGS):
        mid = (low + high) / 2
        low, high = (mid, high) if over(mid) else (low, mid)
    return high


def block_of(key: Column, blocks: int = BLOCKS, seed: int = SEED) -> Column:
    return F.pmod(F.xxhash64(key.cast("string"), F.lit(seed)), F.lit(blocks)).cast("int")


def rank_of(block: Column, source: Column, taken: Column, blocks: int = BLOCKS, seed: int = SEED) -> Column:
    """The place of a block in the permutation of a source and pass: steps that are bijections on the numbers below blocks, a power of two."""
    bits = max(1, blocks.bit_length() - 1)
    drawn = lambda k: F.xxhash64(source.cast("string"), source.isNull(), taken.cast("long"), F.lit(seed), F.lit(k))
    out, mask = block.cast("long"), F.lit(blocks - 1)
    for k in range(3):
        times = drawn(2 * k).bitwiseAND(mask).bitwiseOR(F.lit(1))
        out = (out * times + drawn(2 * k + 1).bitwiseAND(mask)).bitwiseAND(mask)
        out = out.bitwiseXOR(F.shiftright(out, (bits + 1) // 2))
    return out.cast("int")


def plan(docs: DataFrame, key: str, text: str, source: str, max_repeat: float | None = MAX_REPEAT, target_entropy: float | None = None, evenness: float | None = None, budget: int | None = None, blocks: int = BLOCKS, seed: int = SEED) -> DataFrame:
    """A row a source: source, weight, target and total (tokens), passes (whole ones), and part: bits of the blocks that the part of a pass takes.

    evenness: instead of target_entropy, how far from the corpus's entropy (0) to that of equal weights (1) the target is.
    """
    if blocks & (blocks - 1):
        raise ValueError("blocks must be a power of two")
    sums = docs.select(F.col(source).alias("source"), block_of(F.col(key), blocks, seed).alias("block"), tokens(F.col(text)).alias("t")).groupBy("source", "block").agg(F.sum("t").alias("t"))
    sums = stored(sums, "sums")
    totals = sums.groupBy("source").agg(F.sum("t").alias("total"))
    step = F.round(F.log2("total") * STEPS)
    shares, counts = {}, {}
    for r in totals.filter("total > 0").groupBy(step.alias("step")).agg(F.avg("total").alias("mean"), F.count("*").alias("n")).collect():  # at most 64 x STEPS rows
        shares[r["step"]], counts[r["step"]] = r["mean"], r["n"]
    whole = sum(x * counts[s] for s, x in shares.items())
    shares = {s: x / whole for s, x in shares.items()}
    if evenness is not None and shares:
        own, even = entropy(shares, counts), math.log(sum(counts.values()))
        target_entropy = own + evenness * (even - own)
    exponent = solve(shares, max_repeat, target_entropy, counts)
    raised = F.when(F.col("total") > 0, F.pow(F.col("total") / F.lit(max(whole, 1.0)), F.lit(exponent))).otherwise(F.lit(0.0))
    norm = totals.agg(F.sum(raised)).first()[0] or 1.0
    weighed = totals.withColumn("weight", raised / F.lit(norm))
    if budget is None:
        budget = weighed.agg(F.max(F.when(F.col("weight") > 0, F.ceil(F.col("total") / F.col("weight"))))).first()[0] or 0
    weighed = weighed.withColumn("target", F.round(F.col("weight") * F.lit(int(budget))).cast("long"))
    weighed = weighed.withColumn("passes", F.when(F.col("total") > 0, F.expr("target div total")).otherwise(F.lit(1)).cast("long")).withColumn("rest", F.when(F.col("total") > 0, F.expr("target % total")).otherwise(F.lit(0)).cast("long"))
    of = weighed.withColumnRenamed("source", "of")
    ranked = sums.join(of.filter("rest > 0"), F.col("source").eqNullSafe(F.col("of"))).select("source", "block", "t", "rest", rank_of(F.col("block"), F.col("source"), F.col("passes"), blocks, seed).alias("rank"))

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        """The blocks of one source that its part takes; blocks rows at most."""
        rows = rows.sort_values("rank")
        left, part = int(rows["rest"].iloc[0]), [0] * -(-blocks // 64)
        for block, t in zip(rows["block"].tolist(), rows["t"].tolist(), strict=True):
            if t <= left:
                left -= t
                part[block >> 6] |= 1 << (block & 63)
        return pd.DataFrame({"source": [rows["source"].iloc[0]], "part": [[x - (1 << 64) if x >> 63 else x for x in part]]})

    kind = docs.schema[source].dataType.simpleString()
    parts = ranked.groupBy("source").applyInPandas(fill, f"source {kind}, part array<long>")
    return weighed.withColumnRenamed("source", "of").join(parts, F.col("of").eqNullSafe(F.col("source")), "left").select(F.col("of").alias("source"), "weight", "target", "total", "passes", "part")


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED, blocks: int = BLOCKS, **how) -> DataFrame:
    """docs with a row for each pass that takes it, and the columns pass (from 0), weight, block and place (sort by it for the mixture's order)."""
    chosen = stored(plan(docs, key, text, source, blocks=blocks, seed=seed, **how), "plan")
    taken, weight, block, place = fresh(docs, "pass", "weight", "block", "place")
    of, target, total, passes, part = fresh(docs.select("*", *(F.lit(0).alias(c) for c in (taken, weight, block, place))), "plan_source", "plan_target", "plan_total", "plan_passes", "plan_part")
    chosen = chosen.select(F.col("source").alias(of), F.col("weight").alias(weight), F.col("target").alias(target), F.col("total").alias(total), F.col("passes").alias(passes), F.col("part").alias(part))
    rows = docs.withColumn(block, block_of(F.col(key), blocks, seed)).join(chosen, F.col(source).eqNullSafe(F.col(of)))
    bit = F.getbit(F.get(part, F.shiftright(block, 6)), F.col(block).bitwiseAND(63))
    last = F.col(passes) + F.coalesce(bit.cast("int"), F.lit(0)) - 1
    rows = rows.filter(last >= 0).withColumn(taken, F.explode(F.sequence(F.lit(0).cast("long"), last)))
    within = F.pmod(F.xxhash64(F.col(key).cast("string"), F.col(taken), F.lit(seed)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    done = F.col(taken) + (rank_of(F.col(block), F.col(source), F.col(taken), blocks, seed) + within) / F.lit(float(blocks))
    rows = rows.withColumn(place, F.least(F.lit(1.0), done * F.greatest(F.col(total), F.lit(1)) / F.greatest(F.col(target), F.lit(1)))).withColumn(taken, F.col(taken).cast("int"))
    return rows.drop(of, target, total, passes, part).select(*docs.columns, taken, weight, block, place)


def op5_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs, evenness=EVENNESS).select("doc_id", "source", F.col("pass").alias("pass_no"), "block", tokens(F.col("text")).alias("n_tokens"), F.round("weight", 9).alias("weight"), "place")
