"""Stories: greedy clustering over a bounded head, semantic merges, claim folds, change ledgers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.functions.numeric import cosine
from tesserae.operators.graph import components


def same_story(shared_entities: int, shared_bigrams: int, sim: float) -> bool:
    return shared_entities >= 2 or sim >= 0.40 or (shared_bigrams >= 1 and sim >= 0.26) or (shared_entities >= 1 and shared_bigrams >= 1 and sim >= 0.18)


def greedy_stories(head: DataFrame, block: str, hours: int = 48) -> DataFrame:
    """Seeds absorb what is the same story as themselves, in order of time; not transitive, so no components.

    head: id, at, tokens, bigrams, entities, and a block that bounds each group (a day and topic, say). One group is one
    task; the caller's top-k or block bounds its size.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = list(pdf.sort_values(["at", "id"], ascending=[False, True]).itertuples())
        story: dict = {}
        for k, seed in enumerate(rows):
            if seed.id in story:
                continue
            story[seed.id] = seed.id
            st, sb, se = set(seed.tokens), set(seed.bigrams), set(seed.entities)
            for other in rows[k + 1 :]:
                if other.id in story or abs((seed.at - other.at).total_seconds()) > hours * 3600:
                    continue
                t = set(other.tokens)
                union = len(st | t)
                if same_story(len(se & set(other.entities)), len(sb & set(other.bigrams)), len(st & t) / union if union else 0.0):
                    story[other.id] = seed.id
        return pd.DataFrame(list(story.items()), columns=["id", "story"])

    kind = head.schema["id"].dataType.simpleString()
    return head.groupBy(block).applyInPandas(run, f"id {kind}, story {kind}")


def semantic_merge(clusters: DataFrame, cap: int = 80, sure: float = 0.85, close: float = 0.72) -> DataFrame:
    """Components over the cap best clusters: very similar, or similar with two shared entities. clusters: id, score, vector, entities."""
    top = clusters.orderBy(F.desc("score"), "id").limit(cap)  # bounds the join below
    a, b = top.select(*(F.col(c).alias(f"{c}_a") for c in ("id", "vector", "entities"))), top.select(*(F.col(c).alias(f"{c}_b") for c in ("id", "vector", "entities")))
    sim = cosine(F.col("vector_a"), F.col("vector_b"))
    pairs = a.join(F.broadcast(b), F.col("id_a") < F.col("id_b")).withColumn("sim", sim)
    linked = pairs.filter((F.col("sim") >= sure) | ((F.col("sim") >= close) & (F.size(F.array_intersect("entities_a", "entities_b")) >= 2)))
    return components(linked.select(F.col("id_a").alias("a"), F.col("id_b").alias("b")))


def finalize(articles: DataFrame, as_of: Column) -> DataFrame:
    """One row a story: lead, sources, times, breaking, one-sidedness. articles: story, id, source, side, lang, headline, summary, at."""
    lead = F.struct(F.when(F.col("lang") == "vi", 1).otherwise(0), F.when(F.col("headline"), 1).otherwise(0) + F.length("summary") / 1000, -F.col("id"))
    s = articles.groupBy("story").agg(F.max_by("id", lead).alias("lead"), F.count("*").alias("n"), F.countDistinct("source").alias("sources"), F.max("at").alias("latest"), F.bool_or("headline").alias("headline"), F.countDistinct("side").alias("sides"))
    age = (F.unix_timestamp(as_of) - F.unix_timestamp("latest")) / 3600
    return s.withColumns({"age_hours": age, "breaking": (age <= 4) & (F.col("headline") | (F.col("sources") > 1)), "blindspot": (F.col("sides") == 1) & (F.col("sources") >= 2)})


def claim_fold(evidence: DataFrame) -> DataFrame:
    """State after each piece of evidence of a claim, in order of evidence time.

    evidence: claim, at, seq, voter, pos, is_primary. change is new, corroborate, self_revise, dispute, confirm or stale (it came
    late: the claim had moved past its time by an earlier arrival). Windows over a claim; equal times go by seq.
    """
    w = Window.partitionBy("claim").orderBy("at", "seq")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    arrived = Window.partitionBy("claim").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("claim", "voter").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, -1)
    e = evidence.withColumns({
        "seen": F.collect_set("pos").over(before), "mine": F.last("pos").over(own), "newest": F.max("at").over(arrived), "n_before": F.count("*").over(before),
        "primary_pos": F.last(F.when(F.col("is_primary"), F.col("pos")), ignorenulls=True).over(before),
    })
    change = F.when(F.col("n_before") == 0, "new").when(F.col("newest") > F.col("at"), "stale").when(F.col("is_primary"), "confirm")
    change = change.when(F.col("mine").isNotNull() & (F.col("mine") != F.col("pos")), "self_revise").when(F.array_contains("seen", F.col("pos")), "corroborate").otherwise("dispute")
    return e.select("claim", "at", "seq", "voter", "pos", change.alias("change"))


def ledger(changes: DataFrame, priority: dict[str, int]) -> DataFrame:
    """At most one material version for each event and cycle, under its first reason; changes: event, cycle, reason."""
    rank = F.create_map(*(F.lit(x) for pair in priority.items() for x in pair))[F.col("reason")]
    return changes.withColumn("_p", F.coalesce(rank, F.lit(999))).groupBy("event", "cycle").agg(F.min_by("reason", F.struct("_p", "reason")).alias("reason"), F.count("*").alias("changes"))


def stale_events(events: DataFrame, as_of: Column, hours: int = 48) -> DataFrame:
    return events.filter((F.col("status") == "active") & (F.col("last_at") < as_of - F.expr(f"INTERVAL {hours} HOURS"))).withColumn("status", F.lit("resolved"))


def adjudicated(stored: DataFrame, computed: DataFrame) -> DataFrame:
    """New versions to append: recomputed states that differ from mutable stored ones."""
    j = computed.join(stored.select("claim", F.col("state").alias("old")), "claim")
    return j.filter(F.col("old").isin("reported", "supported", "disputed") & (F.col("state") != F.col("old")))


def instrument_plans(plans: DataFrame, known: DataFrame) -> DataFrame:
    """Each plan's outcome: applied only if none of its rows conflicts. plans: plan, key, figi, mic; known: key, figi, mic.

    A row conflicts if its key is known under another durable id, or its durable id under another key; a missing id asserts nothing.
    """
    by_key = known.select("key", F.col("figi").alias("known_figi"))
    by_figi = known.filter("figi is not null").select("figi", F.col("key").alias("known_key"))
    rows = plans.join(by_key, "key", "left").join(by_figi, "figi", "left")
    clash = F.when(F.col("known_figi").isNotNull() & (F.col("known_figi") != F.col("figi")), "durable_id").when(F.col("known_key") != F.col("key"), "key")
    return rows.groupBy("plan").agg(F.min(clash).alias("conflict"), F.count("*").alias("rows")).withColumn("applied", F.col("conflict").isNull())
