"""Votes, claim states, reliability, lineage roots, materiality and ranked feeds."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.functions.numeric import clamp, freshness, radar_score
from tesserae.operators.graph import roots
from tesserae.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# -- votes ------------------------------------------------------------------------------------------------------------


def positions(votes: DataFrame) -> DataFrame:
    """claim, pos, voters, last_at, is_primary, last_primary of the latest vote of each voter. votes: claim, voter, pos, at, version_no, is_primary."""
    last = votes.groupBy("claim", "voter").agg(F.max_by(F.struct("pos", "at", "is_primary"), F.struct("at", "version_no")).alias("v"))
    return last.groupBy("claim", F.col("v.pos").alias("pos")).agg(
        F.count("*").alias("voters"), F.max("v.at").alias("last_at"), F.bool_or("v.is_primary").alias("is_primary"), F.max(F.when(F.col("v.is_primary"), F.col("v.at"))).alias("last_primary"))


def states(pos: DataFrame) -> DataFrame:
    """claim, winner, voters, live, state: a primary vote wins (the latest), else most voters; ties to the smaller position."""
    top = F.min_by(F.struct("pos", "voters", "is_primary"), F.struct(F.when(F.col("is_primary"), 0).otherwise(1), -F.coalesce(F.unix_micros(F.col("last_primary").cast("timestamp")), F.lit(0)), F.when(F.col("is_primary"), 0).otherwise(-F.col("voters")), "pos"))
    s = pos.groupBy("claim").agg(top.alias("w"), F.count("*").alias("live"))
    state = F.when(F.col("w.is_primary"), "confirmed").when(F.col("live") > 1, "disputed").when(F.col("w.voters") >= 2, "supported").otherwise("reported")
    return s.select("claim", F.col("w.pos").alias("winner"), F.col("w.voters").alias("voters"), "live", state.alias("state"))


def _votes(spark: SparkSession, d: str) -> DataFrame:
    """A user is a claim, an event type a voter, a value's hundreds the position, a sign-up primary on odd users."""
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("claim"), F.col("event_type").alias("voter"), F.floor(F.col("value") / 100).alias("pos"), F.col("ts").alias("at"), F.col("event_id").alias("version_no"),
                    ((F.col("event_type") == "signup") & (F.col("user_id") % 3 == 0)).alias("is_primary"))


_VOTES = """l AS (SELECT user_id AS claim, event_type AS voter, arg_max(CAST(floor(value / 100) AS BIGINT), (ts, event_id)) AS pos, max(ts) AS t, event_type = 'signup' AND user_id % 3 = 0 AS is_primary FROM events GROUP BY 1, 2),
  p AS (SELECT claim, pos, count(*) AS voters, max(t) AS last_at, bool_or(is_primary) AS is_primary, max(t) FILTER (is_primary) AS last_primary FROM l GROUP BY 1, 2)"""


@query(f"WITH {_VOTES} SELECT claim, pos, voters, last_at, is_primary FROM p")
def vote_positions(spark: SparkSession, d: str) -> DataFrame:
    return positions(_votes(spark, d)).drop("last_primary")


@query(f"""WITH {_VOTES}, r AS (SELECT *, row_number() OVER (PARTITION BY claim ORDER BY is_primary DESC, last_primary DESC NULLS LAST, CASE WHEN is_primary THEN 0 ELSE -voters END, pos) AS rn, count(*) OVER (PARTITION BY claim) AS live FROM p)
  SELECT claim, pos AS winner, voters, live, CASE WHEN is_primary THEN 'confirmed' WHEN live > 1 THEN 'disputed' WHEN voters >= 2 THEN 'supported' ELSE 'reported' END AS state FROM r WHERE rn = 1""")
def claim_state(spark: SparkSession, d: str) -> DataFrame:
    return states(positions(_votes(spark, d)))


@query("""WITH s AS (SELECT source, count(*) AS docs, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic, count(*) FILTER (l.doc_id IS NULL) AS unknown FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1),
  r AS (SELECT source, docs, round(greatest(0, least(1, 0.5 * good / docs + 0.3 * (1 - toxic / docs) + 0.2 * (1 - unknown / docs) - 0.1 * unknown / docs)), 6) AS score FROM s)
  SELECT source, docs, score, CASE WHEN docs < 5 THEN 'insufficient' WHEN score >= 0.6 THEN 'strong' WHEN score >= 0.35 THEN 'moderate' ELSE 'weak' END AS grade FROM r""")
def source_reliability(spark: SparkSession, d: str) -> DataFrame:
    """Shares per source, combined: documents meet their labels once, then one aggregate."""
    j = table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").withColumn("known", F.lit(True)), "doc_id", "left")
    s = j.groupBy("source").agg(F.count("*").alias("docs"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.count_if(F.col("known").isNull()).alias("unknown"))
    n = F.col("docs")
    score = F.round(clamp(F.col("good") * 0.5 / n + (1 - F.col("toxic") / n) * 0.3 + (1 - F.col("unknown") / n) * 0.2 - F.col("unknown") * 0.1 / n), 6)
    r = s.select("source", "docs", score.alias("score"))
    return r.withColumn("grade", F.when(n < 5, "insufficient").when(F.col("score") >= 0.6, "strong").when(F.col("score") >= 0.35, "moderate").otherwise("weak"))


def confidence(direct: Column, origins: Column, claims: Column, contradictions: Column, unresolved: Column) -> Column:
    base = F.when((direct >= 1) & (origins >= 2), "strong").when((claims >= 2) | (origins >= 1), "moderate").otherwise("weak")
    return F.when((base == "strong") & ((contradictions > 0) | (unresolved > origins)), "moderate").otherwise(base)


@query("""WITH c AS (SELECT user_id, count(DISTINCT event_type) AS origins, count(*) FILTER (event_type = 'purchase') AS direct, count(DISTINCT CAST(floor(value / 100) AS BIGINT)) AS claims, count(*) FILTER (event_type = 'error' AND value > 350) AS bad, count(*) FILTER (value < 1) AS unresolved FROM events GROUP BY 1),
  b AS (SELECT *, CASE WHEN direct >= 1 AND origins >= 2 THEN 'strong' WHEN claims >= 2 OR origins >= 1 THEN 'moderate' ELSE 'weak' END AS base FROM c) SELECT user_id, CASE WHEN base = 'strong' AND (bad > 0 OR unresolved > origins) THEN 'moderate' ELSE base END AS confidence FROM b""")
def confidence_state(spark: SparkSession, d: str) -> DataFrame:
    t, v = F.col("event_type"), F.col("value")
    c = table(spark, d, "events").groupBy("user_id").agg(F.countDistinct("event_type").alias("o"), F.count_if(t == "purchase").alias("d"), F.countDistinct(F.floor(v / 100)).alias("c"), F.count_if((t == "error") & (v > 350)).alias("x"), F.count_if(v < 1).alias("u"))
    return c.select("user_id", confidence(F.col("d"), F.col("o"), F.col("c"), F.col("x"), F.col("u")).alias("confidence"))


# -- lineage ----------------------------------------------------------------------------------------------------------


@query("""WITH d AS (SELECT doc_id, source, regexp_extract(text, '^[^\\n]*', 0) AS title FROM documents), c AS (SELECT c.doc_id AS child, p.doc_id AS parent, row_number() OVER (PARTITION BY c.doc_id ORDER BY p.doc_id) AS rn FROM d c JOIN d p ON c.title = p.title AND p.doc_id < c.doc_id WHERE length(c.title) >= 20)
  SELECT doc_id AS child, parent, CASE WHEN parent IS NULL THEN 'original' WHEN d.source <> p.source THEN 'syndicated' ELSE 'rewritten' END AS relation FROM d LEFT JOIN c ON c.child = d.doc_id AND rn = 1 LEFT JOIN (SELECT doc_id AS pid, source FROM d) p ON p.pid = parent""")
def lineage_best_parent(spark: SparkSession, d: str) -> DataFrame:
    """Each document's most senior one with the same title: a minimum per title, no pairs."""
    title = F.regexp_extract("text", r"^[^\n]*", 0)
    docs = table(spark, d, "documents").select("doc_id", "source", title.alias("title"))
    lead = docs.filter(F.length("title") >= 20).groupBy("title").agg(F.min(F.struct("doc_id", "source")).alias("p"))
    j = docs.join(lead, "title", "left").withColumn("parent", F.when(F.col("p.doc_id") < F.col("doc_id"), F.col("p.doc_id")))
    relation = F.when(F.col("parent").isNull(), "original").when(F.col("source") != F.col("p.source"), "syndicated").otherwise("rewritten")
    return j.select(F.col("doc_id").alias("child"), "parent", relation.alias("relation"))


_EDGES = "e AS (SELECT event_id AS child, CASE WHEN event_id % 5 <> 0 THEN event_id - 1 - (event_id % 3) END AS parent FROM events)"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    return table(spark, d, "events").select(i.alias("child"), F.when(i % 5 != 0, i - 1 - i % 3).alias("parent"))


@query(f"""WITH RECURSIVE {_EDGES}, w(child, node, hops) AS (SELECT child, child, 0 FROM e UNION ALL SELECT w.child, e.parent, w.hops + 1 FROM w JOIN e ON e.child = w.node WHERE e.parent IS NOT NULL AND w.hops < 8 AND e.parent >= 0),
  r AS (SELECT child, arg_max(node, hops) AS root, max(hops) AS hops FROM w GROUP BY 1) SELECT child, root, hops FROM r""")
def root_walk(spark: SparkSession, d: str) -> DataFrame:
    """Up to 8 hops to the origin; a parent that is unknown here is as far as it goes."""
    e = _edges(spark, d).withColumn("parent", F.when(F.col("parent") >= 0, F.col("parent")))
    return roots(e, max_hops=8)


@query(f"""WITH RECURSIVE {_EDGES}, w(child, node, hops) AS (SELECT child, child, 0 FROM e UNION ALL SELECT w.child, e.parent, w.hops + 1 FROM w JOIN e ON e.child = w.node WHERE e.parent IS NOT NULL AND w.hops < 8 AND e.parent >= 0),
  r AS (SELECT child, arg_max(node, hops) AS root FROM w GROUP BY 1) SELECT user_id, count(*) AS raw, count(DISTINCT root) AS origins, count(DISTINCT root) FILTER (event_type = 'purchase') AS primary_origins, count(*) FILTER (root <> child) AS derived FROM events JOIN r ON child = event_id GROUP BY 1""")
def evidence_stats(spark: SparkSession, d: str) -> DataFrame:
    """Raw, independent, primary and derived evidence of each event."""
    e = _edges(spark, d).withColumn("parent", F.when(F.col("parent") >= 0, F.col("parent")))
    j = table(spark, d, "events").select(F.col("event_id").alias("child"), "user_id", "event_type").join(roots(e, 8), "child")
    return j.groupBy("user_id").agg(F.count("*").alias("raw"), F.countDistinct("root").alias("origins"), F.countDistinct(F.when(F.col("event_type") == "purchase", F.col("root"))).alias("primary_origins"), F.count_if(F.col("root") != F.col("child")).alias("derived"))


# -- quality measures --------------------------------------------------------------------------------------------------


_PRED = "SELECT quality AS truth, CASE WHEN length(text) > 400 AND NOT regexp_matches(text, '!!|%%%|[|]') THEN 1 ELSE 0 END AS guess FROM labels JOIN documents USING (doc_id)"


def _guess(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    docs = table(spark, d, "documents").select("doc_id", F.when((F.length(t) > 400) & ~t.rlike("!!|%%%|[|]"), 1).otherwise(0).alias("guess"))
    return table(spark, d, "labels").select("doc_id", F.col("quality").alias("truth")).join(docs, "doc_id")


@query(f"SELECT truth, guess, count(*) AS n FROM ({_PRED}) GROUP BY 1, 2")
def confusion_matrix(spark: SparkSession, d: str) -> DataFrame:
    return _guess(spark, d).groupBy("truth", "guess").agg(F.count("*").alias("n"))


@query(f"""WITH c AS (SELECT count(*) FILTER (truth = 1 AND guess = 1) AS tp, count(*) FILTER (truth = 0 AND guess = 1) AS fp, count(*) FILTER (truth = 1 AND guess = 0) AS fn FROM ({_PRED}))
  SELECT round(tp / (tp + fp), 6) AS p, round(tp / (tp + fn), 6) AS r, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(tp / (tp + fp + fn), 6) AS iou FROM c""")
def prf1(spark: SparkSession, d: str) -> DataFrame:
    t, g = F.col("truth") == 1, F.col("guess") == 1
    c = _guess(spark, d).agg(F.count_if(t & g).alias("tp"), F.count_if(~t & g).alias("fp"), F.count_if(t & ~g).alias("fn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return c.select(F.round(tp / (tp + fp), 6).alias("p"), F.round(tp / (tp + fn), 6).alias("r"), F.round(tp * 2 / (tp * 2 + fp + fn), 6).alias("f1"), F.round(tp / (tp + fp + fn), 6).alias("iou"))


# -- materiality and ranking -------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 'none' WHEN o_orderstatus = 'P' THEN 'limited' WHEN o_totalprice >= 300000 AND o_orderpriority = '1-URGENT' THEN 'major' WHEN o_totalprice >= 200000 THEN 'meaningful' ELSE 'limited' END AS level,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'excluded' WHEN o_orderstatus = 'P' THEN 'revision' WHEN o_totalprice >= 300000 AND o_orderpriority = '1-URGENT' THEN 'core' WHEN o_totalprice >= 200000 THEN 'large' ELSE 'rest' END AS reason FROM orders""")
def materiality_ladder(spark: SparkSession, d: str) -> DataFrame:
    """An ordered ladder that gives a level and why."""
    p, s, x = F.col("o_orderpriority"), F.col("o_orderstatus"), F.col("o_totalprice")
    rungs = [(p == "5-LOW", "none", "excluded"), (s == "P", "limited", "revision"), ((x >= 300000) & (p == "1-URGENT"), "major", "core"), (x >= 200000, "meaningful", "large"), (F.lit(True), "limited", "rest")]
    pick = None
    for when, level, why in rungs:
        v = F.struct(F.lit(level).alias("level"), F.lit(why).alias("reason"))
        pick = F.when(when, v) if pick is None else pick.when(when, v)
    return table(spark, d, "orders").select("o_orderkey", pick.alias("m")).select("o_orderkey", "m.level", "m.reason")


def radar_items(events: DataFrame, now: Column) -> DataFrame:
    """Scored feed items of a table of deltas: event_id, event_type, user_id, ts, value."""
    t, v = F.col("event_type"), F.col("value")
    magnitude = F.when(v >= 150, 0.9).when(v >= 60, 0.65).otherwise(0.3)
    odd = F.when(t == "error", 1.0).when(t == "purchase", 0.6).otherwise(0.3)
    evidence = clamp(F.lit(0.5) + F.least(F.col("user_id") % 5, F.lit(2)) * 0.25)
    age = (F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col("ts").cast("timestamp"))) / 3600
    relevance = F.when(F.col("user_id") % 10 == 0, 1.0).otherwise(0.5)
    return events.withColumn("score", radar_score(magnitude, odd, evidence, freshness(age), relevance))


@query("""WITH s AS (SELECT event_id, event_type, user_id, round(1000 * (CASE WHEN value >= 150 THEN 0.9 WHEN value >= 60 THEN 0.65 ELSE 0.3 END * 0.28 + CASE event_type WHEN 'error' THEN 1.0 WHEN 'purchase' THEN 0.6 ELSE 0.3 END * 0.2 + least(1, 0.5 + least(user_id % 5, 2) * 0.25) * 0.18
  + pow(0.5, greatest((epoch(TIMESTAMP '2024-01-31') - floor(epoch(ts))) / 3600, 0) / 36) * 0.14 + CASE WHEN user_id % 10 = 0 THEN 1.0 ELSE 0.5 END * 0.2)) / 10 AS score FROM events) SELECT event_id, score FROM s WHERE score >= 8 ORDER BY score DESC, event_id LIMIT 50""")
def rank_score(spark: SparkSession, d: str) -> DataFrame:
    """The 50 best items of score 8 or more."""
    items = radar_items(table(spark, d, "events"), F.lit("2024-01-31").cast("timestamp_ntz"))
    return items.filter("score >= 8").select("event_id", "score").orderBy(F.desc("score"), "event_id").limit(50)


def diverse(top: DataFrame, cap: int) -> DataFrame:
    """A sequential greedy pass over a bounded head: an item goes if it shares its user and type, or its user and hour, with a kept one.

    Not relational: each choice depends on the ones before. The head is cut by a top-k first, so the single task is
    bounded by that k.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kept, seen_type, seen_hour = [], set(), set()
        for r in pdf.sort_values(["score", "event_id"], ascending=[False, True]).itertuples():
            a, b = (r.user_id, r.event_type), (r.user_id, r.ts.floor("h"))
            if a in seen_type or b in seen_hour:
                continue
            seen_type.add(a)
            seen_hour.add(b)
            kept.append((r.event_id, r.score, len(kept) + 1))
            if len(kept) == cap:
                break
        return pd.DataFrame(kept, columns=["event_id", "score", "place"])

    return top.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(run, "event_id long, score double, place int")


@query(None)
def greedy_diverse_feed(spark: SparkSession, d: str) -> DataFrame:
    items = radar_items(table(spark, d, "events"), F.lit("2024-01-31").cast("timestamp_ntz"))
    top = items.filter("score >= 8").orderBy(F.desc("score"), "event_id").limit(500).select("event_id", "event_type", "user_id", "ts", "score")
    return diverse(top, 40)


@query("""WITH s AS (SELECT p_partkey, p_brand, p_retailprice, p_size, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS overall FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn FROM s WHERE overall > 1)
  SELECT p_partkey, CASE WHEN overall = 1 THEN 'hero' ELSE p_brand END AS slot, 1 AS place FROM s WHERE overall = 1 UNION ALL SELECT p_partkey, p_brand, rn FROM r WHERE rn <= 5""")
def edition_slots(spark: SparkSession, d: str) -> DataFrame:
    """One hero, then five for each pillar without it; the hero is among the pillars' own first six, so no global sort runs."""
    w = Window.partitionBy("p_brand").orderBy(F.desc("p_retailprice"), "p_partkey")
    six = table(spark, d, "part").select("p_partkey", "p_brand", "p_retailprice").withColumn("rn", F.row_number().over(w)).filter("rn <= 6")
    hero = six.orderBy(F.desc("p_retailprice"), "p_partkey").limit(1).select(F.col("p_partkey").alias("hero"), F.col("p_brand").alias("hero_brand"))
    j = six.join(F.broadcast(hero), F.col("p_brand") == F.col("hero_brand"), "left")
    is_hero = F.col("p_partkey") == F.col("hero")
    place = F.when(F.col("hero").isNotNull(), F.col("rn") - 1).otherwise(F.col("rn"))
    out = j.withColumn("slot", F.when(is_hero, "hero").otherwise(F.col("p_brand"))).withColumn("place", F.when(is_hero, 1).otherwise(place))
    return out.filter("place <= 5").select("p_partkey", "slot", "place")


@query("""WITH g AS (SELECT user_id, CAST(min(CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 9 END) AS INT) AS rank, max(ts) AS latest, count(*) AS n, list_sort(list(DISTINCT event_type)) AS kinds FROM events GROUP BY 1) SELECT * FROM g ORDER BY rank, latest DESC, user_id LIMIT 30""")
def group_changes(spark: SparkSession, d: str) -> DataFrame:
    rank = F.when(F.col("event_type") == "error", 1).when(F.col("event_type") == "purchase", 2).when(F.col("event_type") == "signup", 3).otherwise(9)
    g = table(spark, d, "events").groupBy("user_id").agg(F.min(rank).alias("rank"), F.max("ts").alias("latest"), F.count("*").alias("n"), F.sort_array(F.collect_set("event_type")).alias("kinds"))
    return g.orderBy("rank", F.desc("latest"), "user_id").limit(30)


@query("""WITH a AS (SELECT lower(split_part(p_name, ' ', 1)) AS alias, p_brand AS entity FROM part), u AS (SELECT alias, min(entity) AS entity, count(DISTINCT entity) AS n FROM a GROUP BY 1) SELECT alias, CASE WHEN n = 1 THEN entity END AS entity, n FROM u""")
def alias_resolution(spark: SparkSession, d: str) -> DataFrame:
    """An alias of several entities is ambiguous and resolves to null."""
    a = table(spark, d, "part").select(F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("alias"), F.col("p_brand").alias("entity"))
    u = a.groupBy("alias").agg(F.min("entity").alias("one"), F.countDistinct("entity").alias("n"))
    return u.select("alias", F.when(F.col("n") == 1, F.col("one")).alias("entity"), "n")


@query("""WITH f AS (SELECT source, min(doc_id) AS first FROM documents GROUP BY 1), m AS (SELECT min(first) AS zero FROM f) SELECT source, first, first - zero AS lag FROM f, m""")
def source_timeline(spark: SparkSession, d: str) -> DataFrame:
    """Each source's first appearance and its lag behind the very first."""
    f = table(spark, d, "documents").groupBy("source").agg(F.min("doc_id").alias("first"))
    return f.crossJoin(F.broadcast(f.agg(F.min("first").alias("zero")))).select("source", "first", (F.col("first") - F.col("zero")).alias("lag"))


@query("""SELECT lang, count(*) AS n, count(DISTINCT source) AS sources, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM documents GROUP BY 1""")
def media_spectrum(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.countDistinct("source").alias("sources"))
    return g.crossJoin(F.broadcast(g.agg(F.sum("n").alias("all")))).select("lang", "n", "sources", F.round(F.col("n") * 100.0 / F.col("all"), 2).alias("pct"))
