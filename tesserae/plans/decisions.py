"""Decision cascades over analogue features, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.operators import decide, stories
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


def _features(spark: SparkSession, d: str) -> tuple[DataFrame, dict]:
    """Features of a pair from an event's numbers; eighths and quarters, so that thresholds are met exactly alike."""
    e = table(spark, d, "events")
    i, u = F.col("event_id"), F.col("user_id")
    f = {
        "in_window": i % 17 != 0, "s": (i % 16) / 16, "rare": i % 7 == 0, "person": i % 11 == 0, "bigram": i % 3 == 0, "other_language": u % 4 == 0, "shared": u % 4, "core_shared": u % 3, "hub_free_core": i % 2,
        "core_sim": (u % 8) / 8, "claim_overlap": (i % 32) / 64, "generic_overlap": (u % 16) / 16, "cos": F.when(i % 13 != 0, (i % 64) / 64), "number_conflict": i % 5 == 0, "number_agreement": i % 23 == 0, "anchor": u % 5 == 0, "entity_blocked": u % 6 == 0,
    }
    return e, f


_F = """f AS (SELECT event_id, event_id % 17 <> 0 AS in_window, (event_id % 16) / 16 AS s, event_id % 7 = 0 AS rare, event_id % 11 = 0 AS person, event_id % 3 = 0 AS bigram, user_id % 4 = 0 AS other_language, user_id % 4 AS shared, user_id % 3 AS core_shared, event_id % 2 AS hub,
  (user_id % 8) / 8 AS core_sim, (event_id % 32) / 64 AS claim_overlap, (user_id % 16) / 16 AS generic_overlap, CASE WHEN event_id % 13 <> 0 THEN (event_id % 64) / 64 ELSE 0 END AS cos, event_id % 5 = 0 AS clash, event_id % 23 = 0 AS agree, user_id % 5 = 0 AS anchor, user_id % 6 = 0 AS blocked FROM events)"""
_PATH = """CASE WHEN NOT in_window THEN 'time_window' WHEN s >= 0.55 THEN 'headline' WHEN rare AND s >= 0.2 THEN 'rare_token' WHEN person AND s >= 0.2 THEN 'person' WHEN s >= 0.1 AND bigram AND hub > 0 THEN 'bigram_entity' WHEN agree AND core_shared >= 2 THEN 'num_entity'
  WHEN s < 0.1 AND NOT clash AND hub > 0 AND shared >= 2 AND core_sim >= 0.4 THEN 'cross_lingual' WHEN claim_overlap >= 0.5 THEN 'distinctive_claim' WHEN NOT blocked AND NOT clash AND cos >= 0.87 THEN 'semantic_strong' WHEN NOT blocked AND NOT clash AND other_language AND cos >= 0.78 AND shared >= 1 THEN 'semantic_xlang'
  WHEN NOT blocked AND NOT clash AND cos >= 0.72 AND anchor THEN 'semantic_anchored' WHEN NOT blocked AND NOT clash AND cos >= 0.77 AND bigram AND core_shared >= 1 THEN 'semantic_facet' WHEN NOT blocked AND core_sim >= 0.5 AND shared >= 2 AND NOT (clash AND (s < 0.2 OR NOT hub > 0)) THEN 'entity'
  WHEN NOT blocked AND generic_overlap >= 0.5 AND (shared >= 1 OR s >= 0.1) THEN 'generic_claim' WHEN cos >= 0.72 THEN 'semantic_ambiguous' WHEN blocked THEN 'entity_blocked' ELSE 'no_path' END"""


@query(f"WITH {_F} SELECT event_id, {_PATH} AS path, CASE WHEN {_PATH} IN ('time_window', 'entity_blocked', 'no_path') THEN 'split' WHEN {_PATH} = 'semantic_ambiguous' THEN 'ambiguous' ELSE 'merge' END AS action FROM f")
def resolver_decision(spark: SparkSession, d: str) -> DataFrame:
    e, f = _features(spark, d)
    return e.select("event_id", decide.resolve(f).alias("v")).select("event_id", "v.path", "v.action")


@query(f"""WITH {_F}, a AS (SELECT event_id, {_PATH} AS p FROM f), b AS (SELECT event_id, {_PATH.replace('blocked THEN', 'FALSE THEN').replace('NOT blocked', 'TRUE')} AS q FROM f), j AS (SELECT event_id, CASE WHEN p IN ('time_window', 'entity_blocked', 'no_path') THEN 'split' WHEN p = 'semantic_ambiguous' THEN 'ambiguous' ELSE 'merge' END AS x,
  CASE WHEN q IN ('time_window', 'entity_blocked', 'no_path') THEN 'split' WHEN q = 'semantic_ambiguous' THEN 'ambiguous' ELSE 'merge' END AS y FROM a JOIN b USING (event_id)) SELECT event_id, CASE WHEN x = 'ambiguous' OR y = 'ambiguous' THEN 'indeterminate' WHEN x = y THEN 'same' WHEN y = 'split' THEN 'blocked' ELSE 'enabled' END AS replay FROM j""")
def counterfactual_replay(spark: SparkSession, d: str) -> DataFrame:
    """What the decisions would be without entity blocks."""
    e, f = _features(spark, d)
    return e.select("event_id", decide.replay(f, {"entity_blocked": F.lit(False)}).alias("replay"))


@query("""WITH c AS (SELECT event_id, event_id % 19 = 0 AS prim, event_id % 8 <> 0 AS has, CASE WHEN event_id % 8 <> 0 THEN (event_id % 32) / 32 END AS t, CASE WHEN event_id % 8 <> 0 THEN (user_id % 16) / 16 END AS m, user_id % 2 = 0 AS other, event_id % 9 = 0 AS clash, event_id % 3 AS nums, event_id % 29 = 0 AS quotes, event_id % 31 = 0 AS named, event_id % 12 = 1 AS dangling, event_id % 12 = 2 AS foreign_n, event_id % 12 = 3 AS disjoint, (user_id % 8) / 8 AS senior FROM events),
  r AS (SELECT event_id, t, CASE WHEN prim THEN 'primary_source' WHEN coalesce(t, 0) >= 0.8 AND NOT clash AND other AND (nums >= 1 OR m >= 0.3 OR t >= 0.9) THEN 'wire_copy' WHEN quotes THEN 'primary_phrase' WHEN named THEN 'named_outlet' WHEN coalesce(t, 0) >= 0.55 AND NOT clash AND (coalesce(m, 0) >= 0.35 OR (t >= 0.65 AND nums >= 1) OR t >= 0.7) THEN 'close_text'
  WHEN NOT has THEN 'no_evidence' WHEN dangling THEN 'dangling_attribution' WHEN foreign_n THEN 'possible_translation' WHEN disjoint THEN 'conflicting_figures' WHEN senior >= 0.35 THEN 'conflicting_similarity' ELSE 'nothing_close' END AS rule FROM c)
  SELECT event_id, rule, CASE rule WHEN 'primary_source' THEN 'original' WHEN 'nothing_close' THEN 'original' WHEN 'wire_copy' THEN 'syndicated' WHEN 'primary_phrase' THEN 'press_release_based' WHEN 'named_outlet' THEN 'quoted' WHEN 'close_text' THEN 'rewritten' ELSE 'unknown' END AS relation,
  round(CAST(CASE rule WHEN 'primary_source' THEN 0.9 WHEN 'wire_copy' THEN least(0.95, t + 0.05) WHEN 'primary_phrase' THEN 0.85 WHEN 'named_outlet' THEN 0.9 WHEN 'close_text' THEN 0.65 WHEN 'no_evidence' THEN 0.3 WHEN 'dangling_attribution' THEN 0.35 WHEN 'nothing_close' THEN 0.6 ELSE 0.4 END AS DOUBLE), 6) AS confidence FROM r""")
def lineage_cascade(spark: SparkSession, d: str) -> DataFrame:
    i, u = F.col("event_id"), F.col("user_id")
    c = {
        "primary": i % 19 == 0, "has_candidates": i % 8 != 0, "title": F.when(i % 8 != 0, (i % 32) / 32), "summary": F.when(i % 8 != 0, (u % 16) / 16), "other_source": u % 2 == 0, "number_conflict": i % 9 == 0, "shared_numbers": i % 3, "quotes_primary": i % 29 == 0, "named_outlet": i % 31 == 0,
        "dangling": i % 12 == 1, "foreign_numbers": i % 12 == 2, "disjoint_numbers": i % 12 == 3, "best_senior": (u % 8) / 8,
    }
    v = table(spark, d, "events").select("event_id", decide.lineage(c).alias("v"))
    return v.select("event_id", "v.rule", "v.relation", F.round("v.confidence", 6).alias("confidence"))


@query("""SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'limited' WHEN event_id % 4 <> 0 AND (event_id % 7) / 32 >= 0.1 THEN 'major' WHEN event_id % 3 = 0 AND user_id % 2 = 0 AND z >= 2 THEN 'meaningful' WHEN event_id % 3 = 0 THEN 'limited' WHEN z >= 2.5 AND user_id % 2 = 0 THEN 'major' WHEN z >= 2.5 THEN 'meaningful' WHEN z >= 1.5 AND user_id % 2 = 0 THEN 'meaningful' ELSE 'limited' END AS level
  FROM (SELECT *, CASE WHEN user_id % 12 >= 8 THEN (event_id % 16) / 4 ELSE 0 END AS z FROM events)""")
def macro_materiality(spark: SparkSession, d: str) -> DataFrame:
    i, u = F.col("event_id"), F.col("user_id")
    m = decide.macro(i % 10 == 0, F.lit(False), (i % 7) / 32, i % 4 == 0, i % 3 == 0, u % 2 == 0, (i % 16) / 4, u % 12)
    return table(spark, d, "events").select("event_id", m["level"].alias("level"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'A' THEN CASE WHEN l_quantity >= 45 OR l_quantity <= 2 THEN 'meaningful' ELSE 'limited' END WHEN l_linestatus = 'O' AND l_extendedprice > 0 AND l_quantity * 50 / l_extendedprice >= 0.02 THEN 'meaningful' ELSE 'limited' END AS level FROM lineitem""")
def action_materiality(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("l_returnflag") == "A", "stock_split").otherwise("cash_dividend")
    factor = F.when(F.col("l_quantity") >= 45, 5.0).when(F.col("l_quantity") <= 2, 0.2).otherwise(2.0)
    m = decide.corporate_action(kind, factor, F.col("l_quantity") * 50, F.col("l_extendedprice"), F.col("l_linestatus") == "O")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", m["level"].alias("level"))


@query("""WITH c AS (SELECT user_id, count(DISTINCT event_type) AS ind, count(*) AS claims, count(*) FILTER (event_type = 'purchase') AS prim, count(*) FILTER (value > 100) AS sup, count(*) FILTER (event_type = 'error') AS dis, count(*) FILTER (value < 2) AS unres FROM events GROUP BY 1),
  s AS (SELECT *, greatest(0, least(1, 0.3 + 0.35 * least(1, ind / 5) + 0.15 * least(1, claims / 30) + 0.1 * least(1, prim) + 0.15 * least(1, sup / 5) - 0.4 * dis / claims)) AS x FROM c) SELECT user_id, round(CAST(CASE WHEN unres > ind THEN least(x, 0.5) ELSE x END AS DOUBLE), 6) AS strength FROM s""")
def evidence_strength(spark: SparkSession, d: str) -> DataFrame:
    t, v = F.col("event_type"), F.col("value")
    c = table(spark, d, "events").groupBy("user_id").agg(F.countDistinct("event_type").alias("i"), F.count("*").alias("c"), F.count_if(t == "purchase").alias("p"), F.count_if(v > 100).alias("s"), F.count_if(t == "error").alias("x"), F.count_if(v < 2).alias("u"))
    return c.select("user_id", F.round(decide.evidence_strength(*(F.col(k) for k in "icpsxu")), 6).alias("strength"))


@query("""WITH e AS (SELECT user_id AS event, CAST(ts AS DATE) AS cycle, event_type AS reason, CASE event_type WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 999 END AS p FROM events) SELECT event, cycle, arg_min(reason, (p, reason)) AS reason, count(*) AS changes FROM e GROUP BY 1, 2""")
def change_ledger(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("event"), F.to_date("ts").alias("cycle"), F.col("event_type").alias("reason"))
    return stories.ledger(e, {"error": 1, "purchase": 2, "signup": 3})


@query("""WITH n AS (SELECT source, count(*) FILTER (length(text) > 1500) AS long, count(*) AS n FROM documents GROUP BY 1), p AS (SELECT source, long / n AS share, long, source IN ('src0', 'src1') AS subject FROM n)
  SELECT source, CASE WHEN source = 'src7' THEN 'subject' WHEN share >= 0.4 THEN 'actor' WHEN long > 0 THEN 'mention' ELSE 'none' END AS role, round(CAST(CASE WHEN source = 'src7' THEN least(1, 0.9 + CASE WHEN subject THEN 0.15 ELSE 0 END) WHEN share >= 0.4 THEN 0.7 + CASE WHEN subject THEN 0.15 ELSE 0 END
  WHEN long > 0 THEN least(0.35, least(0.35, 0.15 + share) + CASE WHEN subject THEN 0.15 ELSE 0 END) ELSE least(0.3, 0.15 + CASE WHEN subject THEN 0.15 ELSE 0 END) END AS DOUBLE), 6) AS p FROM p""")
def entity_prominence(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "documents").groupBy("source").agg(F.count_if(F.length("text") > 1500).alias("long"), F.count("*").alias("n"))
    v = decide.prominence(F.col("source") == "src7", F.col("long") / F.col("n"), F.col("long"), F.col("source").isin("src0", "src1"))
    return n.select("source", v.alias("v")).select("source", "v.role", "v.p")


@query(None)
def story_greedy(spark: SparkSession, d: str) -> DataFrame:
    """Seed order within a day of each user's bucket; blocks bound the groups."""
    e = table(spark, d, "events").filter("event_type = 'purchase'")
    k = F.col("event_id")
    head = e.select(k.alias("id"), F.col("ts").alias("at"), F.array(*(((k + j) % 40).cast("string") for j in range(6))).alias("tokens"), F.array((k % 9).cast("string")).alias("bigrams"), F.array((k % 5).cast("string"), (k % 7 + 10).cast("string")).alias("entities"), F.concat_ws("/", F.to_date("ts").cast("string"), (F.col("user_id") % 4).cast("string")).alias("block"))
    return stories.greedy_stories(head, "block")


@query("""WITH e AS (SELECT user_id AS claim, ts AS t, event_id AS seq, event_type AS voter, CAST(floor(value / 50) AS BIGINT) AS pos, event_type = 'signup' AS prim FROM events),
  w AS (SELECT *, count(*) OVER b AS n, max(t) OVER (PARTITION BY claim ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS newest, last_value(pos) OVER (PARTITION BY claim, voter ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mine, coalesce(list_contains(list(pos) OVER b, pos), FALSE) AS seen
    FROM e WINDOW b AS (PARTITION BY claim ORDER BY t, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT claim, t AS "at", seq, voter, pos, CASE WHEN n = 0 THEN 'new' WHEN newest > t THEN 'stale' WHEN prim THEN 'confirm' WHEN mine <> pos THEN 'self_revise' WHEN seen THEN 'corroborate' ELSE 'dispute' END AS change FROM w""")
def claim_changes(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("claim"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.col("event_type").alias("voter"), F.floor(F.col("value") / 50).alias("pos"), (F.col("event_type") == "signup").alias("is_primary"))
    return stories.claim_fold(e)
