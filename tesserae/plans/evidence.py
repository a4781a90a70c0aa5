"""Stories, evidence and claims over whole tables: noise, money, signatures, resolution, telemetry, closures, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.functions import story, text
from tesserae.operators import decide, stories
from tesserae.operators.graph import ancestors
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


@query("""WITH t AS (SELECT p_partkey, p_name || CASE p_partkey % 6 WHEN 0 THEN ' sao showbiz lo clip' WHEN 1 THEN ' giam gia, gia dien' WHEN 2 THEN ' gia xang hom nay' WHEN 3 THEN ' thuc pham ban' WHEN 4 THEN ' trong 30 giay' ELSE '' END AS s FROM part)
  SELECT p_partkey, p_partkey % 6 IN (0, 3, 4) AS noise FROM t""")
def noise_filter(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 6
    tail = F.when(k == 0, " sao showbiz lộ clip").when(k == 1, " giảm giá, giá điện").when(k == 2, " giá xăng hôm nay").when(k == 3, " thực phẩm bẩn").when(k == 4, " trong 30 giây").otherwise("")
    return table(spark, d, "part").select("p_partkey", story.is_noise(text.normalize_text(F.concat("p_name", tail))).alias("noise"))


@query("""SELECT l_orderkey, l_linenumber, l_quantity * CASE l_orderkey % 5 WHEN 0 THEN 1e9 WHEN 1 THEN 1e6 WHEN 2 THEN 1e3 ELSE 1 END * CASE l_linenumber % 6 WHEN 0 THEN 0.00004 WHEN 1 THEN 1.08 WHEN 2 THEN 0.14 WHEN 3 THEN 1.27 WHEN 4 THEN 1 END AS usd FROM lineitem""")
def approximate_usd(spark: SparkSession, d: str) -> DataFrame:
    o, n = F.col("l_orderkey") % 5, F.col("l_linenumber") % 6
    said = F.concat(F.col("l_quantity").cast("string"), F.when(o == 0, " tỷ").when(o == 1, " triệu").when(o == 2, " thousand").otherwise(" tỉnh"))
    unit = F.when(n == 0, "vnd").when(n == 1, "euro").when(n == 2, "CNY").when(n == 3, "£").when(n == 4, "US$")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", story.approximate_usd(F.col("l_quantity"), said, unit).alias("usd"))


@query(r"""WITH w AS (SELECT p_partkey, p_brand, string_split(regexp_replace(lower(p_name || ' ' || p_type || ' ' || (p_size * 7)), '[^a-z0-9]+', ' ', 'g'), ' ') AS r FROM part),
  s AS (SELECT *, list_filter([CASE WHEN i < len(r) THEN r[i] || '_' || r[i + 1] ELSE '' END FOR i IN range(1, len(r) + 1)], lambda x: length(x) >= 7 AND NOT regexp_matches(x, '(^[0-9]+_)|(_[0-9]+$)')) AS b FROM w)
  SELECT p_partkey, p_brand || '|' || coalesce(array_to_string(list_sort(list_filter(r, lambda x: length(x) >= 3 AND NOT regexp_matches(x, '^[0-9]+$'))), ' '), '') || '|' || coalesce(array_to_string(list_sort(list_filter(r, lambda x: regexp_matches(x, '^[0-9]{2,3}$'))), ' '), '') || '|' || coalesce(array_to_string(list_sort(b), ' '), '') AS signature FROM s""")
def event_signature(spark: SparkSession, d: str) -> DataFrame:
    title = F.concat_ws(" ", "p_name", "p_type", (F.col("p_size") * 7).cast("string"))
    return table(spark, d, "part").select("p_partkey", story.event_signature(F.col("p_brand"), text.normalize_text(title)).alias("signature"))


@query("""WITH o AS (SELECT o_custkey, list_sort(list_distinct(list(o_orderpriority)))[1:4] AS h, list_sort(list_distinct(list(o_orderstatus)))[1:12] AS e, list_sort(list_distinct(list(CAST(CAST(o_orderdate AS DATE) AS VARCHAR))))[1:6] AS l FROM orders GROUP BY 1)
  SELECT c_custkey, substr(c_name || ' — ' || c_mktsegment || CASE WHEN h IS NULL THEN '' ELSE ' — ' || array_to_string(h, ' | ') || ' — ' || array_to_string(e, ' ') || ' — ' || array_to_string(l, ' | ') END, 1, 700) AS rep FROM customer LEFT JOIN o ON c_custkey = o_custkey""")
def representative_text(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("h"), F.collect_set("o_orderstatus").alias("e"), F.collect_set(F.to_date("o_orderdate").cast("string")).alias("l"))
    c = table(spark, d, "customer").join(o, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select("c_custkey", story.representative_text(F.col("c_name"), F.col("c_mktsegment"), F.col("h"), F.col("e"), F.col("l")).alias("rep"))


@query("""SELECT event_id, CASE WHEN event_type IN ('signup', 'view') THEN 'core' WHEN event_id % 4 IN (0, 2) THEN 'peripheral' ELSE 'core' END AS salience FROM events""")
def claim_salience(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 4
    label = F.when(k == 0, "State Banquet menu").when(k == 1, "tariff rate").when(k == 2, "Trang phục tại lễ đón").otherwise("budget")
    kind = F.when(F.col("event_type") == "signup", "number").when(F.col("event_type") == "view", "range").otherwise("text")
    return table(spark, d, "events").select("event_id", story.salience(F.lit("said"), label, kind).alias("salience"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(o_custkey AS VARCHAR) WHEN 1 THEN CAST(o_custkey AS VARCHAR) WHEN 2 THEN CAST(o_custkey AS VARCHAR) || '.5' ELSE o_orderpriority END AS value FROM orders""")
def canonical_value(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey") % 4, F.col("o_custkey").cast("string")
    raw = F.when(k == 0, F.concat(F.lit("00"), c, F.lit(".000"))).when(k == 1, F.concat(F.lit(" +"), c, F.lit(" "))).when(k == 2, F.concat(c, F.lit(".50"))).otherwise(F.col("o_orderpriority"))
    return table(spark, d, "orders").select("o_orderkey", story.canonical_value(raw).alias("value"))


@query("""SELECT event_id, 'src' || user_id AS source, event_type || ' at: src' || user_id AS rest FROM events""")
def summary_parts(spark: SparkSession, d: str) -> DataFrame:
    """The source that a summary ends with, and the summary without its label."""
    e = table(spark, d, "events").select("event_id", F.concat(F.lit("New: "), F.col("event_type"), F.lit(" at: src"), F.col("user_id").cast("string")).alias("s"))
    return e.select("event_id", story.coverage_source(F.col("s")).alias("source"), story.without_label(F.col("s"), F.lit("New")).alias("rest"))


@query("""SELECT event_id, format('{:08x}-{:04x}-7', epoch_us(CAST(ts AS TIMESTAMP)) // 1000 // 65536, epoch_us(CAST(ts AS TIMESTAMP)) // 1000 % 65536) || md5(CAST(event_id AS VARCHAR))[1:3] || '-8' || md5(CAST(event_id AS VARCHAR))[4:6] || '-' || md5(CAST(event_id AS VARCHAR))[7:18] AS id FROM events""")
def time_ids(spark: SparkSession, d: str) -> DataFrame:
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select("event_id", story.time_id(ms, F.col("event_id")).alias("id"))


@query(None)
def lcg_shuffle(spark: SparkSession, d: str) -> DataFrame:
    """Each customer's orders in a shuffled order, seeded by the customer."""
    o = table(spark, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list("o_orderkey")).alias("keys"))
    return o.select("o_custkey", "keys", story.lcg_shuffled(F.col("keys"), F.col("o_custkey")).alias("shuffled"))


@query("""WITH s AS (SELECT event_id, user_id, value, ts >= TIMESTAMP '2024-01-20' AS fresh FROM events), a AS (SELECT event_id, value, 'new' AS lane FROM s WHERE fresh ORDER BY value DESC, event_id LIMIT 7), b AS (SELECT event_id, value, 'still' AS lane FROM s WHERE NOT fresh AND value >= 45 ORDER BY value DESC, event_id LIMIT 5) SELECT * FROM a UNION ALL SELECT * FROM b""")
def two_lanes(spark: SparkSession, d: str) -> DataFrame:
    """The 7 best new items, and the 5 best older ones that still score 45."""
    fresh = F.col("ts") >= F.lit("2024-01-20").cast("timestamp_ntz")
    lane = lambda rows, name, n: rows.orderBy(F.desc("value"), "event_id").limit(n).select("event_id", "value", F.lit(name).alias("lane"))
    e = table(spark, d, "events")
    return lane(e.filter(fresh), "new", 7).unionByName(lane(e.filter(~fresh & (F.col("value") >= 45)), "still", 5))


@query("""WITH f AS (SELECT text, min(doc_id) AS origin FROM documents GROUP BY 1) SELECT source, count(*) AS fetched, count(*) FILTER (origin = doc_id) AS origins, count(*) FILTER (origin < doc_id) AS derived, count(*) FILTER (documents.text IS NULL) AS unknown,
  CASE WHEN count(origin) > 0 THEN round(count(*) FILTER (origin < doc_id) / count(origin), 9) END AS syndication_ratio FROM documents LEFT JOIN f ON f.text = documents.text GROUP BY 1""")
def ingest_telemetry(spark: SparkSession, d: str) -> DataFrame:
    """What each source brings: texts that no document of a smaller id has, and copies."""
    docs = table(spark, d, "documents").select("doc_id", "source", F.xxhash64("text").alias("h"), F.sha2("text", 256).alias("digest"))
    first = docs.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("origin"))
    joined = docs.join(first, "digest", "left")
    origins, derived = F.count_if(F.col("origin") == F.col("doc_id")), F.count_if(F.col("origin") < F.col("doc_id"))
    c = joined.groupBy("source").agg(F.count("*").alias("fetched"), origins.alias("origins"), derived.alias("derived"), F.count_if(F.col("digest").isNull()).alias("unknown"))
    return c.withColumn("syndication_ratio", F.round(F.col("derived") / F.nullif(F.col("origins") + F.col("derived"), F.lit(0)), 9))


@query("""WITH RECURSIVE e AS (SELECT event_id AS child, CASE WHEN event_id % 4 <> 0 THEN event_id // 3 END AS parent FROM events), c(child, ancestor, depth) AS (SELECT child, parent, 1 FROM e WHERE parent IS NOT NULL UNION ALL SELECT c.child, e.parent, depth + 1 FROM c JOIN e ON e.child = c.ancestor WHERE e.parent IS NOT NULL AND depth < 8) SELECT * FROM c""")
def frontier_closure(spark: SparkSession, d: str) -> DataFrame:
    """All ancestors of each document within 8 steps."""
    edges = table(spark, d, "events").select(F.col("event_id").alias("child"), F.when(F.col("event_id") % 4 != 0, F.expr("event_id div 3")).alias("parent"))
    return ancestors(edges, 8)


@query("""WITH i AS (SELECT * FROM events WHERE event_type = 'purchase'), c AS (SELECT * FROM events WHERE event_type = 'signup'), s AS (SELECT i.event_id AS incoming, c.event_id AS candidate, round(1 - abs(i.value - c.value) / 1000, 6) AS score FROM i JOIN c ON i.user_id = c.user_id AND c.ts BETWEEN i.ts - INTERVAL 72 HOUR AND i.ts),
  b AS (SELECT incoming, max(score) AS score FROM s GROUP BY 1), w AS (SELECT incoming, score, min(candidate) AS event FROM s JOIN b USING (incoming, score) WHERE score > 0.2 GROUP BY 1, 2)
  SELECT i.event_id AS incoming, coalesce(event, i.event_id) AS event, event IS NULL AS created, w.score FROM i LEFT JOIN w ON incoming = i.event_id""")
def candidate_argmax(spark: SparkSession, d: str) -> DataFrame:
    """Each incoming story's best candidate of the last 72 hours, ties to the smaller id; a new event where none scores above 0.2."""
    e = table(spark, d, "events")
    inc = e.filter("event_type = 'purchase'").select(F.col("event_id").alias("incoming"), "user_id", F.col("ts").alias("t"), F.col("value").alias("v"))
    cand = e.filter("event_type = 'signup'").select("event_id", "user_id", "ts", "value")
    pairs = inc.join(cand, "user_id").filter("ts between t - interval 72 hours and t").withColumn("score", F.round(1 - F.abs(F.col("v") - F.col("value")) / 1000, 6)).filter("score > 0.2")
    best = pairs.groupBy("incoming").agg(F.max(F.struct("score", -F.col("event_id"))).alias("b"))
    return inc.join(best, "incoming", "left").select("incoming", F.coalesce(-F.col("b.col2"), "incoming").alias("event"), F.col("b").isNull().alias("created"), F.col("b.score").alias("score"))


@query("""WITH i AS (SELECT *, user_id % 3 AS ev FROM events) SELECT ev AS event, array_to_string(list_sort(list_distinct(list(event_type))), ' ') AS signature, count(*) AS attached FROM i GROUP BY 1""")
def accumulated_signature(spark: SparkSession, d: str) -> DataFrame:
    """An event's entity signature after all its attachments: their union, in order."""
    e = table(spark, d, "events").groupBy((F.col("user_id") % 3).alias("event"))
    return e.agg(F.array_join(F.array_sort(F.collect_set("event_type")), " ").alias("signature"), F.count("*").alias("attached"))


@query("""WITH g AS (SELECT user_id AS id, CASE WHEN user_id % 4 = 0 THEN 'resolved' ELSE 'active' END AS status, max(ts) AS last_at FROM events GROUP BY 1) SELECT id, last_at, 'resolved' AS status FROM g WHERE status = 'active' AND last_at < TIMESTAMP '2024-01-29 12:00:00' - INTERVAL 48 HOUR""")
def stale_events(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(F.max("ts").alias("last_at")).withColumn("status", F.when(F.col("id") % 4 == 0, "resolved").otherwise("active"))
    return stories.stale_events(g, F.lit("2024-01-29 12:00:00").cast("timestamp_ntz"))


@query("""WITH n AS (SELECT user_id AS claim, count(DISTINCT event_type) AS k FROM events GROUP BY 1), s AS (SELECT claim, CASE claim % 5 WHEN 0 THEN 'retracted' WHEN 1 THEN 'supported' WHEN 2 THEN 'disputed' ELSE 'reported' END AS old, CASE WHEN k >= 5 THEN 'supported' WHEN k = 4 THEN 'disputed' ELSE 'reported' END AS state FROM n) SELECT claim, state, old FROM s WHERE claim % 5 <> 0 AND old <> state""")
def adjudicated_claims(spark: SparkSession, d: str) -> DataFrame:
    """Recomputed states that differ from the stored ones; retracted claims stay."""
    k = F.countDistinct("event_type")
    computed = table(spark, d, "events").groupBy(F.col("user_id").alias("claim")).agg(F.when(k >= 5, "supported").when(k == 4, "disputed").otherwise("reported").alias("state"))
    m = F.col("claim") % 5
    held = computed.select("claim", F.when(m == 0, "retracted").when(m == 1, "supported").when(m == 2, "disputed").otherwise("reported").alias("state"))
    return stories.adjudicated(held, computed)


@query("""WITH p AS (SELECT l_suppkey AS plan, l_partkey AS key, CASE WHEN l_linenumber = 1 THEN NULL WHEN l_quantity >= 49 THEN -l_partkey ELSE l_partkey * 10 END AS figi FROM lineitem), k AS (SELECT p_partkey AS key, p_partkey * 10 AS figi FROM part WHERE p_size > 5),
  c AS (SELECT plan, CASE WHEN a.figi <> p.figi THEN 'durable_id' WHEN b.key <> p.key THEN 'key' END AS conflict FROM p LEFT JOIN k a ON a.key = p.key LEFT JOIN k b ON b.figi = p.figi) SELECT plan, min(conflict) AS conflict, count(*) AS rows, min(conflict) IS NULL AS applied FROM c GROUP BY 1""")
def instrument_plans(spark: SparkSession, d: str) -> DataFrame:
    part, k = table(spark, d, "part"), F.col("l_partkey")
    plans = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("plan"), k.alias("key"), F.when(F.col("l_linenumber") == 1, F.lit(None)).when(F.col("l_quantity") >= 49, -k).otherwise(k * 10).alias("figi"))
    known = part.filter("p_size > 5").select(F.col("p_partkey").alias("key"), (F.col("p_partkey") * 10).alias("figi"))
    return stories.instrument_plans(plans, known)


@query("""SELECT o_orderkey, greatest(0, 48 - o_custkey % 60) + least(60, (o_orderkey % 7) * 15) + (o_orderkey % 4) * 35 + CASE WHEN o_orderstatus = 'O' THEN 15 ELSE 0 END + CASE WHEN o_custkey % 2 = 0 THEN 10 ELSE 0 END + CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 45 WHEN '2' THEN 40 WHEN '3' THEN 35 WHEN '4' THEN 30 ELSE 0 END AS significance,
  round(CAST((o_orderkey % 8) / 8 * 0.2 + (o_custkey % 8) / 8 * 0.2 + 0.05 + 0.1 * (o_orderkey % 2) + 0.4 * (o_custkey % 4) / 4 AS DOUBLE), 9) AS impact, CASE WHEN o_custkey % 9 = 0 THEN 0.5 ELSE round(CAST(least(1, (o_orderkey % 4) * 0.35 + CASE WHEN o_custkey % 3 = 0 THEN 0.25 ELSE 0 END + CASE WHEN o_custkey % 5 = 0 THEN 0.15 ELSE 0 END) AS DOUBLE), 9) END AS relevance FROM orders""")
def story_scores(spark: SparkSession, d: str) -> DataFrame:
    """Significance, impact and personal relevance of stories."""
    o, c, p = F.col("o_orderkey"), F.col("o_custkey"), F.substring("o_orderpriority", 1, 1)
    domain = F.when(p == "1", "geopolitics").when(p == "2", "frontier_tech").when(p == "3", "economy").when(p == "4", "national_policy").otherwise("other")
    sig = decide.significance(c % 60, o % 7, o % 4 + 1, F.col("o_orderstatus") == "O", c % 2 == 0, domain)
    impact = decide.impact(o % 8 / 8, c % 8 / 8, F.lit(0.5), o % 2, c % 4 / 4)
    relevance = decide.relevance(o % 4, c % 3 == 0, c % 5 == 0, c % 9 != 0)
    return table(spark, d, "orders").select("o_orderkey", sig.cast("bigint").alias("significance"), F.round(impact, 9).alias("impact"), F.round(relevance, 9).alias("relevance"))


@query("""WITH a AS (SELECT user_id AS story, event_id AS id, 'src' || (event_id % 4) AS source, event_type AS side, CASE WHEN event_id % 2 = 0 THEN 'vi' ELSE 'en' END AS lang, event_type = 'signup' AS headline, event_id % 10 AS len, ts AS t FROM events),
  r AS (SELECT *, row_number() OVER (PARTITION BY story ORDER BY (lang = 'vi') DESC, CASE WHEN headline THEN 1 ELSE 0 END + len / 1000 DESC, id) AS k FROM a)
  SELECT story, max(id) FILTER (k = 1) AS lead, count(*) AS n, count(DISTINCT source) AS sources, max(t) AS latest, bool_or(headline) AS headline, count(DISTINCT side) AS sides, round(epoch(TIMESTAMP '2024-01-30 00:00:00' - date_trunc('second', max(t))) / 3600, 6) AS age_hours,
  epoch(TIMESTAMP '2024-01-30 00:00:00' - date_trunc('second', max(t))) / 3600 <= 4 AND (bool_or(headline) OR count(DISTINCT source) > 1) AS breaking, count(DISTINCT side) = 1 AND count(DISTINCT source) >= 2 AS blindspot FROM r GROUP BY 1""")
def finalized_stories(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("event_id")
    a = table(spark, d, "events").select(
        F.col("user_id").alias("story"), i.alias("id"), F.concat(F.lit("src"), (i % 4).cast("string")).alias("source"), F.col("event_type").alias("side"), F.when(i % 2 == 0, "vi").otherwise("en").alias("lang"),
        (F.col("event_type") == "signup").alias("headline"), F.repeat(F.lit("x"), (i % 10).cast("int")).alias("summary"), F.col("ts").alias("at"),
    )
    s = stories.finalize(a, F.lit("2024-01-30 00:00:00").cast("timestamp"))
    return s.withColumn("age_hours", F.round("age_hours", 6))


@query("""WITH v AS (SELECT l_orderkey AS claim, l_linenumber AS voter, l_returnflag AS pos, l_quantity, l_linestatus = 'F' AS prim FROM lineitem), s AS (SELECT claim, pos, count(DISTINCT voter) AS voters, bool_or(prim) AS prim FROM v WHERE l_quantity > 3 GROUP BY 1, 2),
  t AS (SELECT *, row_number() OVER (PARTITION BY claim ORDER BY prim DESC, voters DESC, pos) AS k, count(*) OVER (PARTITION BY claim) AS positions FROM s), o AS (SELECT o_orderkey AS claim, o_orderstatus AS state FROM orders)
  SELECT claim, CASE WHEN state = 'P' THEN 'own' ELSE pos END AS standing, positions, voters FROM t JOIN o USING (claim) WHERE k = 1""")
def standing_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The position that a claim's standing evidence holds: primary first, then by voters; claims in a protected state keep their own."""
    v = table(spark, d, "lineitem").filter("l_quantity > 3").groupBy(F.col("l_orderkey").alias("claim"), F.col("l_returnflag").alias("pos")).agg(F.countDistinct("l_linenumber").alias("voters"), F.bool_or(F.col("l_linestatus") == "F").alias("prim"))
    w = Window.partitionBy("claim")
    top = v.withColumn("k", F.row_number().over(w.orderBy(F.desc("prim"), F.desc("voters"), "pos"))).withColumn("positions", F.count("*").over(w)).filter("k = 1")
    state = table(spark, d, "orders").select(F.col("o_orderkey").alias("claim"), F.col("o_orderstatus").alias("state"))
    return top.join(state, "claim").select("claim", F.when(F.col("state") == "P", "own").otherwise(F.col("pos")).alias("standing"), "positions", "voters")


@query("""SELECT event_id, ts, event_type FROM events WHERE ts >= TIMESTAMP '2024-01-29 00:00:00' - INTERVAL 3 DAY""")
def freshness_gate(spark: SparkSession, d: str) -> DataFrame:
    from tesserae.streaming.jobs import fresh_only

    e = table(spark, d, "events").withColumn("at", F.col("ts"))
    return fresh_only(e, F.lit("2024-01-29 00:00:00").cast("timestamp_ntz")).select("event_id", "ts", "event_type")
