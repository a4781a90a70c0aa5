"""Relational operators over the star schema: filters, joins, aggregates, windows, sorts and set operations.

Each query is one DataFrame plan: filters and columns reach the scans, joins are equi-joins whose strategy AQE picks from
the sizes it sees, and per-key limits are windows that WindowGroupLimit cuts before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.sources.tables import table

#: Lines of an order a task, where a join of lines makes more rows than it reads.
TASK_ROWS = 250_000

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# -- predicates -------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('F', 'P')")
def live_filter(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").filter(~F.col("o_orderstatus").isin("F", "P")).select("o_orderkey", "o_orderstatus")


def between_optional(df: DataFrame, column: str, low=None, high=None) -> DataFrame:
    """Rows within the given ends; an end that is None doesn't filter, so that no (x IS NULL OR ...) hides the predicate from the scan."""
    if low is not None:
        df = df.filter(F.col(column) >= low)
    return df if high is None else df.filter(F.col(column) <= high)


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01'")
def range_filter(spark: SparkSession, d: str) -> DataFrame:
    low = F.lit("1997-01-01").cast("timestamp_ntz")
    return between_optional(table(spark, d, "orders"), "o_orderdate", low, None).select("o_orderkey", "o_orderdate")


def channel_filter(tiers: list[str], types: list[str], tier: Column, kind: Column, score: Column, least: float, exempt: Column) -> Column:
    """(tier in tiers OR kind in types) AND (score, missing as -1, reaches least OR exempt); no channels at all is FALSE."""
    if not tiers and not types:
        return F.lit(False)
    either = F.lit(False)
    if tiers:
        either = either | tier.isin(*tiers)
    if types:
        either = either | kind.isin(*types)
    return either & ((F.coalesce(score, F.lit(-1.0)) >= least) | exempt)


@query("""SELECT event_id, event_type, value FROM events WHERE (event_type IN ('purchase') OR user_id % 10 = 3)
  AND (coalesce(value, -1) >= 100 OR event_type = 'error')""")
def channel_gate(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("bucket", (F.col("user_id") % 10).cast("string"))
    gate = channel_filter(["purchase"], ["3"], F.col("event_type"), F.col("bucket"), F.col("value"), 100, F.col("event_type") == "error")
    return e.filter(gate).select("event_id", "event_type", "value")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_returnflag, l_linestatus) IN (('R', 'F'), ('N', 'O'))")
def tuple_in(spark: SparkSession, d: str) -> DataFrame:
    pairs = spark.createDataFrame([("R", "F"), ("N", "O")], "l_returnflag string, l_linestatus string")
    return table(spark, d, "lineitem").join(F.broadcast(pairs), ["l_returnflag", "l_linestatus"], "left_semi").select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT p_partkey, p_name FROM part WHERE list_contains(string_split(p_name, ' '), 'red') OR list_contains(string_split(p_name, ' '), 'blue')")
def token_match(spark: SparkSession, d: str) -> DataFrame:
    words = F.split("p_name", " ")
    return table(spark, d, "part").filter(F.arrays_overlap(words, F.array(F.lit("red"), F.lit("blue")))).select("p_partkey", "p_name")


@query("SELECT event_id, ts FROM events WHERE ts > TIMESTAMP '2024-01-20' - INTERVAL 48 HOUR AND ts <= TIMESTAMP '2024-01-20'")
def recent_window(spark: SparkSession, d: str) -> DataFrame:
    as_of = F.lit("2024-01-20").cast("timestamp_ntz")
    return table(spark, d, "events").filter((F.col("ts") > as_of - F.expr("INTERVAL 48 HOURS")) & (F.col("ts") <= as_of)).select("event_id", "ts")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k")
    return table(spark, d, "events").filter(k.isNotNull()).select("event_id", k.cast("bigint").alias("k"))


def first_reason(*checks: tuple[str, Column]) -> Column:
    """The name of the first check that holds, else null."""
    out = None
    for name, failed in checks:
        out = F.when(failed, name) if out is None else out.when(failed, name)
    return out


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity IS NULL OR l_quantity <= 0 THEN 'nonpositive_quantity' WHEN l_discount > 0.09 THEN 'discount_high'
  WHEN l_extendedprice < l_quantity * 1000 THEN 'price_low' WHEN l_tax > 0.07 THEN 'tax_high' END AS reason FROM lineitem""")
def validate_quarantine(spark: SparkSession, d: str) -> DataFrame:
    """Each row with the reason why it is quarantined, null for good rows."""
    reason = first_reason(
        ("nonpositive_quantity", F.col("l_quantity").isNull() | (F.col("l_quantity") <= 0)), ("discount_high", F.col("l_discount") > 0.09),
        ("price_low", F.col("l_extendedprice") < F.col("l_quantity") * 1000), ("tax_high", F.col("l_tax") > 0.07))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", reason.alias("reason"))


def exactly_one(*columns: str) -> Column:
    return sum((F.col(c).isNotNull().cast("int") for c in columns[1:]), F.col(columns[0]).isNotNull().cast("int")) == 1


@query("""WITH s AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN user_id END AS a, CASE WHEN event_id % 3 = 1 THEN user_id END AS b, CASE WHEN event_id % 5 = 2 THEN user_id END AS c FROM events)
  SELECT event_id, (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT = 1 AS valid FROM s""")
def exclusive_arc(spark: SparkSession, d: str) -> DataFrame:
    i, u = F.col("event_id"), F.col("user_id")
    arcs = table(spark, d, "events").select("event_id", F.when(i % 3 == 0, u).alias("a"), F.when(i % 3 == 1, u).alias("b"), F.when(i % 5 == 2, u).alias("c"))
    return arcs.select("event_id", exactly_one("a", "b", "c").alias("valid"))


@query("""SELECT event_id, CASE WHEN event_type = 'purchase' THEN 'keep' WHEN event_type = 'click' AND value >= 90 THEN 'keep' WHEN event_type = 'view' AND value >= 70 AND user_id % 2 = 0 THEN 'keep' ELSE 'drop' END AS kept FROM events""")
def volume_control(spark: SparkSession, d: str) -> DataFrame:
    t, v = F.col("event_type"), F.col("value")
    keep = (t == "purchase") | ((t == "click") & (v >= 90)) | ((t == "view") & (v >= 70) & (F.col("user_id") % 2 == 0))
    return table(spark, d, "events").select("event_id", F.when(keep, "keep").otherwise("drop").alias("kept"))


def quiet(hour: Column, begin: int, end: int) -> Column:
    """Whether the hour lies in [begin, end), which may wrap midnight."""
    return (hour >= begin) & (hour < end) if begin <= end else (hour >= begin) | (hour < end)


@query("""SELECT event_id, (hour(ts + INTERVAL 7 HOUR) >= 22 OR hour(ts + INTERVAL 7 HOUR) < 7) AND event_type <> 'error' AS muted FROM events""")
def quiet_hours(spark: SparkSession, d: str) -> DataFrame:
    local = F.hour(F.col("ts") + F.expr("INTERVAL 7 HOURS"))
    return table(spark, d, "events").select("event_id", (quiet(local, 22, 7) & (F.col("event_type") != "error")).alias("muted"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN lpad(CAST(event_id AS VARCHAR), 8, '0') ELSE 'key:' || CAST(event_id AS VARCHAR) END AS ref,
  CASE WHEN event_id % 2 = 0 THEN 'id' ELSE 'key' END AS shape FROM events""")
def identifier_shape(spark: SparkSession, d: str) -> DataFrame:
    ref = F.when(F.col("event_id") % 2 == 0, F.lpad(F.col("event_id").cast("string"), 8, "0")).otherwise(F.concat(F.lit("key:"), F.col("event_id").cast("string")))
    out = table(spark, d, "events").select("event_id", ref.alias("ref"))
    return out.withColumn("shape", F.when(F.col("ref").rlike("^[0-9]{8}$"), "id").otherwise("key"))


@query("""WITH s AS (SELECT event_id, printf('2023-%02d-%02d', event_id % 13, event_id % 33) AS day FROM events)
  SELECT event_id, day, try_cast(day AS DATE) IS NOT NULL AS valid FROM s""")
def calendar_date(spark: SparkSession, d: str) -> DataFrame:
    day = F.format_string("2023-%02d-%02d", F.col("event_id") % 13, F.col("event_id") % 33)
    out = table(spark, d, "events").select("event_id", day.alias("day"))
    return out.withColumn("valid", F.expr("try_to_date(day, 'yyyy-MM-dd') is not null"))


@query("SELECT p_partkey, p_brand, p_type FROM part WHERE NOT starts_with(p_type, p_brand || ':')")
def not_prefixed(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").filter(~F.col("p_type").startswith(F.concat("p_brand", F.lit(":")))).select("p_partkey", "p_brand", "p_type")


# -- joins ------------------------------------------------------------------------------------------------------------


@query("""SELECT r_name, n_name, CAST(count(*) AS BIGINT) AS items, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM region JOIN nation ON n_regionkey = r_regionkey
  JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F' GROUP BY 1, 2""")
def star_inner(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    place = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("c_custkey", "n_name", "r_name")
    orders = t("orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_custkey")
    items = t("lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("x"))
    joined = items.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(place, F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy("r_name", "n_name").agg(F.count("*").alias("items"), F.round(F.sum("x"), 2).alias("revenue"))


@query("""SELECT o_orderkey, coalesce(c_name, s_name, 'unknown') AS subject, n_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 5000
  LEFT JOIN supplier ON o_custkey = s_suppkey LEFT JOIN nation ON n_nationkey = coalesce(c_nationkey, s_nationkey)""")
def left_chain(spark: SparkSession, d: str) -> DataFrame:
    t = lambda n: table(spark, d, n)
    c = t("customer").filter("c_acctbal > 5000")
    out = t("orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left").join(t("supplier"), F.col("o_custkey") == F.col("s_suppkey"), "left")
    out = out.join(t("nation"), F.col("n_nationkey") == F.coalesce("c_nationkey", "s_nationkey"), "left")
    return out.select("o_orderkey", F.coalesce("c_name", "s_name", F.lit("unknown")).alias("subject"), "n_name")


@query("""SELECT c_custkey, coalesce(n, 0) AS orders, total FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1) ON o_custkey = c_custkey""")
def left_agg(spark: SparkSession, d: str) -> DataFrame:
    sums = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return table(spark, d, "customer").join(sums, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", F.coalesce("n", F.lit(0)).alias("orders"), "total")


@query("""SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN (SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey DESC) ON o_custkey = c_custkey""")
def left_latest(spark: SparkSession, d: str) -> DataFrame:
    last = table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_orderdate", "o_orderkey")).alias("o"))
    return table(spark, d, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o.o_orderkey", "o.o_totalprice")


@query("""WITH p AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem), c AS (SELECT a.l_partkey AS part, b.l_partkey AS other, count(*) AS n FROM p a JOIN p b ON a.l_orderkey = b.l_orderkey AND a.l_partkey <> b.l_partkey
  GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY n DESC, other) AS rank FROM c) SELECT part, other, n, rank FROM r WHERE rank <= 8""")
def co_occurrence(spark: SparkSession, d: str) -> DataFrame:
    """What appears with each part in an order, the 8 most frequent. Tasks grow in number with the lines, not in size; pairs go to the shuffle as they are, as few repeat within a task."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    n = max(spark.sparkContext.defaultParallelism, -(-lines.count() // TASK_ROWS))  # the count comes from the files' footers
    p = lines.repartition(n, "l_orderkey").distinct()
    a, b = p.select("l_orderkey", F.col("l_partkey").alias("part")), p.select("l_orderkey", F.col("l_partkey").alias("other"))
    pairs = a.join(b, "l_orderkey").filter("part < other").select("part", "other").repartition(n, "part", "other")
    c = pairs.groupBy("part", "other").agg(F.count("*").alias("n"))  # each pair is counted once, then told both ways
    both = c.select(F.inline(F.array(F.struct("part", "other", "n"), F.struct(F.col("other").alias("part"), F.col("part").alias("other"), "n")))).repartition(n, "part")
    return both.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy(F.desc("n"), "other"))).filter("rank <= 8")


@query("""SELECT a.l_orderkey, a.l_linenumber AS a_line, b.l_linenumber AS b_line, round(a.l_quantity - b.l_quantity, 2) AS diff FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey
  WHERE a.l_returnflag = 'N' AND b.l_returnflag = 'R'""")
def provider_pairs(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    side = lambda n, flag: li.filter(F.col("l_returnflag") == flag).select("l_orderkey", F.col("l_linenumber").alias(f"{n}_line"), F.col("l_quantity").alias(f"{n}_q"))
    return side("a", "N").join(side("b", "R"), "l_orderkey").select("l_orderkey", "a_line", "b_line", F.round(F.col("a_q") - F.col("b_q"), 2).alias("diff"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def anti_not_exists(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").join(table(spark, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey + 1 FROM lineitem WHERE l_returnflag = 'R' AND l_partkey IS NOT NULL)")
def anti_superseded(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "lineitem").filter("l_returnflag = 'R' and l_partkey is not null").select((F.col("l_partkey") + 1).alias("gone"))
    return table(spark, d, "part").join(gone, F.col("p_partkey") == F.col("gone"), "left_anti").select("p_partkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def semi_in(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'")
    return table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 49)")
def semi_exists(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").filter("l_quantity >= 49")
    return table(spark, d, "part").join(li, F.col("p_partkey") == F.col("l_partkey"), "left_semi").select("p_partkey")


@query("""WITH s AS (SELECT o_orderkey AS k, o_orderstatus AS v FROM orders WHERE o_orderkey % 7 <> 0), e AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END AS v FROM orders WHERE o_orderkey % 5 <> 0)
  SELECT coalesce(s.k, e.k) AS k, CASE WHEN s.k IS NULL THEN 'missing' WHEN e.k IS NULL THEN 'stale' WHEN s.v IS DISTINCT FROM e.v THEN 'refresh' ELSE 'kept' END AS state FROM s FULL JOIN e ON s.k = e.k""")
def set_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Stored rows against expected ones: missing, stale, refresh or kept."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("v"))
    s, e = o.filter("k % 7 <> 0").alias("s"), o.filter("k % 5 <> 0").withColumn("v", F.when(F.col("k") % 11 == 0, "X").otherwise(F.col("v"))).alias("e")
    state = F.when(F.col("s.k").isNull(), "missing").when(F.col("e.k").isNull(), "stale").when(~F.col("s.v").eqNullSafe(F.col("e.v")), "refresh").otherwise("kept")
    return s.join(e, F.col("s.k") == F.col("e.k"), "full_outer").select(F.coalesce("s.k", "e.k").alias("k"), state.alias("state"))


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def unnest_split(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("word"))


@query("SELECT n_name, d.day, d.n FROM nation, LATERAL (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey = n_nationkey GROUP BY 1 ORDER BY n DESC, day LIMIT 1) d")
def lateral_top(spark: SparkSession, d: str) -> DataFrame:
    """The busiest day of each nation."""
    by = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy("c_nationkey", F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    top = by.groupBy("c_nationkey").agg(F.max_by(F.struct("day", "n"), F.struct("n", -F.datediff("day", F.lit("1970-01-01").cast("date")))).alias("x"))
    return table(spark, d, "nation").join(top, F.col("n_nationkey") == F.col("c_nationkey")).select("n_name", "x.day", "x.n")


# -- aggregates -------------------------------------------------------------------------------------------------------


@query("""SELECT o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS customers, count(*) FILTER (o_orderstatus = 'F') AS done, CAST(sum(CASE WHEN o_totalprice > 100000 THEN 1 ELSE 0 END) AS BIGINT) AS big,
  bool_or(o_totalprice > 200000) AS any_big, min(o_orderkey) AS first_key, min(o_orderdate) AS first_day, max(o_orderdate) AS last_day FROM orders GROUP BY 1""")
def filtered_aggs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_orderpriority").agg(
        F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"), F.count_if(F.col("o_orderstatus") == "F").alias("done"), F.sum(F.when(F.col("o_totalprice") > 100000, 1).otherwise(0)).alias("big"),
        F.bool_or(F.col("o_totalprice") > 200000).alias("any_big"), F.min("o_orderkey").alias("first_key"), F.min("o_orderdate").alias("first_day"), F.max("o_orderdate").alias("last_day"))


@query("SELECT o_custkey, max(o_orderdate) FILTER (o_orderdate <= TIMESTAMP '1999-01-01') AS actual, max(o_orderdate) AS horizon FROM orders GROUP BY 1")
def actual_and_horizon(spark: SparkSession, d: str) -> DataFrame:
    day = F.col("o_orderdate")
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.max(F.when(day <= F.lit("1999-01-01").cast("timestamp_ntz"), day)).alias("actual"), F.max(day).alias("horizon"))


@query("""SELECT l_orderkey, max(CASE WHEN l_returnflag = 'N' THEN l_quantity END) AS n_qty, max(CASE WHEN l_returnflag = 'R' THEN l_quantity END) AS r_qty, max(CASE WHEN l_returnflag = 'A' THEN l_quantity END) AS a_qty FROM lineitem GROUP BY 1""")
def pivot_conditional(spark: SparkSession, d: str) -> DataFrame:
    wide = table(spark, d, "lineitem").groupBy("l_orderkey").pivot("l_returnflag", ["N", "R", "A"]).agg(F.max("l_quantity"))
    return wide.select("l_orderkey", F.col("N").alias("n_qty"), F.col("R").alias("r_qty"), F.col("A").alias("a_qty"))


@query("SELECT l_orderkey, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1 HAVING count(*) > 1 AND count(DISTINCT l_suppkey) > 3")
def having_distinct(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.countDistinct("l_suppkey").alias("suppliers")).filter("n > 1 and suppliers > 3")


@query("SELECT coalesce(CASE WHEN c_acctbal > 0 THEN c_mktsegment END, 'in debt') AS grp, count(*) AS n, min(c_name) AS sample FROM customer GROUP BY 1")
def group_expr(spark: SparkSession, d: str) -> DataFrame:
    grp = F.coalesce(F.when(F.col("c_acctbal") > 0, F.col("c_mktsegment")), F.lit("in debt"))
    return table(spark, d, "customer").groupBy(grp.alias("grp")).agg(F.count("*").alias("n"), F.min("c_name").alias("sample"))


def nearest_rank(sorted_values: Column, p: float) -> Column:
    """Element floor(p * n), from 0 and n - 1 at most."""
    n = F.size(sorted_values)
    return F.element_at(sorted_values, F.least(F.floor(F.lit(p) * n), n - 1).cast("int") + 1)


@query("""WITH v AS (SELECT l_returnflag, l_quantity AS q, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem)
  SELECT l_returnflag, median(q) AS med, max(q) FILTER (i = least(CAST(floor(0.9 * n) AS BIGINT), n - 1)) AS p90, max(q) FILTER (i = CAST(ceil(0.25 * n) AS BIGINT) - 1) AS q25 FROM v GROUP BY 1""")
def median_percentile(spark: SparkSession, d: str) -> DataFrame:
    """Exact median and both nearest-rank conventions, floor(p n) and ceil(p n) - 1, from counts of the distinct values: no list of a group's rows."""
    counts = table(spark, d, "lineitem").groupBy("l_returnflag", F.col("l_quantity").alias("q")).agg(F.count("*").alias("c"))
    w = Window.partitionBy("l_returnflag")
    runs = counts.withColumn("upto", F.sum("c").over(w.orderBy("q"))).withColumn("n", F.sum("c").over(w))
    at = lambda i: F.min(F.when(F.col("upto") > i, F.col("q")))  # noqa: E731  the value at place i from 0
    n = F.col("n")
    return runs.groupBy("l_returnflag").agg(((at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2).alias("med"), at(F.least(F.floor(n * 0.9), n - 1)).alias("p90"), at(F.ceil(n * 0.25) - 1).alias("q25"))


@query("""WITH t AS (SELECT o_custkey, max(CASE o_orderpriority WHEN '1-URGENT' THEN 5 WHEN '2-HIGH' THEN 4 WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 2 ELSE 1 END) AS level FROM orders GROUP BY 1),
  r AS (SELECT o.*, CASE o_orderpriority WHEN '1-URGENT' THEN 5 WHEN '2-HIGH' THEN 4 WHEN '3-MEDIUM' THEN 3 WHEN '4-NOT SPECIFIED' THEN 2 ELSE 1 END AS lv FROM orders o)
  SELECT r.o_custkey, any_value(level) AS level, count(*) FILTER (lv = level) AS drivers, count(*) FILTER (CASE WHEN level >= 3 THEN lv >= 3 ELSE lv = level END) AS contributors,
  max(o_totalprice) FILTER (lv = level) AS broadest, list_sort(list(DISTINCT o_orderstatus) FILTER (lv = level)) AS states FROM r JOIN t ON r.o_custkey = t.o_custkey GROUP BY 1""")
def max_lattice(spark: SparkSession, d: str) -> DataFrame:
    """Claims to event: the highest level, how many reach it (drivers), how many count (contributors), and set unions over the drivers."""
    p = F.col("o_orderpriority")
    level = F.when(p == "1-URGENT", 5).when(p == "2-HIGH", 4).when(p == "3-MEDIUM", 3).when(p == "4-NOT SPECIFIED", 2).otherwise(1)
    o = table(spark, d, "orders").withColumn("lv", level)
    # One aggregate: per (customer, level) first, then the top level of each customer.
    per = o.groupBy("o_custkey", "lv").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("broad"), F.sort_array(F.collect_set("o_orderstatus")).alias("states"))
    top = F.max_by(F.struct("n", "broad", "states"), "lv")
    return per.groupBy("o_custkey").agg(F.max("lv").alias("level"), top.alias("t"), F.sum(F.when(F.col("lv") >= 3, F.col("n")).otherwise(0)).alias("counted")).select(
        "o_custkey", "level", F.col("t.n").alias("drivers"), F.when(F.col("level") >= 3, F.col("counted")).otherwise(F.col("t.n")).alias("contributors"), F.col("t.broad").alias("broadest"), F.col("t.states").alias("states"))


@query("""SELECT metric, value FROM (SELECT 'orders_without_customer' AS metric, (SELECT count(*) FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey)) AS value
  UNION ALL SELECT 'items_without_order', (SELECT count(*) FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey))
  UNION ALL SELECT 'duplicate_order_keys', (SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1))
  UNION ALL SELECT 'bad_discounts', (SELECT count(*) FROM lineitem WHERE l_discount < 0 OR l_discount > 1)
  UNION ALL SELECT 'customers_without_order', (SELECT count(*) FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE c_custkey = o_custkey)))""")
def audit_suite(spark: SparkSession, d: str) -> DataFrame:
    """Integrity counts as (metric, value) rows."""
    t = lambda n: table(spark, d, n)
    checks = {
        "orders_without_customer": t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"), "left_anti"),
        "items_without_order": t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti"),
        "duplicate_order_keys": t("orders").groupBy("o_orderkey").count().filter("count > 1"),
        "bad_discounts": t("lineitem").filter("l_discount < 0 or l_discount > 1"),
        "customers_without_order": t("customer").join(t("orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti"),
    }
    out = None
    for name, rows in checks.items():
        one = rows.agg(F.count("*").alias("value")).select(F.lit(name).alias("metric"), "value")
        out = one if out is None else out.unionByName(one)
    return out


@query("""WITH t AS (SELECT lower(w) AS term FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w FROM part)) SELECT term, CAST(count(*) * 3 AS BIGINT) AS weight FROM t GROUP BY 1 HAVING count(*) >= 2 ORDER BY weight DESC, term LIMIT 10""")
def term_trending(spark: SparkSession, d: str) -> DataFrame:
    """Terms of two or more rows, entities weighing 3, the 10 heaviest."""
    words = table(spark, d, "part").select(F.explode(F.split("p_name", " ")).alias("w")).select(F.lower("w").alias("term"))
    return words.groupBy("term").agg(F.count("*").alias("n")).filter("n >= 2").select("term", (F.col("n") * 3).alias("weight")).orderBy(F.desc("weight"), "term").limit(10)


# -- windows and sorts ------------------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY md5(CAST(event_id AS VARCHAR)), event_id) AS rn FROM events),
  s AS (SELECT event_id FROM r WHERE rn <= 5 UNION SELECT event_id FROM (SELECT event_id FROM events ORDER BY md5(CAST(event_id AS VARCHAR)), event_id LIMIT 20)) SELECT event_id FROM s""")
def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """5 of each type and 20 of all by md5 of the id, without repeats."""
    e = table(spark, d, "events").select("event_type", "event_id", F.md5(F.col("event_id").cast("string").cast("binary")).alias("h"))
    each = e.withColumn("rn", F.row_number().over(Window.partitionBy("event_type").orderBy("h", "event_id"))).filter("rn <= 5").select("event_id")
    return each.union(e.orderBy("h", "event_id").limit(20).select("event_id")).distinct()


@query("SELECT o_custkey, o_orderkey, o_totalprice, rn FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3")
def capped_per_group(spark: SparkSession, d: str) -> DataFrame:
    rn = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", rn.alias("rn")).filter("rn <= 3")


@query("""SELECT event_type, event_id, rn FROM (SELECT event_type, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events) ORDER BY rn, event_type LIMIT 25""")
def round_robin(spark: SparkSession, d: str) -> DataFrame:
    """Types taken in turn."""
    rn = F.row_number().over(Window.partitionBy("event_type").orderBy("ts", "event_id"))
    # No more than 25 of a type can be among the first 25.
    return table(spark, d, "events").select("event_type", "event_id", rn.alias("rn")).filter("rn <= 25").orderBy("rn", "event_type").limit(25)


@query("SELECT c_custkey, x FROM (SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS x FROM customer) ORDER BY x DESC NULLS LAST, c_custkey LIMIT 50")
def top_nulls_last(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("x")).orderBy(F.desc_nulls_last("x"), "c_custkey").limit(50)


@query("SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn <= 4")
def keep_last_n(spark: SparkSession, d: str) -> DataFrame:
    """Retention: the 4 newest snapshots of each key."""
    rn = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_orderkey")))
    return table(spark, d, "orders").withColumn("rn", rn).filter("rn <= 4").select("o_orderkey", "o_custkey")


# -- sets -------------------------------------------------------------------------------------------------------------


@query("""SELECT 'out' AS direction, s_nationkey AS a, s_suppkey AS b FROM supplier UNION ALL SELECT 'in', c_nationkey, c_custkey FROM customer""")
def union_edges(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.lit("out").alias("direction"), F.col("s_nationkey").alias("a"), F.col("s_suppkey").alias("b"))
    c = table(spark, d, "customer").select(F.lit("in").alias("direction"), F.col("c_nationkey").alias("a"), F.col("c_custkey").alias("b"))
    return s.union(c)


@query("""SELECT 'both' AS kind, k FROM (SELECT s_nationkey AS k FROM supplier INTERSECT SELECT c_nationkey FROM customer) UNION ALL SELECT 'only_customers', k FROM (SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier)
  UNION ALL SELECT 'any', k FROM (SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer)""")
def set_ops(spark: SparkSession, d: str) -> DataFrame:
    s, c = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")), table(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    parts = {"both": s.intersect(c), "only_customers": c.exceptAll(s.intersect(c)).distinct().join(s, "k", "left_anti"), "any": s.union(c).distinct()}
    out = None
    for kind, rows in parts.items():
        one = rows.select(F.lit(kind).alias("kind"), "k")
        out = one if out is None else out.unionByName(one)
    return out


@query("""SELECT l_orderkey, list_sort(list(DISTINCT l_returnflag)) AS flags, list_sort(list_distinct(list_concat(list(DISTINCT l_returnflag), list(DISTINCT l_linestatus)))) AS signature FROM lineitem GROUP BY 1""")
def signature_union(spark: SparkSession, d: str) -> DataFrame:
    """Set union over a group's rows, sorted."""
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("f"), F.collect_set("l_linestatus").alias("s")).select("l_orderkey", F.sort_array("f").alias("flags"), F.sort_array(F.array_union("f", "s")).alias("signature"))


@query("""WITH k AS (SELECT user_id, event_type, value, event_id, row_number() OVER (PARTITION BY user_id, event_type, floor(value) ORDER BY ts, event_id) AS rn FROM events) SELECT user_id, event_type, event_id FROM k WHERE rn = 1""")
def dedupe_rows(spark: SparkSession, d: str) -> DataFrame:
    """Of rows that say the same, the first."""
    rn = F.row_number().over(Window.partitionBy("user_id", "event_type", F.floor("value")).orderBy("ts", "event_id"))
    return table(spark, d, "events").withColumn("rn", rn).filter("rn = 1").select("user_id", "event_type", "event_id")
