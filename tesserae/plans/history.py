"""Versioned facts: latest, as-of, revisions, diffs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.operators.versions import as_of, backward_as_of, latest, numbered
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


@query("SELECT DISTINCT ON (o_custkey) o_custkey, o_orderkey, o_totalprice, o_orderdate FROM orders ORDER BY o_custkey, o_orderdate DESC, o_orderkey DESC")
def latest_per_key(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate")
    return latest(o, ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("""SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC, l_quantity DESC) AS rn FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-06-30') WHERE rn = 1""")
def asof_vintage(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_shipdate", F.struct("l_linenumber", "l_partkey", "l_quantity").alias("version"))
    return as_of(li, ["l_orderkey"], "l_shipdate", "version", F.lit("1998-06-30").cast("timestamp_ntz")).drop("version")


@query("""SELECT t.o_orderkey AS target, count(h.o_orderkey) AS history, round(CAST(sum(CAST(round(h.o_totalprice * 100) AS BIGINT)) AS DOUBLE) / count(h.o_orderkey) / 100, 6) AS mean_price FROM orders t LEFT JOIN orders h ON h.o_custkey = t.o_custkey AND h.o_orderdate < t.o_orderdate GROUP BY 1""")
def asof_history(spark: SparkSession, d: str) -> DataFrame:
    """What was known before each target, as running sums over its key: no pairing of targets with their histories."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    same = Window.partitionBy("o_custkey", "o_orderdate")
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    o = o.withColumns({"n": F.count("*").over(w) - F.count("*").over(same), "total": F.sum("cents").over(w) - F.sum("cents").over(same)})
    return o.select(F.col("o_orderkey").alias("target"), F.col("n").alias("history"), F.round(F.when(F.col("n") > 0, F.col("total") / F.col("n") / 100), 6).alias("mean_price"))


@query("""WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber, o_custkey, l_shipdate FROM lineitem JOIN orders ON o_orderkey = l_orderkey), j AS (SELECT l.*, o.o_orderkey AS last_order, o.o_orderdate AS o_orderdate, row_number() OVER (PARTITION BY l_orderkey, l_linenumber, l_shipdate ORDER BY o.o_orderdate DESC, o.o_orderkey DESC) AS rn
  FROM l LEFT JOIN orders o ON o.o_custkey = l.o_custkey AND o.o_orderdate < l.l_shipdate) SELECT l_orderkey, l_linenumber, last_order, o_orderdate FROM j WHERE rn = 1""")
def asof_backward_join(spark: SparkSession, d: str) -> DataFrame:
    """Each item with its customer's last order strictly before the shipping date."""
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    items = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").distinct().join(o.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    right = o.withColumn("last_order", F.col("o_orderkey"))
    return backward_as_of(items, right, ["o_custkey"], "l_shipdate", "o_orderdate", ["last_order"], "o_orderkey").select("l_orderkey", "l_linenumber", "last_order", "o_orderdate")


@query("""SELECT l_orderkey, count(*) AS versions, arg_min(l_quantity, (l_linenumber, l_shipdate, l_partkey, l_quantity)) AS first_value, arg_max(l_quantity, (l_linenumber, l_shipdate, l_partkey, l_quantity)) AS last_value FROM lineitem GROUP BY 1 HAVING count(*) > 1 AND arg_min(l_quantity, (l_linenumber, l_shipdate, l_partkey, l_quantity)) <> arg_max(l_quantity, (l_linenumber, l_shipdate, l_partkey, l_quantity))""")
def revised_points(spark: SparkSession, d: str) -> DataFrame:
    line = F.struct("l_linenumber", "l_shipdate", "l_partkey", "l_quantity")
    out = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("versions"), F.min_by("l_quantity", line).alias("first_value"), F.max_by("l_quantity", line).alias("last_value"))
    return out.filter("versions > 1 and first_value <> last_value")


@query("""SELECT l_orderkey, l_linenumber, l_quantity, lag(l_quantity) OVER w AS previous, round(l_quantity - lag(l_quantity) OVER w, 4) AS revision, row_number() OVER w AS version_no FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_shipdate, l_partkey, l_quantity)""")
def revision_trail(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_shipdate", "l_partkey", "l_quantity")
    before = F.lag("l_quantity").over(w)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", before.alias("previous"), F.round(F.col("l_quantity") - before, 4).alias("revision"), F.row_number().over(w).alias("version_no"))


@query("""WITH p AS (SELECT o_custkey, o_orderkey, o_orderdate, o_orderstatus, o_orderpriority, lag(o_orderstatus) OVER w AS ps, lag(o_orderpriority) OVER w AS pp, row_number() OVER w AS r FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
  c AS (SELECT * FROM p WHERE r = 1 OR o_orderstatus IS DISTINCT FROM ps OR o_orderpriority IS DISTINCT FROM pp)
  SELECT o_custkey, o_orderkey, row_number() OVER v AS version_no, nullif(row_number() OVER v - 1, 0) AS previous_version_no FROM c WINDOW v AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""")
def version_diff(spark: SparkSession, d: str) -> DataFrame:
    """A version for each semantic change; a row that repeats the state before is no version."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority")
    return numbered(o, ["o_custkey"], ["o_orderdate", "o_orderkey"], ["o_orderstatus", "o_orderpriority"]).select("o_custkey", "o_orderkey", "version_no", "previous_version_no")


@query("""WITH o AS (SELECT DISTINCT l_orderkey AS point, CAST(l_shipdate AS DATE) AS vintage, l_quantity AS v FROM lineitem), n AS (SELECT *, row_number() OVER w AS version_no, lag(v) OVER w AS before FROM o WINDOW w AS (PARTITION BY point ORDER BY vintage, v))
  SELECT point, vintage, v, version_no, CASE WHEN version_no = 1 THEN 'release' WHEN v <> before THEN 'revision' END AS delta, CASE WHEN version_no = 1 THEN 'low' WHEN v <> before THEN 'medium' END AS materiality FROM n""")
def macro_apply(spark: SparkSession, d: str) -> DataFrame:
    """Observations without repeats of (point, vintage, value): releases and revisions; a new vintage of the same value is a version but no delta."""
    o = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("point"), F.to_date("l_shipdate").alias("vintage"), F.col("l_quantity").alias("v")).distinct()
    w = Window.partitionBy("point").orderBy("vintage", "v")
    n = o.withColumn("version_no", F.row_number().over(w)).withColumn("before", F.lag("v").over(w))
    first, moved = F.col("version_no") == 1, F.col("v") != F.col("before")
    return n.select("point", "vintage", "v", "version_no", F.when(first, "release").when(moved, "revision").alias("delta"), F.when(first, "low").when(moved, "medium").alias("materiality"))


@query("""SELECT l_orderkey, l_shipdate, max(l_shipdate) OVER (PARTITION BY l_orderkey) AS newest, l_shipdate < max(l_shipdate) OVER (PARTITION BY l_orderkey) AS stale FROM lineitem""")
def stale_pointer(spark: SparkSession, d: str) -> DataFrame:
    newest = F.max("l_shipdate").over(Window.partitionBy("l_orderkey"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_shipdate", newest.alias("newest"), (F.col("l_shipdate") < newest).alias("stale"))


@query("""WITH a AS (SELECT o_custkey, o_orderkey AS k, CAST(o_orderdate AS DATE) AS ex_date, o_orderpriority AS f, CASE WHEN o_orderkey % 3 = 0 THEN 1 ELSE 2 END AS rank, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq FROM orders),
  s AS (SELECT *, max(rank) OVER (PARTITION BY o_custkey ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top, arg_max(f, (rank, seq)) OVER (PARTITION BY o_custkey ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cur FROM a)
  SELECT o_custkey, k, CASE WHEN seq = 1 THEN 'asserted' WHEN f = cur THEN 'corroborated' WHEN rank >= top THEN 'corrected' ELSE 'conflicted' END AS outcome FROM s""")
def action_reconcile(spark: SparkSession, d: str) -> DataFrame:
    """Assertions of one action in order of arrival: asserted, corroborated by an equal fingerprint, corrected by a source ranked as high, else conflicted."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    a = table(spark, d, "orders").withColumn("rank", F.when(F.col("o_orderkey") % 3 == 0, 1).otherwise(2)).withColumn("seq", F.row_number().over(w))
    s = a.withColumns({"top": F.max("rank").over(before), "cur": F.max_by("o_orderpriority", F.struct("rank", "seq")).over(before)})
    out = F.when(F.col("seq") == 1, "asserted").when(F.col("o_orderpriority") == F.col("cur"), "corroborated").when(F.col("rank") >= F.col("top"), "corrected").otherwise("conflicted")
    return s.select("o_custkey", F.col("o_orderkey").alias("k"), out.alias("outcome"))


@query("""SELECT a.l_orderkey, a.l_linenumber AS line, b.l_linenumber AS other, list_filter([CASE WHEN a.l_quantity <> b.l_quantity THEN 'quantity' END, CASE WHEN a.l_discount <> b.l_discount THEN 'discount' END, CASE WHEN a.l_returnflag <> b.l_returnflag THEN 'flag' END], lambda x: x IS NOT NULL) AS differ
  FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber""")
def pairwise_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of assertions of one action with the fields that both give and that differ."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag")
    a, b = li.alias("a"), li.alias("b")
    diff = [F.when(F.col(f"a.{c}") != F.col(f"b.{c}"), n) for c, n in (("l_quantity", "quantity"), ("l_discount", "discount"), ("l_returnflag", "flag"))]
    j = a.join(b, (F.col("a.l_orderkey") == F.col("b.l_orderkey")) & (F.col("a.l_linenumber") < F.col("b.l_linenumber")))
    return j.select("a.l_orderkey", F.col("a.l_linenumber").alias("line"), F.col("b.l_linenumber").alias("other"), F.array_compact(F.array(*diff)).alias("differ"))
