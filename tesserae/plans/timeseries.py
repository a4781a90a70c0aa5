"""Daily series: board, moves, spikes, outcomes, as-of alignment, merges of legs.

Bars are a map-side combined aggregate over the events; everything after it works on one row for a series and day, in
windows over the series. No window runs over raw events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from tesserae.plans.relational import first_reason
from tesserae.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

BARS_SQL = """bars AS (SELECT event_type AS series, CAST(ts AS DATE) AS day, arg_min(value, (ts, event_id)) AS open, max(value) AS high,
  min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS volume FROM events GROUP BY 1, 2)"""


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def daily_bars(events: DataFrame) -> DataFrame:
    """Open, high, low, close and volume for each (series, day)."""
    order = F.struct("ts", "event_id")
    return events.groupBy(F.col("event_type").alias("series"), F.to_date("ts").alias("day")).agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"),
        F.max_by("value", order).alias("close"), F.count("*").alias("volume"))


def _bars(spark: SparkSession, d: str) -> DataFrame:
    return daily_bars(table(spark, d, "events"))


def by_day(series: str = "series", day: str = "day") -> WindowSpec:
    return Window.partitionBy(series).orderBy(F.col(day))


def percent_move(before: Column, now: Column) -> Column:
    """(now - before) / |before| * 100; null without a usable base."""
    return F.when(before != 0, (now - before) / F.abs(before) * 100)


@query(f"""WITH {BARS_SQL}, w AS (SELECT *, lag(close) OVER (PARTITION BY series ORDER BY day) AS prev_close, row_number() OVER (PARTITION BY series ORDER BY day DESC) AS rn FROM bars)
  SELECT series, day, open, high, low, close, volume, prev_close, CASE WHEN prev_close <> 0 THEN round((close - prev_close) / abs(prev_close) * 100, 4) END AS pct_change FROM w WHERE rn = 1""")
def radar_board(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest session, previous close and % change for each series."""
    bars = _bars(spark, sf_dir).withColumn("prev_close", F.lag("close").over(by_day()))
    latest = Window.partitionBy("series").orderBy(F.col("day").desc())
    board = bars.withColumn("_rn", F.row_number().over(latest)).filter("_rn = 1")
    return board.select("series", "day", "open", "high", "low", "close", "volume", "prev_close", F.round(percent_move(F.col("prev_close"), F.col("close")), 4).alias("pct_change"))


@query("""WITH b AS (SELECT event_id, value AS low, value * (1 + (event_id % 7 - 1) * 0.1) AS high, value * (1 + (event_id % 5 - 2) * 0.05) AS open, value AS close, CASE WHEN event_id % 9 = 0 THEN -1 WHEN event_id % 13 = 0 THEN NULL ELSE event_id % 100 END AS volume FROM events)
  SELECT event_id, CASE WHEN open <= 0 THEN 'nonpositive_open' WHEN volume < 0 THEN 'negative_volume' WHEN low > high THEN 'low_gt_high' WHEN open < low OR open > high THEN 'open_outside_range' WHEN close < low OR close > high THEN 'close_outside_range' END AS reason FROM b""")
def validate_bars(spark: SparkSession, d: str) -> DataFrame:
    """The bar envelope with its reasons in their fixed order; a null volume is unknown and allowed."""
    i, v = F.col("event_id"), F.col("value")
    b = table(spark, d, "events").select("event_id", v.alias("low"), (v * (1 + (i % 7 - 1) * 0.1)).alias("high"), (v * (1 + (i % 5 - 2) * 0.05)).alias("open"), v.alias("close"),
                                         F.when(i % 9 == 0, -1).when(i % 13 == 0, F.lit(None)).otherwise(i % 100).alias("volume"))
    o, h, lo, c = (F.col(x) for x in ("open", "high", "low", "close"))
    reason = first_reason(("nonpositive_open", o <= 0), ("negative_volume", F.col("volume") < 0), ("low_gt_high", lo > h), ("open_outside_range", (o < lo) | (o > h)), ("close_outside_range", (c < lo) | (c > h)))
    return b.select("event_id", reason.alias("reason"))


def moves(bars: DataFrame, material: float = 5.0, high: float = 10.0) -> DataFrame:
    """Sessions whose close moved by material % or more against the session before."""
    pct = F.round(percent_move(F.lag("close").over(by_day()), F.col("close")), 6)
    return bars.withColumn("pct", pct).filter(F.abs("pct") >= material).withColumn("materiality", F.when(F.abs("pct") >= high, "high").otherwise("medium"))


_MOVES_SQL = f"""{BARS_SQL}, p AS (SELECT *, lag(close) OVER (PARTITION BY series ORDER BY day) AS prev FROM bars), m AS (SELECT series, day, close, volume, round(CASE WHEN prev <> 0 THEN (close - prev) / abs(prev) * 100 END, 6) AS pct FROM p)"""


@query(f"WITH {_MOVES_SQL} SELECT series, day, pct, CASE WHEN abs(pct) >= 10 THEN 'high' ELSE 'medium' END AS materiality FROM m WHERE abs(pct) >= 5")
def market_move(spark: SparkSession, d: str) -> DataFrame:
    return moves(_bars(spark, d)).select("series", "day", "pct", "materiality")


def spikes(bars: DataFrame, multiple: float = 1.1, lookback: int = 20) -> DataFrame:
    """Sessions of multiple times the median volume of the lookback sessions before (those of volume 0 out) or more; twice that is high."""
    base = F.expr(f"percentile(case when volume > 0 then volume end, 0.5) over (partition by series order by day rows between {lookback} preceding and 1 preceding)")
    ratio = F.round(F.col("volume") / F.col("base"), 6)
    return bars.withColumn("base", base).withColumn("ratio", ratio).filter(F.col("ratio") >= multiple).withColumn("materiality", F.when(F.col("ratio") >= 2 * multiple, "high").otherwise("medium"))


@query(f"""WITH {BARS_SQL}, s AS (SELECT *, median(CASE WHEN volume > 0 THEN volume END) OVER (PARTITION BY series ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS base FROM bars)
  SELECT series, day, volume, CAST(base AS DOUBLE) AS base, round(volume / base, 6) AS ratio, CASE WHEN round(volume / base, 6) >= 2.2 THEN 'high' ELSE 'medium' END AS materiality FROM s WHERE round(volume / base, 6) >= 1.1""")
def volume_spike(spark: SparkSession, d: str) -> DataFrame:
    return spikes(_bars(spark, d)).select("series", "day", "volume", "base", "ratio", "materiality")


@query(f"""WITH {BARS_SQL}, s AS (SELECT *, lag(close) OVER (PARTITION BY series ORDER BY day) AS prev, row_number() OVER (PARTITION BY series ORDER BY day DESC) AS rn FROM bars)
  SELECT series, day, round(close - prev, 6) AS shift, CASE WHEN round(abs(close - prev), 6) >= 1.5 THEN 'high' ELSE 'medium' END AS materiality FROM s WHERE rn = 1 AND round(abs(close - prev), 6) >= 0.75""")
def premium_shift(spark: SparkSession, d: str) -> DataFrame:
    """The two latest sessions, compared in points."""
    b = _bars(spark, d).withColumn("prev", F.lag("close").over(by_day())).withColumn("rn", F.row_number().over(Window.partitionBy("series").orderBy(F.desc("day")))).filter("rn = 1")
    b = b.withColumn("shift", F.round(F.col("close") - F.col("prev"), 6)).filter(F.abs("shift") >= 0.75)
    return b.select("series", "day", "shift", F.when(F.abs("shift") >= 1.5, "high").otherwise("medium").alias("materiality"))


HORIZONS = (1, 5, 20)


def outcomes(bars: DataFrame, as_of: Column, horizons: tuple[int, ...] = HORIZONS, expire_days: int = 60) -> DataFrame:
    """For each move and horizon, the close that many sessions later; pending without one, expired once old."""
    w = by_day()
    wide = bars.withColumns({f"out_{h}": F.lead("close", h).over(w) for h in horizons} | {"pct": F.round(percent_move(F.lag("close").over(w), F.col("close")), 6)}).filter(F.abs("pct") >= 5)
    each = F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"out_{h}").alias("outcome")) for h in horizons)))
    rows = wide.select("series", "day", "pct", "close", each.alias("o")).select("series", "day", "pct", "close", "o.horizon", "o.outcome")
    status = F.when(F.col("outcome").isNotNull(), "resolved").when(F.datediff(as_of, "day") > expire_days, "expired").otherwise("pending")
    return rows.withColumn("status", status).withColumn("move", F.round(percent_move(F.col("close"), F.col("outcome")), 6))


_OUTCOMES_SQL = f"""{_MOVES_SQL}, l AS (SELECT *, lead(close, 1) OVER w AS o1, lead(close, 5) OVER w AS o5, lead(close, 20) OVER w AS o20 FROM m WINDOW w AS (PARTITION BY series ORDER BY day)),
  u AS (SELECT series, day, pct, close, 1 AS horizon, o1 AS outcome FROM l UNION ALL SELECT series, day, pct, close, 5, o5 FROM l UNION ALL SELECT series, day, pct, close, 20, o20 FROM l),
  o AS (SELECT series, day, pct, horizon, outcome, CASE WHEN outcome IS NOT NULL THEN 'resolved' WHEN date_diff('day', day, DATE '2024-03-15') > 60 THEN 'expired' ELSE 'pending' END AS status,
  round(CASE WHEN close <> 0 THEN (outcome - close) / abs(close) * 100 END, 6) AS move FROM u WHERE abs(pct) >= 5)"""


@query(f"WITH {_OUTCOMES_SQL} SELECT series, day, horizon, outcome, status, move FROM o")
def signal_outcomes(spark: SparkSession, d: str) -> DataFrame:
    return outcomes(_bars(spark, d), F.lit("2024-03-15").cast("date")).select("series", "day", "horizon", "outcome", "status", "move")


@query(f"WITH {_OUTCOMES_SQL} SELECT horizon, status, count(*) AS n, count(*) FILTER (sign(move) = sign(pct)) AS agree, round(avg(move), 4) AS mean_move FROM o GROUP BY 1, 2")
def outcome_scorecard(spark: SparkSession, d: str) -> DataFrame:
    o = outcomes(_bars(spark, d), F.lit("2024-03-15").cast("date"))
    return o.groupBy("horizon", "status").agg(F.count("*").alias("n"), F.count_if(F.signum("move") == F.signum("pct")).alias("agree"), F.round(F.avg("move"), 4).alias("mean_move"))


@query(f"""WITH {BARS_SQL}, c AS (SELECT *, close - lag(close) OVER (PARTITION BY series ORDER BY day) AS chg FROM bars), z AS (SELECT *, count(chg) OVER w AS n, avg(chg) OVER w AS mean, stddev_samp(chg) OVER w AS sd FROM c
  WINDOW w AS (PARTITION BY series ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT series, day, n, round(CASE WHEN n >= 8 AND sd <> 0 THEN abs(chg - mean) / sd END, 4) AS z FROM z""")
def zscore_change_space(spark: SparkSession, d: str) -> DataFrame:
    """|z| of a change against the changes before it (centred, sample deviation), from eight on."""
    w = by_day()
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    c = _bars(spark, d).withColumn("chg", F.col("close") - F.lag("close").over(w))
    z = c.withColumns({"n": F.count("chg").over(before), "mean": F.avg("chg").over(before), "sd": F.stddev_samp("chg").over(before)})
    return z.select("series", "day", "n", F.round(F.when((F.col("n") >= 8) & (F.col("sd") != 0), F.abs(F.col("chg") - F.col("mean")) / F.col("sd")), 4).alias("z"))


@query(f"""WITH {_MOVES_SQL}, z AS (SELECT *, count(pct) OVER w AS n, stddev_samp(pct) OVER w AS sd FROM m WINDOW w AS (PARTITION BY series ORDER BY day ROWS BETWEEN 58 PRECEDING AND 1 PRECEDING))
  SELECT series, day, round(CASE WHEN n >= 8 AND sd > 0 THEN pct / sd END, 4) AS z, CASE WHEN n < 8 OR NOT sd > 0 OR pct IS NULL THEN CASE WHEN abs(pct) >= 4 THEN 'limited' ELSE 'none' END WHEN abs(pct / sd) >= 4 THEN 'meaningful'
  WHEN abs(pct / sd) >= 2.5 AND series <> 'purchase' THEN 'meaningful' ELSE 'limited' END AS materiality FROM z""")
def market_materiality(spark: SparkSession, d: str) -> DataFrame:
    """Return over trailing volatility (not centred), out of sample; without volatility only large moves count a little."""
    w = by_day()
    m = _bars(spark, d).withColumn("pct", F.round(percent_move(F.lag("close").over(w), F.col("close")), 6))
    before = w.rowsBetween(-58, -1)
    z = m.withColumns({"n": F.count("pct").over(before), "sd": F.stddev_samp("pct").over(before)})
    raw = F.col("pct") / F.col("sd")
    blind = (F.col("n") < 8) | ~(F.col("sd") > 0) | F.col("pct").isNull()
    level = F.when(blind, F.when(F.abs("pct") >= 4, "limited").otherwise("none")).when(F.abs(raw) >= 4, "meaningful").when((F.abs(raw) >= 2.5) & (F.col("series") != "purchase"), "meaningful").otherwise("limited")
    return z.select("series", "day", F.round(F.when((F.col("n") >= 8) & (F.col("sd") > 0), raw), 4).alias("z"), level.alias("materiality"))


@query("""WITH a AS (SELECT user_id, CAST(ts AS DATE) AS day, max(value) AS v FROM events WHERE event_type = 'view' GROUP BY 1, 2), b AS (SELECT user_id, CAST(ts AS DATE) AS day, max(value) AS v FROM events WHERE event_type = 'click' GROUP BY 1, 2)
  SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.day, b.day) AS day, CASE WHEN a.v IS NULL THEN 'only_b' WHEN b.v IS NULL THEN 'only_a' WHEN a.v = b.v THEN 'exact' ELSE 'divergent' END AS state, round(a.v - b.v, 6) AS diff FROM a FULL JOIN b ON a.user_id = b.user_id AND a.day = b.day""")
def dual_provider_compare(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    side = lambda kind, v: e.filter(F.col("event_type") == kind).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max("value").alias(v))
    j = side("view", "a").join(side("click", "b"), ["user_id", "day"], "full_outer")
    state = F.when(F.col("a").isNull(), "only_b").when(F.col("b").isNull(), "only_a").when(F.col("a") == F.col("b"), "exact").otherwise("divergent")
    return j.select("user_id", "day", state.alias("state"), F.round(F.col("a") - F.col("b"), 6).alias("diff"))


@query(f"""WITH {BARS_SQL}, g AS (SELECT day, close AS gold FROM bars WHERE series = 'purchase'), w AS (SELECT day, close AS world FROM bars WHERE series = 'view'), f AS (SELECT day, close AS fx FROM bars WHERE series = 'click')
  SELECT day, round((gold / (world * fx) - 1) * 100, 4) AS premium_pct, round((gold / world - 1) * 100, 4) AS gap_pct, round(gold / world * 100, 4) AS index100 FROM g JOIN w USING (day) JOIN f USING (day)""")
def derived_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Premium, gap and index of legs aligned by day, all legs present."""
    bars = _bars(spark, d)
    leg = lambda s, n: bars.filter(F.col("series") == s).select("day", F.col("close").alias(n))
    j = leg("purchase", "gold").join(leg("view", "world"), "day").join(leg("click", "fx"), "day")
    g, w, x = F.col("gold"), F.col("world"), F.col("fx")
    return j.select("day", F.round((g / (w * x) - 1) * 100, 4).alias("premium_pct"), F.round((g / w - 1) * 100, 4).alias("gap_pct"), F.round(g / w * 100, 4).alias("index100"))


@query(f"""WITH {BARS_SQL}, c AS (SELECT day, close, series, CASE series WHEN 'signup' THEN 1 WHEN 'error' THEN 2 ELSE 3 END AS pref FROM bars WHERE series IN ('signup', 'error', 'view') AND NOT (series = 'signup' AND day(day) % 3 = 0))
  SELECT day, arg_min(close, pref) AS close, arg_min(series, pref) AS source FROM c GROUP BY 1""")
def leg_preference(spark: SparkSession, d: str) -> DataFrame:
    """The first source that has the day wins."""
    pref = F.when(F.col("series") == "signup", 1).when(F.col("series") == "error", 2).otherwise(3)
    c = _bars(spark, d).filter("series in ('signup', 'error', 'view') and not (series = 'signup' and day(day) % 3 = 0)").withColumn("pref", pref)
    return c.groupBy("day").agg(F.min_by("close", "pref").alias("close"), F.min_by("series", "pref").alias("source"))


@query("""WITH o AS (SELECT user_id, ts, event_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS failed FROM events)
  SELECT user_id, max(ts) FILTER (failed = 0) AS watermark, count(*) FILTER (failed = 0) AS done FROM o GROUP BY 1""")
def watermark_prefix(spark: SparkSession, d: str) -> DataFrame:
    """How far each queue got before its first failure: by the first failure's place, without a running sum over all rows."""
    e = table(spark, d, "events").select("user_id", F.struct("ts", "event_id").alias("at"), "event_type")
    first = e.filter("event_type = 'error'").groupBy("user_id").agg(F.min("at").alias("stop"))
    done = e.join(first, "user_id", "left")
    ok = F.col("stop").isNull() | (F.col("at") < F.col("stop"))
    return done.groupBy("user_id").agg(F.max(F.when(ok, F.col("at.ts"))).alias("watermark"), F.count_if(ok).alias("done"))


@query("""WITH a AS (SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-14' GROUP BY 1), b AS (SELECT user_id, count(*) AS n, count(DISTINCT event_type) AS kinds FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-15' GROUP BY 1)
  SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN a.user_id IS NULL THEN 'emerging' WHEN b.user_id IS NULL THEN 'cooling' WHEN b.n - a.n >= 2 OR b.kinds - a.kinds >= 1 THEN 'accelerating' ELSE 'steady' END AS momentum FROM a FULL JOIN b ON a.user_id = b.user_id""")
def momentum(spark: SparkSession, d: str) -> DataFrame:
    """One snapshot against the one before; a single scan makes both."""
    day = F.to_date("ts")
    e = table(spark, d, "events").filter((day >= F.lit("2024-01-14").cast("date")) & (day <= F.lit("2024-01-15").cast("date")))
    old, new = day == F.lit("2024-01-14").cast("date"), day == F.lit("2024-01-15").cast("date")
    n = lambda when: F.count_if(when)
    kinds = lambda when: F.countDistinct(F.when(when, F.col("event_type")))
    s = e.groupBy("user_id").agg(n(old).alias("a"), n(new).alias("b"), kinds(old).alias("ka"), kinds(new).alias("kb"))
    state = F.when(F.col("a") == 0, "emerging").when(F.col("b") == 0, "cooling").when((F.col("b") - F.col("a") >= 2) | (F.col("kb") - F.col("ka") >= 1), "accelerating").otherwise("steady")
    return s.select("user_id", state.alias("momentum"))


@query("""WITH c AS (SELECT conv_id, turn, role, text, CAST(TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (turn * 5) + INTERVAL 7 HOUR AS DATE) AS day FROM conversations),
  k AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn) AS rn FROM c) SELECT conv_id, day, count(*) AS items, list(turn ORDER BY turn) AS turns FROM k WHERE rn = 1 GROUP BY 1, 2""")
def story_arc(spark: SparkSession, d: str) -> DataFrame:
    """Without repeats, by local day, oldest first."""
    rn = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("turn"))
    at = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(turn * 5 + 7 as int), 0, 0)")
    k = table(spark, d, "conversations").withColumn("rn", rn).filter("rn = 1")
    return k.groupBy("conv_id", F.to_date(at).alias("day")).agg(F.count("*").alias("items"), F.sort_array(F.collect_list("turn")).alias("turns"))


@query(f"""WITH {BARS_SQL}, w AS (SELECT *, lag(close) OVER (PARTITION BY series ORDER BY day) AS prev FROM bars) SELECT series, day, CASE WHEN series IN ('view', 'click') THEN round((close - prev) * 100, 4) WHEN prev <> 0 THEN round((close - prev) / abs(prev) * 100, 4) END AS delta,
  CASE WHEN series IN ('view', 'click') THEN 'bp' ELSE 'pct' END AS unit FROM w""")
def display_delta(spark: SparkSession, d: str) -> DataFrame:
    """Basis points for rates, % for the rest."""
    rate = F.col("series").isin("view", "click")
    b = _bars(spark, d).withColumn("prev", F.lag("close").over(by_day()))
    delta = F.when(rate, F.round((F.col("close") - F.col("prev")) * 100, 4)).otherwise(F.round(percent_move(F.col("prev"), F.col("close")), 4))
    return b.select("series", "day", delta.alias("delta"), F.when(rate, "bp").otherwise("pct").alias("unit"))


@query(f"""WITH {BARS_SQL}, l AS (SELECT series, arg_max(close, day) AS close FROM bars GROUP BY 1) SELECT g.close AS gold, w.close AS world, f.close AS fx, round((g.close / (w.close * f.close) - 1) * 100, 4) AS premium_pct
  FROM l g, l w, l f WHERE g.series = 'purchase' AND w.series = 'view' AND f.series = 'click'""")
def premium_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The three latest legs in one row, by one aggregate."""
    last = lambda s: F.max_by(F.when(F.col("series") == s, F.col("close")), F.when(F.col("series") == s, F.col("day")))
    one = _bars(spark, d).agg(last("purchase").alias("gold"), last("view").alias("world"), last("click").alias("fx"))
    return one.withColumn("premium_pct", F.round((F.col("gold") / (F.col("world") * F.col("fx")) - 1) * 100, 4))
