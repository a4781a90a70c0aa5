"""Provider payloads to rows, and sinks.

Each parser takes a DataFrame with a payload column (and any other columns, which it keeps) and gives rows; where a payload
can be an error, parse_result() gives (rows, quarantine) with error_class and detail. All but CSV with quoted
line breaks is from_json, regular expressions and explode, where no Python runs and fields that a query doesn't use are not parsed.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesserae.functions import text
from tesserae.functions.numeric import decimal

BAR = ("open", "high", "low", "close")


def _rest(df: DataFrame, column: str = "payload") -> list[str]:
    return [c for c in df.columns if c != column]


def parse_result(df: DataFrame, error: Column, rows: Callable[[DataFrame], DataFrame], payload: str = "payload") -> tuple[DataFrame, DataFrame]:
    """rows of the payloads without an error, and the others with error_class and the payload's head as detail."""
    marked = df.withColumn("error_class", error)
    bad = marked.filter("error_class is not null").select(*_rest(df, payload), "error_class", F.substring(payload, 1, 200).alias("detail"))
    return rows(marked.filter("error_class is null").drop("error_class")), bad


# -- text formats -------------------------------------------------------------------------------------------------------


def decode_bytes(raw: Column) -> Column:
    """Text of feed bytes: UTF-16 by its byte order mark, or by more than 8 NULs among the first 64 bytes (at odd places little-endian, unless more are at even ones), else UTF-8 without its mark."""
    head = F.hex(F.substring(raw, 1, 64))
    at = F.sequence(F.lit(0), F.greatest(F.length(head) / 2 - 1, F.lit(0)).cast("int"))
    nuls = lambda rest: F.size(F.filter(at, lambda k: (k % 2 == rest) & (F.substr(head, 2 * k + 1, F.lit(2)) == "00")))
    odd, even = nuls(1), nuls(0)
    utf16 = F.when(head.rlike("^(FFFE|FEFF)"), F.decode(raw, "UTF-16")).when((odd > 8) & (odd > even), F.decode(raw, "UTF-16LE")).when(even > 8, F.decode(raw, "UTF-16BE"))
    return utf16.otherwise(F.regexp_replace(F.decode(raw, "UTF-8"), "^\ufeff", ""))


def _element(block: Column, name: str) -> Column:
    """Text of an XML element, CDATA marks taken off; null if it is missing or empty."""
    inner = F.regexp_extract(block, rf"(?s)<{name}(?:\s[^>]*)?>(.*?)</{name}>", 1)
    return F.nullif(text.clean_html(F.regexp_replace(inner, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")), F.lit(""))


def feed_items(df: DataFrame) -> DataFrame:
    """title, url, summary and published of RSS items and Atom entries."""
    blocks = F.regexp_extract_all("payload", F.lit(r"(?s)(<(?:item|entry)[\s>].*?</(?:item|entry)>)"), 1)
    b = F.col("_b")
    link = F.coalesce(_element(b, "link"), F.nullif(F.regexp_extract(b, r"<link[^>]*href=\"([^\"]*)\"", 1), F.lit("")))
    when = F.coalesce(_element(b, "pubDate"), _element(b, "published"), _element(b, "updated"))
    at = F.coalesce(F.try_to_timestamp(when), F.try_to_timestamp(F.regexp_replace(when, "^[A-Za-z]{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(F.regexp_replace(F.regexp_replace(when, "^[A-Za-z]{3}, ", ""), "GMT$", "+0000"), F.lit("d MMM yyyy HH:mm:ss Z")))
    rows = df.withColumn("_b", F.explode(blocks))
    return rows.select(*_rest(df), _element(b, "title").alias("title"), link.alias("url"), F.coalesce(_element(b, "description"), _element(b, "summary")).alias("summary"), at.alias("published"))


def feed_status(code: Column, items: Column, timed_out: Column) -> Column:
    return F.when(timed_out, "timeout").when(code == 429, "rate_limited").when(code.isNull() | (code >= 400), "error").when(items == 0, "empty").otherwise("ok")


def sitemap_items(df: DataFrame) -> DataFrame:
    b = F.col("_b")
    rows = df.withColumn("_b", F.explode(F.regexp_extract_all("payload", F.lit(r"(?s)(<url>.*?</url>)"), 1)))
    return rows.select(*_rest(df), _element(b, "loc").alias("url"), _element(b, "news:title").alias("title"), F.try_to_timestamp(_element(b, "news:publication_date")).alias("published"))


def label_values(df: DataFrame, labels: dict[str, str]) -> DataFrame:
    """One column for each label of a two-column HTML table, and the page's file links."""
    cell = lambda label: F.nullif(text.clean_html(F.regexp_extract("payload", rf"(?s)<t[dh][^>]*>\s*{label}\s*:?\s*</t[dh]>\s*<td[^>]*>(.*?)</td>", 1)), F.lit(""))
    links = F.array_distinct(F.regexp_extract_all("payload", F.lit(r"href=\"([^\"]+\.(?:pdf|docx?|zip))\""), 1))
    return df.select(*_rest(df), *(cell(label).alias(name) for name, label in labels.items()), links.alias("files"))


def articles(items: DataFrame, now: Column, max_age_days: int = 7, skew_minutes: int = 10) -> DataFrame:
    """Valid items with a canonical URL and an id: url, title and date there, not older and not ahead of the clock."""
    ok = text.safe_url(F.col("url")).isNotNull() & F.col("title").isNotNull() & F.col("published").isNotNull()
    ok = ok & (F.col("published") >= now - F.expr(f"INTERVAL {max_age_days} DAYS")) & (F.col("published") <= now + F.expr(f"INTERVAL {skew_minutes} MINUTES"))
    return items.filter(ok).withColumn("url", text.canonical_url(F.col("url"))).withColumn("id", F.substring(F.sha2("url", 256), 1, 20))


def fan_in(*sources: DataFrame) -> DataFrame:
    """All sources' rows, columns by name, missing ones null."""
    out = sources[0]
    for s in sources[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return out


# -- JSON feeds -----------------------------------------------------------------------------------------------------------


def _each(df: DataFrame, schema: str, items: str) -> DataFrame:
    return df.withColumn("_j", F.from_json("payload", schema)).withColumn("_i", F.explode(items))


def hacker_news(df: DataFrame) -> DataFrame:
    j = df.withColumn("_j", F.from_json("payload", "title string, url string, time bigint, score int, by string"))
    return j.select(*_rest(df), "_j.title", "_j.url", F.timestamp_seconds("_j.time").alias("published"), "_j.score")


def gdelt(df: DataFrame) -> DataFrame:
    i = _each(df, "articles array<struct<url string, title string, seendate string, domain string, language string>>", "_j.articles")
    return i.select(*_rest(df), "_i.url", "_i.title", F.try_to_timestamp(F.regexp_replace("_i.seendate", "[TZ]", ""), F.lit("yyyyMMddHHmmss")).alias("published"), F.col("_i.domain").alias("source"), F.lit("gdelt").alias("discovered_via"))


def filings(df: DataFrame, forms: list[str], since: Column, per_issuer: int = 5, issuer: str = "issuer") -> DataFrame:
    """Arrays of columns to rows: wanted forms since a day, the newest few of each issuer."""
    j = df.withColumn("_j", F.from_json("payload", "filings struct<recent struct<accessionNumber array<string>, filingDate array<string>, form array<string>, primaryDocument array<string>>>"))
    i = j.withColumn("_i", F.explode(F.arrays_zip("_j.filings.recent.accessionNumber", "_j.filings.recent.filingDate", "_j.filings.recent.form", "_j.filings.recent.primaryDocument")))
    rows = i.select(*_rest(df), "_i.accessionNumber", F.to_date("_i.filingDate").alias("filed"), "_i.form", "_i.primaryDocument").filter(F.col("form").isin(*forms) & (F.col("filed") >= since))
    rn = F.row_number().over(Window.partitionBy(issuer).orderBy(F.desc("filed"), F.desc("accessionNumber")))
    return rows.withColumn("_rn", rn).filter(F.col("_rn") <= per_issuer).drop("_rn")


# -- market and macro ------------------------------------------------------------------------------------------------------


def alpha_daily(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Daily bars of one series a payload. Errors in the order in which they are told: an error message, a note or information (both tell of limits), no series, a series of another shape, an empty one."""
    schema = "`Time Series (Daily)` map<string, map<string, string>>, Note string, Information string, `Error Message` string"
    j, series = F.from_json("payload", schema), F.get_json_object("payload", "$['Time Series (Daily)']")
    days = F.map_keys(j["Time Series (Daily)"])
    error = F.when(~F.coalesce(F.trim("payload").rlike("^[{]"), F.lit(False)) | j.isNull(), "unexpected_schema").when(j["Error Message"].isNotNull(), "invalid_symbol").when(j["Note"].isNotNull() | j["Information"].isNotNull(), "rate_limit")
    error = error.when(series.isNull(), F.when(F.trim("payload").rlike(r"^[{]\s*[}]$"), "empty").otherwise("unexpected_schema")).when(days.isNull() | F.exists(days, lambda k: ~k.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$")), "unexpected_schema").when(F.size(days) == 0, "empty")

    def rows(good: DataFrame) -> DataFrame:
        e = good.select(*_rest(df), F.explode(F.from_json("payload", schema)["Time Series (Daily)"]).alias("d", "m"))
        v = lambda k: F.col("m")[k]
        return e.select(*_rest(df), F.to_date("d").alias("session_date"), *(decimal(v(f"{n}. {c}")).alias(c) for n, c in enumerate(BAR, 1)), v("5. volume").try_cast("bigint").alias("volume"))

    return parse_result(df, error, rows)


def csv_records(payload: str) -> Column:
    """Records of each CSV text, quotes as in RFC 4180 (line breaks inside them too); empty lines go."""

    def records(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [r for r in csv.reader(io.StringIO(t or "", newline="")) if r])

    return F.pandas_udf(records, "array<array<string>>")(payload)


def tiingo_csv(df: DataFrame) -> DataFrame:
    """Raw and adjusted bars and corporate action hints of one CSV payload with a header, whose names tell the columns."""
    table = df.withColumn("_r", csv_records("payload")).withColumn("_h", F.get("_r", F.lit(0)))
    r = table.select("*", F.explode(F.slice("_r", 2, F.greatest(F.size("_r"), F.lit(1)))).alias("_c"))
    cell = lambda name: F.get("_c", F.array_position("_h", name).cast("int") - 1)
    bars = [decimal(cell(n)).alias(n) for n in BAR]
    adjusted = [decimal(cell(f"adj{n.title()}")).alias(f"adj_{n}") for n in BAR]
    return r.select(*_rest(df), F.to_date(F.substring(cell("date"), 1, 10)).alias("session_date"), *bars, cell("volume").try_cast("bigint").alias("volume"), *adjusted, decimal(cell("divCash")).alias("cash"), decimal(cell("splitFactor")).alias("split_factor"))


def tiingo_eod(df: DataFrame, status: str = "status") -> tuple[DataFrame, DataFrame]:
    """Rows as of tiingo_csv() of responses with an HTTP status, and the others by their class."""
    code, body = F.col(status), F.trim(F.coalesce("payload", F.lit("")))
    error = F.when(code.isin(401, 403), "unauthorized").when(code == 404, "invalid_symbol").when(code == 429, "rate_limit").when(code.isNull() | (code < 200) | (code >= 300), "api_error")
    error = error.when(body == "", "empty").when(body.rlike("^[{\\[]"), "unexpected_schema").when(~body.rlike(r"[\r\n]\s*\S"), "empty")
    error = error.when(~F.split(body, r"[\r\n]")[0].rlike("(^|,)date(,|$)"), "unexpected_schema")
    return parse_result(df, error, tiingo_csv)


def column_arrays(df: DataFrame, scale_places: int = 0) -> DataFrame:
    """{t, o, h, l, c, v} of equal lengths to bars, prices times 10 ** scale_places."""
    j = df.withColumn("_j", F.from_json("payload", "t array<bigint>, o array<decimal(28,8)>, h array<decimal(28,8)>, l array<decimal(28,8)>, c array<decimal(28,8)>, v array<bigint>"))
    i = j.withColumn("_i", F.explode(F.arrays_zip("_j.t", "_j.o", "_j.h", "_j.l", "_j.c", "_j.v")))
    up = F.lit(10**scale_places).cast("decimal(10,0)")
    return i.select(*_rest(df), F.to_date(F.timestamp_seconds("_i.t")).alias("session_date"), *((F.col(f"_i.{k}") * up).cast("decimal(38,8)").alias(n) for k, n in zip("ohlc", BAR, strict=True)), F.col("_i.v").alias("volume"))


def bid_ask_board(df: DataFrame) -> DataFrame:
    """[{date, buy, sell}]: open and low are the bid, high and close the ask; an ask of 0 is the bid."""
    i = _each(df, "data array<struct<date string, buy decimal(28,8), sell decimal(28,8)>>", "_j.data")
    bid, ask = F.col("_i.buy"), F.when(F.coalesce(F.col("_i.sell"), F.lit(0)) == 0, F.col("_i.buy")).otherwise(F.col("_i.sell"))
    return i.select(*_rest(df), F.to_date("_i.date").alias("session_date"), bid.alias("open"), ask.alias("high"), bid.alias("low"), ask.alias("close"))


def klines(df: DataFrame) -> DataFrame:
    """[[open time in ms, open, high, low, close, volume, ...]]."""
    i = df.withColumn("_i", F.explode(F.from_json("payload", "array<array<string>>")))
    v = lambda k: F.col("_i")[k]
    return i.select(*_rest(df), F.to_date(F.timestamp_millis(v(0).cast("bigint"))).alias("session_date"), *(decimal(v(k)).alias(n) for k, n in enumerate(BAR, 1)), decimal(v(5)).alias("volume"))


def single_rate(df: DataFrame, currency: str) -> DataFrame:
    j = df.withColumn("_j", F.from_json("payload", "result string, time_last_update_unix bigint, rates map<string, double>")).filter("_j.result = 'success'")
    return j.select(*_rest(df), F.to_date(F.timestamp_seconds("_j.time_last_update_unix")).alias("session_date"), F.col("_j.rates")[currency].alias("rate"))


def xml_board(df: DataFrame, currency: str) -> DataFrame:
    tag = F.regexp_extract("payload", rf"(<Exrate[^>]*CurrencyCode=\"{currency}\"[^>]*>)", 1)
    number = lambda a: F.regexp_replace(F.regexp_extract(tag, rf"{a}=\"([0-9.,]+)\"", 1), ",", "").try_cast("decimal(28,8)")
    return df.select(*_rest(df), number("Buy").alias("buy"), number("Transfer").alias("transfer"), number("Sell").alias("sell"))


def p2p_median(df: DataFrame, key: str) -> DataFrame:
    """The median of a book's ads."""
    i = _each(df, "data array<struct<adv struct<price double>>>", "_j.data")
    return i.groupBy(key).agg(F.median("_i.adv.price").alias("rate"), F.count("*").alias("ads"))


def dated_rates(df: DataFrame, base: str, quote: str) -> DataFrame:
    j = df.withColumn("_j", F.from_json("payload", f"date string, {base} map<string, double>"))
    return j.select(*_rest(df), F.to_date("_j.date").alias("session_date"), F.col(f"_j.{base}")[quote].alias("rate"))


def fred(df: DataFrame) -> DataFrame:
    i = _each(df, "observations array<struct<date string, realtime_start string, value string>>", "_j.observations").filter("_i.value <> '.'")
    return i.select(*_rest(df), F.to_date("_i.date").alias("obs_date"), F.to_date("_i.realtime_start").alias("vintage_date"), decimal(F.col("_i.value")).alias("value"))


def world_bank(df: DataFrame, vintage: Column) -> DataFrame:
    rows = F.from_json(F.get_json_object("payload", "$[1]"), "array<struct<date string, value string, countryiso3code string>>")
    i = df.withColumn("_i", F.explode(rows)).filter("_i.value is not null")
    return i.select(*_rest(df), F.make_date(F.col("_i.date").cast("int"), F.lit(1), F.lit(1)).alias("obs_date"), vintage.alias("vintage_date"), F.col("_i.countryiso3code").alias("country"), F.col("_i.value").try_cast("double").alias("value"))


def imf(df: DataFrame, vintage: Column) -> DataFrame:
    """{values: {indicator: {country: {year: value}}}}."""
    m = df.select(*_rest(df), F.explode(F.from_json("payload", "values map<string, map<string, map<string, double>>>")["values"]).alias("indicator", "_c"))
    c = m.select(*_rest(df), "indicator", F.explode("_c").alias("country", "_y"))
    y = c.select(*_rest(df), "indicator", "country", F.explode("_y").alias("_year", "value")).filter("value is not null")
    return y.select(*_rest(df), "indicator", "country", F.make_date(F.col("_year").cast("int"), F.lit(1), F.lit(1)).alias("obs_date"), vintage.alias("vintage_date"), "value")


def dividends(df: DataFrame) -> DataFrame:
    i = _each(df, "data array<struct<ex_dividend_date string, declaration_date string, record_date string, payment_date string, amount string>>", "_j.data")
    day = lambda c: F.expr(f"try_to_date(_i.{c}, 'yyyy-MM-dd')")
    return i.select(*_rest(df), F.lit("cash_dividend").alias("action_type"), day("ex_dividend_date").alias("ex_date"), day("declaration_date").alias("declaration_date"), day("record_date").alias("record_date"), day("payment_date").alias("payment_date"), decimal(F.col("_i.amount")).alias("cash_amount")).filter("ex_date is not null")


def splits(df: DataFrame) -> DataFrame:
    i = _each(df, "data array<struct<effective_date string, split_factor string>>", "_j.data")
    return i.select(*_rest(df), F.lit("stock_split").alias("action_type"), F.expr("try_to_date(_i.effective_date, 'yyyy-MM-dd')").alias("ex_date"), decimal(F.col("_i.split_factor")).alias("split_factor")).filter("ex_date is not null")


# -- reference data -----------------------------------------------------------------------------------------------------------


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """RFC 4180: quoted fields may hold commas, quotes (doubled) and line ends."""
    return spark.read.schema(schema).csv(path, header=True, quote='"', escape='"', multiLine=True)


def mic_rows(df: DataFrame) -> DataFrame:
    """Venue rows with yyyyMMdd dates as dates."""
    return df.select("mic", "operating_mic", "name", "status", *(F.expr(f"try_to_date({c}, 'yyyyMMdd')").alias(c) for c in ("created", "modified")))


def field_matrix(df: DataFrame) -> DataFrame:
    """{fields: [...], data: [[...]]} to one map of field to value for each row."""
    i = _each(df, "fields array<string>, data array<array<string>>", "_j.data")
    return i.select(*_rest(df), F.map_from_arrays("_j.fields", "_i").alias("row"))


def figi(df: DataFrame) -> DataFrame:
    j = df.withColumn("_j", F.explode(F.from_json("payload", "array<struct<data array<struct<figi string, compositeFIGI string, name string, ticker string, exchCode string, securityType string>>, warning string>>")))
    return j.withColumn("_i", F.explode("_j.data")).select(*_rest(df), "_i.figi", "_i.compositeFIGI", "_i.name", "_i.ticker", "_i.exchCode", "_i.securityType")


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def media_info(docs: DataFrame, registry: DataFrame) -> DataFrame:
    """docs (name, url) with the registry's owner: by name, else by the longest suffix of the host that the registry has."""
    host = F.regexp_extract("url", r"^https?://(?:www\.)?([^/?#:]+)", 1)
    parts = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    named = docs.join(registry.select(F.col("name").alias("_n"), F.col("owner").alias("by_name")), F.col("name") == F.col("_n"), "left").drop("_n")
    keyed = named.withColumn("_id", F.struct("name", "url")).withColumn("_host", host)
    hits = keyed.select("_id", F.posexplode(suffixes).alias("_p", "_d")).distinct().join(registry.select(F.col("domain").alias("_d"), "owner"), "_d").groupBy("_id").agg(F.min_by("owner", "_p").alias("by_domain"))
    return keyed.join(hits, "_id", "left").select(*docs.columns, F.coalesce("by_name", "by_domain").alias("owner"))


# -- sinks -----------------------------------------------------------------------------------------------------------------------


def observed(new: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """Rows of new to append: one for each key and content hash that is not stored yet. content_hash is of the payload."""
    hashed = new.withColumn("content_hash", F.sha2("payload", 256)).dropDuplicates([*key, "content_hash"])
    return hashed.join(stored.select(*key, "content_hash"), [*key, "content_hash"], "left_anti")


def copy_tables(spark: SparkSession, source: str, target: str, names: list[str]) -> None:
    """Each table to Parquet under target; without foreign keys their order doesn't matter."""
    for n in names:
        spark.read.parquet(f"{source}/{n}.parquet").write.mode("overwrite").parquet(f"{target}/{n}.parquet")


def retained(snapshots: DataFrame, keep: int = 48, key: str = "id") -> DataFrame:
    """The newest snapshots: a top-k, not a window over all."""
    return snapshots.orderBy(F.desc(key)).limit(keep)


def alert_lines(changes: DataFrame, site: str) -> DataFrame:
    """A message for each change, ready for a push sink's foreachBatch."""
    return changes.select("id", F.concat(F.lit("• "), F.col("summary"), F.lit(f"\n{site}/events/"), F.col("id").cast("string")).alias("message"))
