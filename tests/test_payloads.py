"""Parsers on hand-made payloads."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import functions as F

from tesserae.functions.fixed import ERROR_CLASSES
from tesserae.sources import payloads as p


def frame(spark, *payloads, **keys):
    return spark.createDataFrame([(x, *keys.values()) for x in payloads], ["payload", *keys])


def test_rss_and_atom(spark):
    rss = '<rss><item><title><![CDATA[A &amp; B]]></title><link>https://x.org/a?utm_source=y</link><pubDate>Mon, 01 Jan 2024 10:00:00 GMT</pubDate></item><item><title>C</title></item></rss>'
    rows = p.feed_items(frame(spark, rss, feed="f")).collect()
    assert [(r.title, r.url) for r in rows] == [("A & B", "https://x.org/a?utm_source=y"), ("C", None)]
    got = p.articles(p.feed_items(frame(spark, rss, feed="f")), F.lit("2024-01-02").cast("timestamp")).collect()
    assert [r.url for r in got] == ["https://x.org/a"] and len(got[0].id) == 20


def test_sitemap(spark):
    xml = "<urlset><url><loc>https://x.org/1</loc><news:title>T</news:title><news:publication_date>2024-01-01T00:00:00Z</news:publication_date></url></urlset>"
    (r,) = p.sitemap_items(frame(spark, xml)).collect()
    assert (r.url, r.title, r.published) == ("https://x.org/1", "T", dt.datetime(2024, 1, 1))


def test_label_values(spark):
    page = '<table><tr><td>Number:</td><td><b>12/ND</b></td></tr></table><a href="a.pdf">x</a>'
    (r,) = p.label_values(frame(spark, page), {"number": "Number", "signer": "Signer"}).collect()
    assert (r.number, r.signer, r.files) == ("12/ND", None, ["a.pdf"])


def test_decode_bytes(spark):
    rows = [("xin chào".encode(),), (b"\xff\xfe" + "ab".encode("utf-16-le"),), (("ab" * 5).encode("utf-16-le"),), (b"\xef\xbb\xbfab",)]
    got = spark.createDataFrame(rows, "raw binary").select(p.decode_bytes(F.col("raw")).alias("t")).collect()
    assert [r.t for r in got] == ["xin chào", "ab", "ab" * 5, "ab"]


def test_alpha_daily_splits_errors(spark):
    ok = '{"Time Series (Daily)": {"2024-01-02": {"1. open": "1.10", "2. high": "2", "3. low": "1e3", "4. close": "1.5", "5. volume": "7"}}}'
    good, bad = p.alpha_daily(frame(spark, ok, '{"Note": "slow down"}', '{"Error Message": "no"}', "{"))
    (r,) = good.collect()
    assert (r.session_date, r.open, r.low, r.volume) == (dt.date(2024, 1, 2), Decimal("1.10"), None, 7)
    assert sorted(x.error_class for x in bad.collect()) == ["invalid_symbol", "rate_limit", "unexpected_schema"]


def test_alpha_error_classes(spark):
    day = '{"1. open":"1","2. high":"2","3. low":"1","4. close":"2","5. volume":"3"}'
    cases = {'{"Information": "x"}': "rate_limit", "{}": "empty", '{"Meta": 1}': "unexpected_schema", "[]": "unexpected_schema", "null": "unexpected_schema", '{"Time Series (Daily)": 5}': "unexpected_schema", '{"Time Series (Daily)": {}}': "empty", '{"Time Series (Daily)": {"x": %s}}' % day: "unexpected_schema"}
    good, bad = p.alpha_daily(frame(spark, *cases, '{"Time Series (Daily)": {"2024-01-02": %s}}' % day))
    assert {r.detail: r.error_class for r in bad.collect()} == cases and good.count() == 1 and set(cases.values()) <= set(ERROR_CLASSES)


def test_tiingo_eod_classes_and_quotes(spark):
    ok = 'date,close,high,low,open,volume,note\n2024-01-02,2,3,1,1,9,"a, ""b""\nc"\r\n2024-01-03,2,3,1,1,9,x\n'
    rows = [(200, ok), (401, "x"), (403, "x"), (404, "x"), (429, "x"), (500, "x"), (None, "x"), (200, " "), (200, '{"a":1}'), (200, "date,close\n"), (200, "<html>\nx")]
    good, bad = p.tiingo_eod(spark.createDataFrame(rows, "status int, payload string"))
    assert [str(r.session_date) for r in good.orderBy("session_date").collect()] == ["2024-01-02", "2024-01-03"]
    assert sorted(r.error_class for r in bad.collect()) == sorted(["unauthorized", "unauthorized", "invalid_symbol", "rate_limit", "api_error", "api_error", "empty", "unexpected_schema", "empty", "unexpected_schema"])


def test_utf16_without_a_mark(spark):
    rows = [("ngân hàng lớn nhất và".encode("utf-16-le"),), ("ngân hàng lớn nhất và".encode("utf-16-be"),), ("\u4e00 plain letters after".encode("utf-16-le"),), ("\u4e00 utf-8 text".encode(),)]
    got = [r.t for r in spark.createDataFrame(rows, "raw binary").select(p.decode_bytes(F.col("raw")).alias("t")).collect()]
    assert got == ["ngân hàng lớn nhất và"] * 2 + ["\u4e00 plain letters after", "\u4e00 utf-8 text"]


def test_tiingo_csv(spark):
    text = "date,close,high,low,open,volume,adjClose,adjHigh,adjLow,adjOpen,adjVolume,divCash,splitFactor\r\n2024-01-02,2,3,1,1.5,10,1,1.5,0.5,0.75,20,0.1,2.0\r\n"
    (r,) = p.tiingo_csv(frame(spark, text)).collect()
    assert (r.close, r.adj_open, r.cash, r.split_factor) == (Decimal(2), Decimal("0.75"), Decimal("0.1"), Decimal(2))


def test_market_boards(spark):
    (r,) = p.column_arrays(frame(spark, '{"t":[1704153600],"o":[1.5],"h":[2],"l":[1],"c":[1.7],"v":[5]}'), 3).collect()
    assert (r.session_date, r.open, r.volume) == (dt.date(2024, 1, 2), Decimal(1500), 5)
    (r,) = p.bid_ask_board(frame(spark, '{"data":[{"date":"2024-01-02","buy":10,"sell":0}]}')).collect()
    assert (r.open, r.high) == (Decimal(10), Decimal(10))
    (r,) = p.klines(frame(spark, '[[1704153600000,"1","2","0.5","1.5","9"]]')).collect()
    assert (r.session_date, r.low) == (dt.date(2024, 1, 2), Decimal("0.5"))
    (r,) = p.single_rate(frame(spark, '{"result":"success","time_last_update_unix":1704153600,"rates":{"VND":24000}}', '{"result":"error"}'), "VND").collect()
    assert r.rate == 24000
    (r,) = p.xml_board(frame(spark, '<ExrateList><Exrate CurrencyCode="USD" Buy="24,100.5" Transfer="24,130" Sell="24,400"/></ExrateList>'), "USD").collect()
    assert (r.buy, r.sell) == (Decimal("24100.5"), Decimal(24400))
    (r,) = p.p2p_median(frame(spark, '{"data":[{"adv":{"price":1}},{"adv":{"price":2}},{"adv":{"price":9}}]}', book="b"), "book").collect()
    assert (r.rate, r.ads) == (2, 3)
    (r,) = p.dated_rates(frame(spark, '{"date":"2024-01-02","usd":{"vnd":24000.5}}'), "usd", "vnd").collect()
    assert r.rate == 24000.5


def test_macro(spark):
    (r,) = p.fred(frame(spark, '{"observations":[{"date":"2024-01-01","realtime_start":"2024-02-01","value":"."},{"date":"2024-02-01","realtime_start":"2024-03-01","value":"3.1"}]}')).collect()
    assert (r.obs_date, r.value) == (dt.date(2024, 2, 1), Decimal("3.1"))
    v = F.lit("2024-05-05").cast("date")
    (r,) = p.world_bank(frame(spark, '[{"page":1},[{"date":"2020","value":2.5,"countryiso3code":"VNM"},{"date":"2021","value":null,"countryiso3code":"VNM"}]]'), v).collect()
    assert (r.obs_date, r.country, r.value) == (dt.date(2020, 1, 1), "VNM", 2.5)
    (r,) = p.imf(frame(spark, '{"values":{"X":{"VNM":{"2020":1.5,"2021":null}}}}'), v).collect()
    assert (r.indicator, r.country, r.obs_date, r.value) == ("X", "VNM", dt.date(2020, 1, 1), 1.5)


def test_actions_and_reference(spark):
    (r,) = p.dividends(frame(spark, '{"data":[{"ex_dividend_date":"2024-01-02","amount":"0.24","payment_date":"None"},{"ex_dividend_date":"None","amount":"1"}]}')).collect()
    assert (r.ex_date, r.payment_date, r.cash_amount) == (dt.date(2024, 1, 2), None, Decimal("0.24"))
    (r,) = p.splits(frame(spark, '{"data":[{"effective_date":"2024-01-02","split_factor":"4.0"}]}')).collect()
    assert r.split_factor == 4
    rows = p.field_matrix(frame(spark, '{"fields":["cik","ticker"],"data":[["1","A"],["2","B"]]}')).collect()
    assert [x.row["ticker"] for x in rows] == ["A", "B"]
    (r,) = p.figi(frame(spark, '[{"data":[{"figi":"F","ticker":"A"}]},{"warning":"none"}]')).collect()
    assert r.figi == "F"
    doc = '{"filings":{"recent":{"accessionNumber":["a","b","c"],"filingDate":["2024-01-03","2024-01-02","2024-01-01"],"form":["8-K","4","10-K"],"primaryDocument":["x","y","z"]}}}'
    rows = p.filings(frame(spark, doc, issuer="i"), ["8-K", "10-K"], F.lit("2023-12-30").cast("date"), per_issuer=1).collect()
    assert [x.accessionNumber for x in rows] == ["a"]


def test_media_info_takes_name_then_longest_domain(spark):
    reg = spark.createDataFrame([("N", "x.org", "by name"), ("M", "y.com", "y"), ("K", "news.y.com", "news y")], "name string, domain string, owner string")
    docs = spark.createDataFrame([("N", "https://y.com/1"), ("?", "https://www.news.y.com/2"), ("?", "https://a.y.com/3"), ("?", "https://z.net/")], "name string, url string")
    got = {r.url: r.owner for r in p.media_info(docs, reg).collect()}
    assert got == {"https://y.com/1": "by name", "https://www.news.y.com/2": "news y", "https://a.y.com/3": "y", "https://z.net/": None}


def test_observed_appends_only_new(spark):
    new = spark.createDataFrame([("a", "1"), ("a", "1"), ("a", "2"), ("b", "3")], "record_key string, payload string")
    first = p.observed(new, spark.createDataFrame([], "record_key string, content_hash string"), ["record_key"])
    assert first.count() == 3
    assert p.observed(new, first, ["record_key"]).count() == 0


def test_csv_rfc4180(spark, tmp_path):
    f = tmp_path / "a.csv"
    f.write_text('mic,name\r\nXA,"a ""q"", b\nc"\r\n')
    (r,) = p.csv_table(spark, str(f), "mic string, name string").collect()
    assert r.name == 'a "q", b\nc'
