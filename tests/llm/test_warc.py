from __future__ import annotations

import base64
import gzip
import hashlib

from tesserae.llm import warc
from tests.oracle import check


def brute(rows, least=0):
    out = []
    for key, _, page in rows:
        body = (page or "").encode()
        same = [k for k, _, q in rows if (q or "").encode() == body]
        top = max((k for k in same if k is not None), default=None)
        revisit = len(body) >= least and top is not None and key != top
        out.append((key, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "revisit" if revisit else "response", top if revisit else None))
    return sorted(out, key=repr)


def archive(spark, rows, tmp_path, **how):
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    path = f"{tmp_path}/w"
    warc.write(df, path, "page_id", "url", "html", **how)
    return sorted(((r.key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read(spark, path).collect()), key=repr), path


ROWS = [(1, "u", "a"), (2, "u", "a"), (3, None, "b"), (4, "u", None), (5, "u", ""), (6, "u\r\nX: y", "WARC/1.1\r\nWARC-Type: response\r\n\r\nfoo\r\n\r\n"), (7, "ü", "é日" * 30_000), (7, "ü", "é日" * 30_000), (None, "u", "a"), (8, "u", "a\nb\rc\x00")]


def test_records_by_brute_force(spark, tmp_path):
    got, path = archive(spark, ROWS, tmp_path)
    assert got == brute(ROWS)


def test_min_bytes(spark, tmp_path):
    got, _ = archive(spark, ROWS, tmp_path, min_bytes=2)
    assert got == brute(ROWS, 2)


def test_empty_table(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write(df, f"{tmp_path}/e", "page_id", "url", "html")
    assert warc.read(spark, f"{tmp_path}/e").count() == 0


def test_parse_of_members_and_sizes():
    rec = lambda n: b"WARC/1.1\r\nContent-Length: %d\r\n\r\n" % n + b"x" * n + b"\r\n\r\n"
    data = gzip.compress(rec(3) + rec(0)) + gzip.compress(rec(2_000_000))
    assert [len(c) for _, c in warc.parse(data)] == [3, 0, 2_000_000]


def test_against_sql(spark, small):
    check(spark, small, warc.op2_warc, warc.OP2_SQL)
