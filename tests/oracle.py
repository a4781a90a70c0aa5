"""Rows of a query and of its SQL in DuckDB, in one comparable form."""

from __future__ import annotations

import datetime
import decimal
import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    if isinstance(v, decimal.Decimal):
        return repr(round(float(v), 9))
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, dict):
        return [plain(x) for x in v.values()]
    if isinstance(v, datetime.datetime):
        return v.isoformat(sep=" ")
    return str(v)


def rows_of(names: list[str], rows) -> list[str]:
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr([plain(r[i]) for i in order]) for r in rows)


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def check(spark, sf_dir: str, query, sql: str) -> None:
    df = query(spark, sf_dir)
    found = con_rows = None
    con = duck(sf_dir)
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    con_rows = result.fetchall()
    assert sorted(df.columns) == sorted(names)
    found = rows_of(df.columns, df.collect())
    assert found == rows_of(names, con_rows)
