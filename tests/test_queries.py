"""Every query of the reference's operators against its SQL."""

from __future__ import annotations

import pytest

from tesserae.plans.registry import ORACLE_SQL, QUERIES
from tests.oracle import check


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, small, name):
    check(spark, small, QUERIES[name], ORACLE_SQL[name])


def test_every_query_has_rows_or_columns(spark, small):
    for name in set(QUERIES) - set(ORACLE_SQL):
        assert QUERIES[name](spark, small).columns


def test_entry_imports_without_llm():
    import subprocess
    import sys

    code = "import sys; sys.modules['tesserae.llm'] = None; import __spark_entry__ as e; assert 'radar_board' in e.queries() and not any(q.startswith('op') for q in e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=__file__.rsplit("/tests/", 1)[0])


def test_co_occurrence_has_tasks_by_its_lines(spark, small, monkeypatch):
    from tesserae.plans import relational

    monkeypatch.setattr(relational, "TASK_ROWS", 500)
    lines = spark.read.parquet(f"{small}/lineitem.parquet").count()
    assert QUERIES["co_occurrence"](spark, small).rdd.getNumPartitions() == -(-lines // 500) > 4
    check(spark, small, QUERIES["co_occurrence"], ORACLE_SQL["co_occurrence"])
