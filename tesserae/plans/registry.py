"""All queries over the reference's operators, with their SQL."""

from __future__ import annotations

from tesserae.plans import claims, decisions, evidence, history, relational, texts, timeseries
from tesserae.streaming import jobs

_MODULES = [timeseries, relational, history, texts, claims, decisions, evidence, jobs]

QUERIES = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLE_SQL = {name: q for m in _MODULES for name, q in m.ORACLE_SQL.items()}
