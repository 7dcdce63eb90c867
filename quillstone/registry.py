"""The registered queries of the library's own operators, gathered from the modules of `plans`."""

from __future__ import annotations

from quillstone.plans import checks, engine, facts, questions, records, retrieval, runs, text, views

_MODULES = (facts, retrieval, text, questions, checks, engine, views, runs, records)
QUERIES: dict = {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}
ORACLE_SQL: dict = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
FLAGSHIP = "metric_ratios"
