"""All queries of the core by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from cohortia.plans import answers, exchange, panel, pipelines, training, upkeep

_MODULES = [training, panel, answers, upkeep, pipelines, exchange]
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
