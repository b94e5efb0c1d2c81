"""All registered queries of the reaction library with their DuckDB statements."""

from __future__ import annotations

from rxncurate.plans import curation, outputs, recovery, scoring, structures, upkeep

_MODULES = (scoring, curation, outputs, recovery, structures, upkeep)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE = {name: sql for m in _MODULES for name, sql in m.ORACLE.items()}
