"""The whole catalogue: logical SQL, the operators beyond it, and checks of sources, messages and metadata."""

from __future__ import annotations

from veridex.plans import catalogue, catalogue_checks, catalogue_more

_PARTS = (catalogue, catalogue_more, catalogue_checks)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLE = {name: sql for part in _PARTS for name, sql in part.ORACLE.items()}
